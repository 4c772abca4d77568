"""Frames that several later steps read: written once to the folder that driver and executors share, so that no step repeats them
and plans of loops stay small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df, read back from the session's ``spark.checkpoint.dir``; only in local mode, where that may be unset, is one made."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cytolake-"))
        found = spark.sparkContext.getCheckpointDir()
    path = f"{found.rstrip('/')}/cytolake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEYS: dict[int, list[int]] = {}


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that hash partitioning deals to each of n partitions, one to each."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    if n not in _KEYS:
        _KEYS[n] = [r[1] for r in spark.range(64 * n + 1024).groupBy(place.alias("p")).agg(F.min("id").cast("int")).orderBy("p").collect()]
    return _KEYS[n]
