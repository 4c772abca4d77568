"""Scoring of images as they arrive: an extension, since cohorts grow. Each micro-batch is scored with a fitted model and
appended to a table partitioned by image, so a restart from the checkpoint rewrites at most one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a file stream of cells; ``score`` turns a batch into predictions with column image."""

    def write(batch: DataFrame, _: int) -> None:
        score(batch).write.partitionBy("image").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    rows = spark.readStream.schema(schema).parquet(source)
    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
