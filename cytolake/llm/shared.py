"""Tables in the folder that the driver and all executors share, and small helpers used by every operator here.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, notebooks) is one made.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def in_one_process(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not in_one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cytolake-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def trim_driver(spark: SparkSession) -> bool:
    """Has the driver's JVM give back what its compiler and buffers have freed outside of the heap, which the C library keeps otherwise. False if that JVM cannot."""
    context = spark.sparkContext
    beans = context._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the interface, as the class of the server is in no exported package
    call = next(m for m in context._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = context._gateway.new_array(context._jvm.java.lang.Object, 4)
    given[0], given[1] = name, "systemTrimNativeHeap"
    try:
        call.invoke(beans, given)
    except Py4JJavaError:
        return False
    return True


def small_batches(spark: SparkSession) -> None:
    """Long texts fill an Arrow batch by their bytes, so that a worker never holds ten thousand of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class Tables:
    """Written intermediate tables of one run. ``cut`` writes a frame and reads it back: lineage ends there and a lost
    executor costs no recomputation. ``drop`` removes tables that the returned frame no longer reads."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/cytolake-{uuid.uuid4().hex}"
        if not in_one_process(spark):
            self.free()

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # hashes, signatures and data hardly repeat: no dictionary is tried
        plain = {f"parquet.enable.dictionary#{f.name}": "false" for f in df.schema.fields if isinstance(f.dataType, BinaryType)}
        df.write.mode("overwrite").options(**plain).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of finished frames, which it does when the driver's JVM collects them; and has the driver
        and the executors, whose memory otherwise only grows, give back what the classes and buffers of finished plans held."""
        gc.collect()
        if not in_one_process(self.spark):
            n = self.spark.sparkContext.defaultParallelism
            self.spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()
        # the driver comes last: its listeners hold the latest execution, and so its shuffle files, until another one ends
        self.spark.sparkContext._jvm.System.gc()
        trim_driver(self.spark)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: What operators remember in a Python worker, as ways to forget it; and the operator that a worker served last.
FORGET: list[Callable[[], None]] = []
_SERVED = [""]


def begin(owner: str) -> None:
    if _SERVED[0] != owner:
        for forget in FORGET:
            forget()
        _SERVED[0] = owner


def finish() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches. A worker serves one operator after the other: it first forgets what another has
    remembered, and gives memory back at the task's end."""

    def served(batches: Iterator) -> Iterator:
        begin(owner)
        yield from run(batches)
        finish()

    return served


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether a frame that is cheap to count may be broadcast; callers shuffle it otherwise."""
    return df.count() * row_bytes <= limit


def semi(df: DataFrame, ids: DataFrame, key: str, row_bytes: int = 16) -> DataFrame:
    """Rows of df whose key is in ids (distinct): by broadcast if ids is measured to be small, else by a shuffle."""
    return df.join(F.broadcast(ids) if small_enough(ids, row_bytes) else ids, key, "left_semi")
