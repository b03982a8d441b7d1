"""Tables written between the jobs of one operator.

They live in the shared folder that the session names in ``spark.checkpoint.dir``, so that a lost
executor costs no more than a reread, and they are deleted when the driver's process ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[object, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder; one of our own only on a local master where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _own[0]


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # the JVM may have ended first
            return


class Scratch:
    """Written tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
        _written.append((spark, self.path))

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it; its lineage starts there."""
        at = f"{self.path}/{tag}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def tidy(self) -> None:
        """Let Spark delete shuffle files that nothing refers to any more; call it after a large table is written."""
        for _ in range(2):  # the first finds what held the files, the second the files; Spark deletes them meanwhile
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, tag: str) -> None:
        drop(self.spark, f"{self.path}/{tag}")
