import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    """records([(key, value[, ts_ms[, headers]])...]) in arrival order on one partition."""
    from pyspark.sql import functions as F

    from tidelog.model import RECORD_SCHEMA

    def make(rows, partition=0, topic="input"):
        data = []
        for k, r in enumerate(rows):
            key, value, ts, heads = (*r, *(None,) * (4 - len(r)))
            data.append((topic, partition, k, (k if ts is None else ts) * 1_000_000, None, *(x.encode() if isinstance(x, str) else x for x in (key, value)), [(a, b.encode()) for a, b in heads or []]))
        return spark.createDataFrame(data, RECORD_SCHEMA).withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")))

    return make


@pytest.fixture
def kv():
    """(key, value) pairs as text, in offset order."""

    def show(df, *more):
        text = lambda x: bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x
        return [tuple(text(r[c]) for c in ("key", "value", *more)) for r in df.orderBy("offset").collect()]

    return show
