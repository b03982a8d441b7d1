"""The record: one row type for every topic, and the few binary encodings that topics use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.ArrayType(HEADER)),
    ]
)
FIELDS = RECORD_SCHEMA.fieldNames()

#: Arrival order over several topics and partitions; within one partition ``offset`` alone.
ARRIVAL = ("ts_ns", "topic", "partition", "offset")

WINDOW_START, WINDOW_END, ERROR = "window.start.ns", "window.end.ns", "dlq.error"


def no_headers() -> Column:
    return F.array().cast(T.ArrayType(HEADER))


def text(c: Column | str) -> Column:
    """Bytes as text."""
    return F.decode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def raw(c: Column | str) -> Column:
    """Text as bytes."""
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def group_key(c: Column | str = "key") -> Column:
    """A null key and an empty one are the same group."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(b""))


def normalize_empty(df: DataFrame) -> DataFrame:
    """Empty values and header values become nulls, as logs on disk have them."""
    none = lambda c: F.when(F.octet_length(c) > 0, c)
    heads = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), none(h["value"]).alias("value")))
    return df.withColumns({"key": none(F.col("key")), "value": none(F.col("value")), "headers": heads})


def encode_be64(n: Column | str) -> Column:
    """A whole number as eight bytes, most significant first."""
    n = F.col(n) if isinstance(n, str) else n
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def decode_be64(b: Column | str) -> Column:
    """The number in eight bytes; 0 for any other length, null for null."""
    b = F.col(b) if isinstance(b, str) else b
    return F.when(F.octet_length(b) == 8, F.conv(F.hex(b), 16, -10).cast("long")).when(b.isNotNull(), F.lit(0).cast("long"))


def header(name: str, headers: Column | str = "headers") -> Column:
    """The first header of this name, as bytes; null without one."""
    return F.get(F.filter(headers, lambda h: h["key"] == name), F.lit(0))["value"]


def with_header(name: str, value: Column, headers: Column | str = "headers") -> Column:
    """Headers with one more at the end."""
    return F.concat(F.coalesce(headers if isinstance(headers, Column) else F.col(headers), no_headers()), F.array(F.struct(F.lit(name).alias("key"), value.alias("value"))))


def record(df: DataFrame, **columns: Column) -> DataFrame:
    """The eight columns of a record from any DataFrame; what is not given is null or taken by name."""
    base = {f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)) for f in RECORD_SCHEMA}
    base |= columns
    if "ts" not in columns and "ts_ns" in columns:
        base["ts"] = F.timestamp_micros(F.expr("0L") + F.floor(columns["ts_ns"] / 1000).cast("long"))
    return df.select(*[base[f.name].cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])
