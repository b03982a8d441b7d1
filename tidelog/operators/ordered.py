"""Operators that depend on arrival order: counters, first occurrences, rates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import ARRIVAL

Order = Sequence[str]


def arrival_index(df: DataFrame, order: Order = ARRIVAL, rows: int = 200_000, into: str = "idx", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with each record's place in arrival order (within its group of ``by``), from 0, without one task that sees all.

    Records are dealt into stretches of the first order column, a whole number or a time, counted, and
    numbered within. The counts are one row a stretch. Records with one value of that column stay together;
    other kinds of columns are numbered by group in one task each. The column's range is read at once.
    """
    kind = df.schema[order[0]].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "timestamp"):
        return df.withColumn(into, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    first = F.unix_micros(F.col(order[0])) if kind == "timestamp" else F.col(order[0]).cast("long")
    span = df.agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.count("*").alias("n")).first()
    lo = span.lo or 0
    width = max(1, ((span.hi or 0) - lo + 1) * rows // max(span.n, 1))
    placed = df.withColumn("_stretch", F.coalesce(F.floor((first - lo) / width), F.lit(-1)).cast("long"))
    counts = placed.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_stretch").alias("_s"), (F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(*order)) - 1
    same = F.col("_stretch") == F.col("_s")
    for c in by:
        same = same & F.equal_null(F.col(c), F.col(f"_by_{c}"))
    out = placed.withColumn("_local", local).join(before, same)
    return out.withColumn(into, (F.col("_before") + F.col("_local")).cast("long")).drop("_stretch", "_s", "_before", "_local", *[f"_by_{c}" for c in by])


def take(df: DataFrame, n: int, order: Order = ARRIVAL) -> DataFrame:
    """The first n; none for n <= 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df.where(F.lit(False))


def skip(df: DataFrame, n: int, order: Order = ARRIVAL) -> DataFrame:
    """All but the first n; all for n <= 0."""
    if n <= 0:
        return df
    return arrival_index(df, order, into="_idx").where(F.col("_idx") >= n).drop("_idx")


def sample_nth(df: DataFrame, n: int, order: Order = ARRIVAL) -> DataFrame:
    """The first and each n-th after it; all for 1, none for n <= 0."""
    if n <= 0:
        return df.where(F.lit(False))
    return df if n == 1 else arrival_index(df, order, into="_idx").where(F.col("_idx") % n == 0).drop("_idx")


def distinct_first(df: DataFrame, key: Column | str = "key", order: Order = ARRIVAL) -> DataFrame:
    """The first record of each derived key.

    The minimum has a partial form, so records of a key shrink before the exchange.
    """
    key = F.col(key) if isinstance(key, str) else key
    whole, at = F.struct(*df.columns), F.struct(*[F.col(c) for c in order])
    return df.groupBy(F.coalesce(key.cast("binary"), F.lit(b"")).alias("_k")).agg(F.min_by(whole, at).alias("_r")).select("_r.*")


def throttle(df: DataFrame, per_second: float, by: Sequence[str] = ("topic", "partition"), order: Order = ARRIVAL) -> DataFrame:
    """A token bucket on event time for each partition: full at first, holds ``per_second`` tokens, a record takes one.

    Refilling depends on what passed before, so each partition is folded in order; a rate <= 0 passes none.
    """
    if per_second <= 0:
        return df.where(F.lit(False))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        tokens, last, kept = float(per_second), None, []
        for ts in rows["ts_ns"]:
            if last is not None:
                tokens = min(float(per_second), tokens + max(0, ts - last) / 1e9 * per_second)
            last = ts if last is None else max(last, ts)
            kept.append(tokens >= 1)
            tokens -= tokens >= 1
        return rows[kept]

    return df.groupBy(*by).applyInPandas(fold, df.schema)


def idempotent(df: DataFrame, producer: Column | str, sequence: Column | str, order: Order = ARRIVAL, stretch: int | None = None) -> DataFrame:
    """Of each producer and partition, records whose sequence number exceeds all before it.

    ``stretch``: a width of the first order column; the largest number is then found within stretches and
    carried from one to the next, so that a busy producer is many groups.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    by = ("_p", "topic", "partition")
    out = df.withColumns({"_p": col(producer), "_s": col(sequence)})
    fresh = F.col("_m").isNull() | (F.col("_s") > F.col("_m"))
    if stretch is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumn("_m", F.max("_s").over(w)).where(fresh).select(*df.columns)
    out = out.withColumn("_b", F.floor(F.col(order[0]) / stretch).cast("long"))
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = out.groupBy(*by, "_b").agg(F.max("_s").alias("_t")).select(*[F.col(c).alias(f"_c{c}") for c in (*by, "_b")], F.max("_t").over(upto).alias("_before"))
    same = F.lit(True)
    for c in (*by, "_b"):
        same = same & F.equal_null(F.col(c), F.col(f"_c{c}"))
    local = out.withColumn("_l", F.max("_s").over(w)).join(carried, same)
    return local.withColumn("_m", F.greatest("_l", "_before")).where(fresh).select(*df.columns)
