"""Keyed aggregation: running (one row for each record), and final (one row for each key)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import ARRIVAL, group_key

Order = Sequence[str]
COMBINE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def wrapped(c: Column) -> Column:
    """A sum of 64-bit numbers that wraps around as two's complement does."""
    m = F.lit(2).cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(38,0)") * 2
    r = F.pmod(c.cast("decimal(38,0)"), m.cast("decimal(38,0)"))
    return F.when(r >= m / 2, r - m).otherwise(r).cast("long")


def running(df: DataFrame, how: str, value: Column | str | None = None, key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg", stretch: int | None = None) -> DataFrame:
    """Each record with the aggregate (count, sum, max, min) of its key up to it.

    ``stretch``: a width of the first order column. A key's records are then summed within stretches
    of that width and the sums are carried from stretch to stretch, so that a hot key is many groups.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    own = F.lit(1).cast("long") if how == "count" else col(value)
    step = COMBINE[how]
    out = df.withColumns({"_k": group_key(col(key)), "_v": own})
    if stretch is None:
        w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return out.withColumn(into, step("_v").over(w)).drop("_k", "_v")
    out = out.withColumn("_b", F.floor(F.col(order[0]) / stretch).cast("long"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = out.groupBy("_k", "_b").agg(step("_v").alias("_t")).select("_k", "_b", step("_t").over(before).alias("_c"))
    inner = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = out.withColumn("_l", step("_v").over(inner)).join(carried, ["_k", "_b"])
    both = {"max": F.greatest, "min": F.least}.get(how)
    total = both("_l", "_c") if both else F.col("_l") + F.coalesce("_c", F.lit(0))
    return local.withColumn(into, total).drop("_k", "_v", "_b", "_l", "_c")


def final(df: DataFrame, how: str, value: Column | str | None = None, key: Column | str = "key", into: str = "agg", wrap: bool = False) -> DataFrame:
    """(key, aggregate) after all records. With ``wrap`` sums wrap around where they would fail."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    if how == "count":
        agg = F.count(F.lit(1))
    elif how == "sum" and wrap:
        agg = wrapped(F.sum(col(value).cast("decimal(38,0)")))
    else:
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[how](col(value))
    return df.groupBy(group_key(col(key)).alias("key")).agg(agg.alias(into))


def reduce_(df: DataFrame, value: Column | str, merge: Callable[[Column, Column], Column], key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg") -> DataFrame:
    """(key, fold of its values in order); the first value is the first accumulator.

    A key's values are one array, so this is for folds that have no partial form; sums, counts,
    maxima and minima have ``final``.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], col(value).alias("_v"))))
    out = df.groupBy(group_key(col(key)).alias("key")).agg(rows.alias("_r"))
    values = F.transform("_r", lambda r: r["_v"])
    return out.select("key", F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), merge).alias(into))


def running_reduce(df: DataFrame, value: Column | str, merge: Callable[[Column, Column], Column], key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg") -> DataFrame:
    """Each record with the fold of its key's values up to it, by a function of columns; the first value is the first accumulator.

    A key's values are one array. Folds of its first BLOCK, 2 BLOCK, ... values are made first and the others
    begin at the last of them: n values take n * n / (2 * BLOCK) + n * BLOCK / 2 steps. ``running_reduce_python``
    takes n, ``running`` splits hot keys.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    places = [f"_o{k}" for k in range(len(order))]
    need = df.select(group_key(col(key)).alias("_k"), F.struct(*[F.col(c).alias(o) for c, o in zip(order, places, strict=True)], col(value).alias("_v")).alias("_r"))
    rows = need.groupBy("_k").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    rows = rows.withColumn("_a", F.transform("_r", lambda r: r["_v"]))
    first = lambda n: F.aggregate(F.slice("_a", F.lit(2), n - 1), F.get(F.col("_a"), F.lit(0)), merge)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_a"), F.lit(1)), F.lit(BLOCK)), lambda at: F.when(at > 1, first(at - 1)))
    rows = rows.withColumn("_s", starts)
    upto = lambda i: F.aggregate(F.slice("_a", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1), F.get(F.col("_s"), F.floor(i / BLOCK).cast("int")), merge)
    each = F.transform("_r", lambda r, i: F.struct(*[r[o].alias(o) for o in places], F.when(i < BLOCK, first(i + 1)).otherwise(upto(i)).alias(into)))
    made = rows.select(F.explode(each).alias("_e")).select("_e.*")
    return _beside(df, made, order, places, into)


def _beside(df: DataFrame, made: DataFrame, order: Order, places: Sequence[str], into: str) -> DataFrame:
    """Records with what was made for their places."""
    same = F.lit(True)
    for c, o in zip(order, places, strict=True):
        same = same & F.equal_null(F.col(c), F.col(o))
    return df.join(made, same).select(*df.columns, into)


def running_reduce_python(df: DataFrame, value: Column | str, merge: Callable[[object, object], object], result: str, key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg") -> DataFrame:
    """The same by any Python function."""
    return running_fold(df, value, lambda state, x: x if state is NOTHING else merge(state, x), result, key, order, into)


BLOCK = 64
NOTHING = "tidelog: nothing yet"


def running_fold(df: DataFrame, value: Column | str, step: Callable[[object, object], object], result: str, key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg", start: object = NOTHING) -> DataFrame:
    """Each record with the accumulator after it: ``step(before, value)`` over its key's records in order, from ``start``.

    A key's keys, values and places are folded in one task, in time in proportion to their number; where
    a sum, count, maximum or minimum is meant, ``running`` has forms that split hot keys. Only what the
    fold needs goes through Python; the records meet their results by place.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in rows.columns if c.startswith("_o")], kind="stable")
        state, out = start, []
        for x in rows["_v"].tolist():
            state = step(state, x)
            out.append(state)
        return rows.drop(columns=["_k", "_v"]).assign(**{into: pd.Series(out, index=rows.index, dtype=object)})

    places = [f"_o{k}" for k in range(len(order))]
    need = df.select(group_key(col(key)).alias("_k"), col(value).alias("_v"), *[F.col(c).alias(o) for c, o in zip(order, places, strict=True)])
    types = T.StructType([*[need.schema[o] for o in places], T.StructField(into, T._parse_datatype_string(result))])
    return _beside(df, need.groupBy("_k").applyInPandas(run, types), order, places, into)


def fold(df: DataFrame, value: Column | str, start: Column, step: Callable[[Column, Column], Column], key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg") -> DataFrame:
    """(key, fold of its values in order from ``start``)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], col(value).alias("_v"))))
    out = df.groupBy(group_key(col(key)).alias("key")).agg(rows.alias("_r"))
    return out.select("key", F.aggregate(F.transform("_r", lambda r: r["_v"]), start, step).alias(into))


def fold_python(df: DataFrame, step: Callable[[object, dict], object], result: str, key: Column | str = "key", order: Order = ARRIVAL, into: str = "agg") -> DataFrame:
    """The same with any Python function of (previous or None, record), a group at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in rows.sort_values(list(order)).to_dict("records"):
            state = step(state, r)
        return pd.DataFrame({"key": [rows["_k"].iloc[0]], into: [state]})

    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField(into, T._parse_datatype_string(result))])
    return df.withColumn("_k", group_key(F.col(key) if isinstance(key, str) else key)).groupBy("_k").applyInPandas(run, schema)


def latest(df: DataFrame, order: Order = ("offset",), by: Sequence[str] = (), tombstones: bool = False, empty_keys: bool = False) -> DataFrame:
    """The last record of each key; a null value deletes the key. Keys that are null or empty are left out.

    The maximum has a partial form: a hot key shrinks before the exchange.
    """
    keyed = df if empty_keys else df.where(F.octet_length("key") > 0)
    last = F.max_by(F.struct(*df.columns), F.struct(*[F.col(c) for c in order]))
    out = keyed.groupBy(*by, group_key().alias("_k")).agg(last.alias("_r")).select("_r.*")
    return out if tombstones else out.where(F.col("value").isNotNull())
