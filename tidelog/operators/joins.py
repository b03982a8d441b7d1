"""Joins of two streams by key and time, and of a stream with a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import group_key
from tidelog.operators.windows import DAY


def interval_join(left: DataFrame, right: DataFrame, window_ns: int, how: str = "inner", bucketed: bool = True) -> DataFrame:
    """(left, right), each a struct of the record: equal keys, times no more than ``window_ns`` apart.

    ``how``: inner, left or full. Null and empty keys are one key. With ``bucketed`` the equality
    includes a bucket of time: the right side stands in its own bucket and both neighbours, so a hot
    key is spread over time and candidates are near in time before the exact test.
    """
    pack = lambda df: F.struct(*df.columns)
    span = max(window_ns, 1)
    l = left.select(pack(left).alias("left"), group_key().alias("_k"), F.floor(F.col("ts_ns") / span).cast("long").alias("_b"))
    r = right.select(pack(right).alias("right"), group_key().alias("_k"), F.floor(F.col("ts_ns") / span).cast("long").alias("_b"))
    near = F.abs(F.col("left.ts_ns") - F.col("right.ts_ns")) <= window_ns
    if not bucketed:
        a, b = l.drop("_b").alias("a"), r.drop("_b").alias("b")
        kind = {"inner": "inner", "left": "left", "full": "full_outer"}[how]
        return a.join(b, (F.col("a._k") == F.col("b._k")) & near, kind).select("left", "right")
    near_b = r.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    if how == "inner":
        return l.join(near_b, ["_k", "_b"]).where(near).select("left", "right")
    out = l.join(near_b, (l["_k"] == near_b["_k"]) & (l["_b"] == near_b["_b"]) & near, "left").select("left", "right")
    if how == "left":
        return out
    # a right record is alone where no left one of the three buckets around its own is near
    around = l.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    x, y = r.alias("x"), around.alias("y")
    close = (F.col("x._k") == F.col("y._k")) & (F.col("x._b") == F.col("y._b")) & (F.abs(F.col("y.left.ts_ns") - F.col("x.right.ts_ns")) <= window_ns)
    alone = x.join(y, close, "left_anti").select("right")
    empty = F.lit(None).cast(l.schema["left"].dataType)
    return out.unionByName(alone.select(empty.alias("left"), "right"))


def table_join(stream: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """``stream`` with the table's final ``table_value`` of its key and ``hit``. how: left, inner or anti."""
    t = table.where(F.octet_length("key") > 0).select(F.col("key").alias("_k"), F.col("value").alias("table_value"), F.lit(True).alias("_hit"))
    out = stream.join(t, stream["key"] == t["_k"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")
    return {"left": out, "inner": out.where("hit"), "anti": out.where("NOT hit")}[how]


def asof_join(stream: DataFrame, table: DataFrame, values: Sequence[str] = ("value",), prefix: str = "table_", by: Column | str | None = None, stretch_ns: int = DAY) -> DataFrame:
    """``stream`` with the table's values as they were at each record's time (at equal times, already there).

    Both together are sorted by key and time within stretches of time, so that a hot key is many groups;
    a stretch begins with the last values of those before it, one row a stretch. No pairs are made.
    """
    key = group_key(by) if by is not None else group_key()
    some = F.struct(*[F.col(v) for v in values])
    none = F.lit(None)
    place = F.floor(F.col("ts_ns") / stretch_ns).cast("long").alias("_b")
    s = stream.select(key.alias("_k"), F.col("ts_ns").alias("_t"), place, F.lit(1).alias("_side"), F.struct(*stream.columns).alias("_row"), none.cast(table.select(some.alias("x")).schema["x"].dataType).alias("_v"))
    t = table.select(group_key().alias("_k"), F.col("ts_ns").alias("_t"), place, F.lit(0).alias("_side"), none.cast(s.schema["_row"].dataType).alias("_row"), some.alias("_v"))
    both = s.unionByName(t)
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("_k", "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
    carried = ends.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    out = out.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb"))).withColumn("_last", F.coalesce("_own", "_carried"))
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(f"{prefix}{v}") for v in values])
