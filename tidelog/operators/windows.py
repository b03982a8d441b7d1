"""Counts by time windows, and the exact sequence of emissions for records that come late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import WINDOW_END, WINDOW_START, encode_be64, group_key, no_headers, record, with_header

Aggs = Sequence[Column]


def _aggs(aggs: Aggs | None) -> list[Column]:
    return list(aggs) if aggs else [F.count(F.lit(1)).alias("count")]


def tumbling(df: DataFrame, size_ns: int, aggs: Aggs | None = None, key: Column | str = "key", by: Sequence[str] = ()) -> DataFrame:
    """(key, window_start_ns, window_end_ns, aggregates) of windows that follow one another."""
    start = (F.col("ts_ns") - F.pmod("ts_ns", F.lit(size_ns))).alias("window_start_ns")
    out = df.groupBy(*by, group_key(key).alias("key"), start).agg(*_aggs(aggs))
    return out.withColumn("window_end_ns", F.col("window_start_ns") + size_ns)


def hopping(df: DataFrame, size_ns: int, advance_ns: int, aggs: Aggs | None = None, key: Column | str = "key", by: Sequence[str] = ()) -> DataFrame:
    """The same for windows that start every ``advance_ns``; a record is in each that spans it."""
    if not 0 < advance_ns <= size_ns:
        raise ValueError("0 < advance <= size is needed")
    last = F.col("ts_ns") - F.pmod("ts_ns", F.lit(advance_ns))
    first = last - (size_ns - 1) // advance_ns * advance_ns
    starts = F.filter(F.sequence(first, last, F.lit(advance_ns).cast("long")), lambda s: s > F.col("ts_ns") - size_ns)
    out = df.withColumn("window_start_ns", F.explode(starts)).groupBy(*by, group_key(key).alias("key"), "window_start_ns").agg(*_aggs(aggs))
    return out.withColumn("window_end_ns", F.col("window_start_ns") + size_ns)


DAY = 86_400_000_000_000


def session(df: DataFrame, gap_ns: int, aggs: Aggs | None = None, key: Column | str = "key", stretch_ns: int = DAY) -> DataFrame:
    """The same for sessions: a record more than ``gap_ns`` after the last one starts another. The end is the last record's time.

    Records are cut into sessions within stretches of time, so that a hot key is many groups; those of a
    key, as starts and ends alone, are then joined where they touch across a stretch's end.
    """
    local = Window.partitionBy("_k", "_b").orderBy("ts_ns")
    new = F.coalesce((F.col("ts_ns") - F.lag("ts_ns").over(local) > gap_ns).cast("int"), F.lit(1))
    out = df.withColumns({"_k": group_key(key), "_b": F.floor(F.col("ts_ns") / stretch_ns).cast("long")}).withColumn("_new", new)
    out = out.withColumn("_s", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    spans = out.groupBy("_k", "_b", "_s").agg(F.min("ts_ns").alias("_from"), F.max("ts_ns").alias("_to"))
    whole = Window.partitionBy("_gk").orderBy("_gb", "_gs")
    spans = spans.select(F.col("_k").alias("_gk"), F.col("_b").alias("_gb"), F.col("_s").alias("_gs"), "_from", "_to")
    apart = F.coalesce((F.col("_from") - F.lag("_to").over(whole) > gap_ns).cast("int"), F.lit(1))
    spans = spans.withColumn("_apart", apart).withColumn("_id", F.sum("_apart").over(whole.rowsBetween(Window.unboundedPreceding, 0))).select("_gk", "_gb", "_gs", "_id")
    named = out.join(spans, (F.col("_k") == F.col("_gk")) & (F.col("_b") == F.col("_gb")) & (F.col("_s") == F.col("_gs")))
    made = named.groupBy(F.col("_k").alias("key"), "_id").agg(F.min("ts_ns").alias("window_start_ns"), F.max("ts_ns").alias("window_end_ns"), *_aggs(aggs))
    return made.drop("_id")


def replay(df: DataFrame, size_ns: int, advance_ns: int | None = None, order: str = "offset", by: Sequence[str] = ("topic", "partition")) -> DataFrame:
    """Counts as a record-at-a-time engine emits them, late records re-opening their windows.

    Records come in ``order`` within each partition; the watermark is the largest time so far. A record
    closes every window that the watermark has reached, except the one it is in itself. A window that
    gets another record after it was emitted is counted anew and emitted again. In closed form: a record
    belongs to the emission numbered by how many closings of its window came before it, and an emission
    happens where a later closing follows. With f the first place at which the watermark reaches the
    window's end, closings before place i are i - f less the window's own records since f, so counting
    needs window functions and one join on distinct windows.
    """
    step = advance_ns or size_ns
    seq = Window.partitionBy(*by).orderBy(order)
    upto = seq.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("ts_ns") - F.pmod("ts_ns", F.lit(step))
    placed = df.withColumns({"_i": F.row_number().over(seq).cast("long") - 1, "_wm": F.max("ts_ns").over(upto), "_own": own, "_key": group_key()})
    marks = placed.groupBy(*by, "_wm").agg(F.min("_i").alias("_at"))
    if advance_ns:
        first = own - (size_ns - 1) // step * step
        starts = F.filter(F.sequence(first, own, F.lit(step).cast("long")), lambda s: (s > F.col("ts_ns") - size_ns) & (s >= 0))
        held = placed.withColumn("_w", F.explode(starts))
    else:
        held = placed.withColumn("_w", F.col("_own"))
    # f: of each window's end, the first place whose watermark reaches it: a merge of ends and marks by time
    ends = held.select(*by, (F.col("_w") + size_ns).alias("_t")).distinct().withColumns({"_at": F.lit(None).cast("long"), "_end": F.lit(True)})
    both = ends.unionByName(marks.select(*by, F.col("_wm").alias("_t"), "_at", F.lit(False).alias("_end")))
    # read from the latest time back, as a frame without end on the far side is summed anew for every row
    later = Window.partitionBy(*by).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = both.withColumn("_f", F.min("_at").over(later)).where("_end").select(*by, (F.col("_t") - size_ns).alias("_w"), "_f")
    size = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    # records whose own start is a window count against its closings, whatever their key
    alike = Window.partitionBy(*by, "_own").orderBy("_i")
    since = placed.join(reach.withColumnRenamed("_w", "_own"), [*by, "_own"], "left").withColumn("_late", (F.col("_f").isNotNull() & (F.col("_i") >= F.col("_f"))).cast("long"))
    since = since.select(*by, F.col("_own").alias("_w"), "_i", F.coalesce(F.sum("_late").over(alike.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_own_before"), "_late")
    total = since.groupBy(*by, "_w").agg(F.sum("_late").alias("_own_all"))
    if advance_ns:
        # for every window, the late records of its own start up to each place
        marks_own = since.select(*by, "_w", "_i", "_late", F.lit(None).cast("binary").alias("_key"), F.lit(0).alias("_is"))
        asks = held.select(*by, "_w", "_i", F.lit(0).cast("long").alias("_late"), "_key", F.lit(1).alias("_is"))
        order_ = Window.partitionBy(*by, "_w").orderBy("_i", F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
        counted = marks_own.unionByName(asks).withColumn("_own_before", F.sum("_late").over(order_)).where("_is = 1").select(*by, "_w", "_i", "_key", "_own_before")
    else:
        counted = held.select(*by, "_w", "_i", "_key").join(since.select(*by, "_w", "_i", "_own_before"), [*by, "_w", "_i"])
    out = counted.join(reach, [*by, "_w"], "left").join(total, [*by, "_w"], "left").join(size, list(by))
    closings = F.greatest(F.col("_i") - F.col("_f"), F.lit(0)) - F.col("_own_before")
    chunk = F.when(F.col("_f").isNull() | (F.col("_i") <= F.col("_f")), F.lit(0)).otherwise(closings)
    all_ = F.when(F.col("_f").isNull(), 0).otherwise(F.col("_n") - F.col("_f") - F.coalesce("_own_all", F.lit(0)))
    return out.withColumns({"_chunk": chunk, "_all": all_}).groupBy(*by, F.col("_key").alias("key"), F.col("_w").alias("window_start_ns"), F.col("_chunk").alias("emission")).agg(F.count("*").alias("count"), F.max("_all").alias("_all")).where(F.col("emission") < F.col("_all")).drop("_all")


def watermark(df: DataFrame, idle_ns: int | None = None, last_arrival_ns: Column | int | None = None, now_ns: Column | int | None = None) -> DataFrame:
    """One row: the largest event time; ``now_ns`` where nothing has arrived for ``idle_ns``."""
    top = F.max("ts_ns")
    if idle_ns is not None:
        at, now = (x if isinstance(x, Column) else F.lit(x) for x in (last_arrival_ns, now_ns))
        top = F.when(now - at >= idle_ns, F.greatest(now, top)).otherwise(top)
    return df.agg(top.alias("watermark_ns"))


def closed(made: DataFrame, at: DataFrame) -> DataFrame:
    """Windows whose end the watermark has reached."""
    return made.join(F.broadcast(at.select(F.col("watermark_ns").alias("_wm"))), F.col("window_end_ns") <= F.col("_wm")).drop("_wm")


def emitted(made: DataFrame, value: Column | str = "count", topic: str = "windows") -> DataFrame:
    """Records of windows: the key, the value as eight bytes, the window's start and end as headers of eight bytes, its end as time."""
    v = F.col(value) if isinstance(value, str) else value
    heads = with_header(WINDOW_END, encode_be64("window_end_ns"), with_header(WINDOW_START, encode_be64("window_start_ns"), no_headers()))
    return record(made, topic=F.lit(topic), key=F.col("key"), value=encode_be64(v), ts_ns=F.col("window_end_ns"), headers=heads)


def punctuations(df: DataFrame, every_ns: int, key: Column | str | None = None) -> DataFrame:
    """(at_ns, records[, key]): what a function that is called each time event time passes a multiple of ``every_ns`` would see.

    The calls are those between the first and the last record's time; ``records`` is how many came before
    or at each, of each key where one is given. Records shrink to counts of stretches before they meet.
    """
    by = [] if key is None else [group_key(key).alias("key")]
    names = [] if key is None else ["key"]
    step = (F.floor((F.col("ts_ns") + every_ns - 1) / every_ns) * every_ns).cast("long")
    counts = df.groupBy(*by, step.alias("_at")).agg(F.count("*").alias("_n"))
    last = df.agg((F.floor(F.max("ts_ns") / every_ns) * every_ns).cast("long").alias("_last"))
    upto = Window.partitionBy(*names).orderBy("_at")
    spans = counts.withColumns({"records": F.sum("_n").over(upto), "_next": F.lead("_at").over(upto)}).join(F.broadcast(last))
    spans = spans.withColumn("_to", F.least(F.coalesce(F.col("_next") - every_ns, F.col("_last")), F.col("_last"))).where("_at <= _to")
    return spans.select(*names, F.explode(F.sequence("_at", "_to", F.lit(every_ns).cast("long"))).alias("at_ns"), "records")
