"""Maintenance and inspection of topics as relations over record tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.routing import partition_for
from tidelog.model import no_headers, record
from tidelog.operators.ordered import arrival_index

PART = ("topic", "partition")


# -- reads
def assign(df: DataFrame, partition: int, offset: int = 0) -> DataFrame:
    """One partition from an offset; both reach the scan as pushed filters."""
    return df.where((F.col("partition") == partition) & (F.col("offset") >= offset))


def subscribe(*topics: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """All partitions of topics, from committed (topic, partition, next_offset) where given."""
    out = topics[0]
    for t in topics[1:]:
        out = out.unionByName(t)
    if starts is None:
        return out
    return out.join(starts, list(PART), "left").where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).select(*out.columns)


def head(df: DataFrame, partition: int, n: int = 10) -> DataFrame:
    return df.where(F.col("partition") == partition).orderBy("offset").limit(n)


def last(df: DataFrame, partition: int, n: int = 10) -> DataFrame:
    """Records of the last n offsets; fewer where offsets are missing."""
    own = df.where(F.col("partition") == partition)
    end = own.agg((F.max("offset") + 1).alias("_end"))
    return own.join(end, F.col("offset") >= F.col("_end") - n).drop("_end")


def fetch(df: DataFrame, partition: int, offset: int) -> DataFrame:
    """The record at an offset, or the next one where that is gone."""
    return assign(df, partition, offset).orderBy("offset").limit(1)


def seek(df: DataFrame, to: DataFrame | None = None, where: str = "begin") -> DataFrame:
    """Records from a place in each partition: given (topic, partition, offset), or the begin, or the end of the log.

    The end is that of the records there are now: nothing is left to read until more come.
    """
    if to is not None:
        return df.join(to.select(*PART, F.col("offset").alias("_from")), list(PART), "left").where(F.col("offset") >= F.coalesce("_from", F.lit(0))).select(*df.columns)
    if where not in ("begin", "end"):
        raise ValueError("seek to begin or end, or to given offsets")
    return df if where == "begin" else tail(df, high_water(df))


def without(df: DataFrame, paused: Sequence[tuple[str, int]]) -> DataFrame:
    """Records of all partitions but the paused ones, which keep their position."""
    held = F.lit(False)
    for topic, partition in paused:
        held = held | ((F.col("topic") == topic) & (F.col("partition") == partition))
    return df.where(~held)


def poll(df: DataFrame, starts: DataFrame | None, most: int, order: Sequence[str] = ("ts_ns", "topic", "partition", "offset")) -> DataFrame:
    """The next ``most`` records at most, in arrival order, after committed (topic, partition, next_offset)."""
    return subscribe(df, starts=starts).orderBy(*order).limit(max(0, most))


def position(read: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(topic, partition, next_offset) after the records of a poll; where it has none, the start."""
    after = read.groupBy(*PART).agg((F.max("offset") + 1).alias("_after"))
    if starts is None:
        return after.withColumnRenamed("_after", "next_offset")
    return starts.join(after, list(PART), "full_outer").select(*PART, F.coalesce("_after", "next_offset").alias("next_offset"))


def consume(df: DataFrame, committed: DataFrame | None, most: int, where: str = "begin") -> tuple[DataFrame, DataFrame]:
    """What a group's member reads, and the offsets to commit: from its own ones, or from ``where`` without any."""
    start = df if committed is not None else seek(df, where=where)
    read = poll(start, committed, most)
    return read, position(read, committed)


def tail(df: DataFrame, after: DataFrame) -> DataFrame:
    """Records after a snapshot of ends (topic, partition, high_water)."""
    return df.join(after, list(PART), "left").where(F.col("offset") >= F.coalesce("high_water", F.lit(0))).select(*df.columns)


def high_water(df: DataFrame) -> DataFrame:
    return df.groupBy(*PART).agg((F.max("offset") + 1).alias("high_water"))


def stats(df: DataFrame) -> DataFrame:
    """Per partition: first offset, high water, true count, keys, bytes."""
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    return df.groupBy(*PART).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("high_water"), F.count("*").alias("records"), F.sum(size.cast("long")).alias("bytes"), F.max("ts_ns").alias("newest_ns"))


def lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """(group, topic, partition, committed, high_water, lag): -1 where either is unknown."""
    out = committed.join(ends, list(PART), "full_outer")
    known = F.col("high_water").isNotNull() & F.col("next_offset").isNotNull() & (F.col("next_offset") >= 0)
    return out.select("group", *PART, F.coalesce("next_offset", F.lit(-1)).alias("committed"), F.coalesce("high_water", F.lit(-1)).alias("high_water"), F.when(known, F.col("high_water") - F.col("next_offset")).otherwise(-1).alias("lag"))


def total_lag(lags: DataFrame) -> DataFrame:
    """(group, lag) over all partitions whose lag is known."""
    return lags.where("lag >= 0").groupBy("group").agg(F.sum("lag").alias("lag"))


# -- maintenance
def segments(df: DataFrame, records: int) -> Column:
    """A segment number for each record: so many offsets each."""
    return F.floor(F.col("offset") / records).cast("long")


def compact(df: DataFrame, segment: Column) -> DataFrame:
    """Sealed segments keep each key's last record, none for tombstones and keyless records; the newest segment stays whole.

    Offsets stay. A key's last record is a maximum with a partial form, so hot keys shrink early.
    """
    cut = df.withColumn("_seg", segment)
    newest = cut.groupBy(*PART).agg(F.max("_seg").alias("_newest"))
    cut = cut.join(newest, list(PART))
    columns = F.struct(*df.columns)
    sealed = cut.where(F.col("_seg") < F.col("_newest")).where(F.octet_length("key") > 0)
    kept = sealed.groupBy(*PART, F.col("key").alias("_k")).agg(F.max_by(columns, "offset").alias("_r")).select("_r.*").where(F.col("value").isNotNull())
    return kept.unionByName(cut.where(F.col("_seg") == F.col("_newest")).select(*df.columns))


def retain_time(df: DataFrame, cutoff_ns: int, segment: Column) -> DataFrame:
    """Drop the oldest sealed segments while their newest record is older than the cut-off; stop at the first to keep."""
    cut = df.withColumn("_seg", segment)
    per = cut.groupBy(*PART, "_seg").agg(F.max_by("ts_ns", "offset").alias("_newest"))
    w = Window.partitionBy(*PART)
    keep = per.withColumn("_first", F.coalesce(F.min(F.when(F.col("_newest") >= cutoff_ns, F.col("_seg"))).over(w), F.max("_seg").over(w))).groupBy(*PART).agg(F.min("_first").alias("_first"))
    return cut.join(keep, list(PART)).where(F.col("_seg") >= F.col("_first")).select(*df.columns)


def retain_size(df: DataFrame, max_bytes: int, segment: Column) -> DataFrame:
    """Drop the oldest sealed segments while the total is above ``max_bytes``; the newest always stays."""
    size = (F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
    cut = df.withColumn("_seg", segment)
    per = cut.groupBy(*PART, "_seg").agg(F.sum(size).alias("_bytes"))
    newer = Window.partitionBy(*PART).orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.sum("_bytes").over(newer)).withColumn("_newest", F.max("_seg").over(Window.partitionBy(*PART)))
    keep = per.where((F.col("_upto") <= max_bytes) | (F.col("_seg") == F.col("_newest"))).select(*PART, "_seg")
    return cut.join(keep, [*PART, "_seg"], "left_semi").select(*df.columns)


# -- writes
Partitioner = Callable[[DataFrame, int], Column]


def append(topic: str, rows: DataFrame, partitions: int, ends: DataFrame, order: Sequence[str], now_ns: Column | None = None, partitioner: Partitioner | None = None) -> DataFrame:
    """Records for new rows (key, value[, headers, ts_ns]) of a topic: routed, with dense offsets after ``ends``.

    Keyless rows take partitions in turn; a ``partitioner`` of one's own gives a column of partition numbers
    from the rows and the number of partitions instead. A time of null or 0 is stamped ``now_ns``. Turns and
    offsets are counted by stretches of the first order column, never in one task.
    """
    if partitioner is not None:
        at = partitioner(rows, partitions)
        placed = rows.withColumn("_p", F.when((at >= 0) & (at < partitions), at).otherwise(F.raise_error(F.lit("a partitioner's number is out of range")).cast("int")).cast("int"))
    else:
        keyed = F.coalesce(F.octet_length("key") > 0, F.lit(False))
        turns = arrival_index(rows.where(~keyed), order, into="_turn")
        placed = rows.where(keyed).withColumn("_turn", F.lit(0).cast("long")).unionByName(turns)
        placed = placed.withColumn("_p", partition_for("key", partitions, F.pmod("_turn", F.lit(partitions)))).drop("_turn")
    known = ends.where(F.col("topic") == topic).select(F.col("partition").alias("_e"), "high_water")
    placed = arrival_index(placed, order, into="_place", by=("_p",)).join(known, F.col("_p") == F.col("_e"), "left")
    offset = F.coalesce("high_water", F.lit(0)) + F.col("_place")
    stamp = now_ns if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    given = F.col("ts_ns") if "ts_ns" in rows.columns else F.lit(None)
    heads = F.col("headers") if "headers" in rows.columns else no_headers()
    return record(placed.withColumn("_o", offset), topic=F.lit(topic), partition=F.col("_p"), offset=F.col("_o"), ts_ns=F.when(given != 0, given).otherwise(stamp), headers=heads)


def append_batch(topic: str, rows: DataFrame, partitions: int, ends: DataFrame, order: Sequence[str], now_ns: Column) -> DataFrame:
    """The same for a batch that stays together: all rows go to the first row's partition, with contiguous offsets."""
    first = rows.agg(F.min_by("key", F.struct(*order)).alias("_key")).select(partition_for("_key", partitions, F.lit(0)).alias("_p"))
    known = ends.where(F.col("topic") == topic).select(F.col("partition").alias("_e"), "high_water")
    # one row
    start = first.join(known, F.col("_p") == F.col("_e"), "left").select("_p", F.coalesce("high_water", F.lit(0)).alias("_h"))
    placed = arrival_index(rows, order, into="_place").join(F.broadcast(start), F.lit(True)).withColumn("_o", F.col("_h") + F.col("_place"))
    heads = F.col("headers") if "headers" in rows.columns else no_headers()
    return record(placed, topic=F.lit(topic), partition=F.col("_p"), offset=F.col("_o"), ts_ns=now_ns, headers=heads)


def connector_offsets(saved: DataFrame) -> DataFrame:
    """(connector, task, state): the last of each that a compacted topic of saved source offsets holds.

    Keys are ``connector/task``, values the source's own offset as JSON; a null value forgets.
    """
    key = F.decode("key", "UTF-8")
    last = saved.where(F.octet_length("key") > 0).groupBy("key").agg(F.max_by(F.struct("value"), "offset").alias("r")).where("r.value IS NOT NULL")
    return last.select(F.substring_index(key, "/", 1).alias("connector"), F.substring_index(key, "/", -1).cast("int").alias("task"), F.decode("r.value", "UTF-8").alias("state"))


def metrics(df: DataFrame) -> DataFrame:
    """Totals over a topic: records, bytes, keys, tombstones, partitions, newest time."""
    size = (F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
    return df.agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.count_distinct("key").alias("keys"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.count_distinct(*PART).alias("partitions"), F.max("ts_ns").alias("newest_ns"))


def allowed(names: DataFrame, scopes: Sequence[str], verb: str) -> DataFrame:
    """Rows of (topic) that a scope ``verb:name`` or ``verb:prefix*`` grants; the verb may be ``*``."""
    hit = F.lit(False)
    for s in scopes:
        v, _, name = s.partition(":")
        if v in (verb, "*"):
            hit = hit | (F.startswith("topic", F.lit(name[:-1])) if name.endswith("*") else F.col("topic") == name)
    return names.where(hit)


def copy(df: DataFrame, to: str, ends: DataFrame | None = None, now_ns: Column | None = None) -> DataFrame:
    """Records of a snapshot on another topic: same partitions, new dense offsets, new times."""
    place = F.row_number().over(Window.partitionBy("partition").orderBy("offset")) - 1
    out = df.withColumn("_o", place)
    if ends is not None:
        known = ends.where(F.col("topic") == to).select("partition", F.col("high_water").alias("_h"))
        out = out.join(known, "partition", "left").withColumn("_o", F.col("_o") + F.coalesce("_h", F.lit(0)))
    stamp = now_ns if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return record(out, topic=F.lit(to), offset=F.col("_o"), ts_ns=stamp)


def dump(df: DataFrame) -> DataFrame:
    """One JSON line for each record; bytes that are text as text, others in base 64 under ``*_b64``."""

    def both(c: str) -> list[Column]:
        ok = F.is_valid_utf8(F.col(c).cast("string"))
        return [F.when(ok, F.col(c).cast("string")).alias(c), F.when(~ok, F.base64(c)).alias(f"{c}_b64")]

    def head(h: Column) -> Column:
        ok = F.is_valid_utf8(h["value"].cast("string"))
        return F.struct(h["key"].alias("key"), F.when(ok, h["value"].cast("string")).alias("value"), F.when(~ok, F.base64(h["value"])).alias("value_b64"))

    heads = F.when(F.size("headers") > 0, F.transform("headers", head)).alias("headers")
    return df.select(F.to_json(F.struct("partition", "offset", F.col("ts_ns").alias("timestamp"), *both("key"), *both("value"), heads)).alias("value"))


DUMPED = "partition int, offset long, timestamp long, key string, key_b64 string, value string, value_b64 string, headers array<struct<key: string, value: string, value_b64: string>>"


def load(lines: DataFrame, topic: str) -> DataFrame:
    """Records of dumped JSON lines (column ``value``), with the partition, offset and time they have there."""
    d = lines.select(F.from_json("value", DUMPED).alias("d")).select("d.*")
    bytes_ = lambda c: F.coalesce(F.unbase64(F.col(f"{c}_b64")), F.encode(c, "UTF-8"))
    heads = F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:string,value_b64:string>>")), lambda h: F.struct(h["key"].alias("key"), F.coalesce(F.unbase64(h["value_b64"]), F.encode(h["value"], "UTF-8")).alias("value")))
    return record(d.withColumns({"_k": bytes_("key"), "_v": bytes_("value")}), topic=F.lit(topic), ts_ns=F.col("timestamp"), key=F.col("_k"), value=F.col("_v"), headers=heads)
