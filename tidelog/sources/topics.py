"""Topics as Parquet folders, one for each partition, with a catalog and committed group offsets."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import FIELDS, RECORD_SCHEMA
from tidelog.operators import log

# Fixed value: what a topic may be called.
NAME = re.compile(r"^[a-zA-Z0-9._-]{1,249}$")
OFFSETS = "group string, topic string, partition int, next_offset long, at long"


@dataclass(frozen=True)
class Topic:
    name: str
    partitions: int
    retention_ms: int = 0
    segment_bytes: int = 1 << 30


class Catalog:
    """A folder with topic descriptions, their records and the groups' offsets. Paths may be on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _write(self, path: str, data: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(data.encode())
        out.close()

    def _file(self, name: str) -> str:
        return f"{self.path}/topics/{name}.json"

    # -- topics
    def create(self, name: str, partitions: int, retention_ms: int = 0, segment_bytes: int = 1 << 30) -> Topic:
        if not NAME.match(name) or name in (".", "..") or partitions <= 0:
            raise ValueError("a topic needs a valid name and at least one partition")
        if self._exists(self._file(name)):
            raise ValueError(f"the topic exists: {name}")
        topic = Topic(name, partitions, retention_ms, segment_bytes)
        self._write(self._file(name), json.dumps(asdict(topic)))
        return topic

    def describe(self, name: str) -> Topic:
        if not self._exists(self._file(name)):
            raise KeyError(name)
        source = self._fs.open(self._path(self._file(name)))
        try:
            return Topic(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def list(self) -> list[Topic]:
        if not self._exists(f"{self.path}/topics"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/topics"))]
        return [self.describe(n.removesuffix(".json")) for n in sorted(names) if n.endswith(".json")]

    def update(self, name: str, retention_ms: int = 0, segment_bytes: int = 0) -> Topic:
        """What is not positive stays as it is."""
        old = self.describe(name)
        new = Topic(name, old.partitions, retention_ms if retention_ms > 0 else old.retention_ms, segment_bytes if segment_bytes > 0 else old.segment_bytes)
        self._write(self._file(name), json.dumps(asdict(new)))
        return new

    def delete(self, name: str) -> None:
        self.describe(name)
        for path in (self._file(name), self._records(name)):
            self._fs.delete(self._path(path), True)

    def stats(self) -> DataFrame:
        """(topics, partitions) of the catalog."""
        rows = [(t.name, t.partitions) for t in self.list()]
        return self.spark.createDataFrame(rows, "name string, partitions int").agg(F.count("*").alias("topics"), F.sum("partitions").alias("partitions"))

    # -- records
    def _records(self, name: str) -> str:
        return f"{self.path}/records/{name}"

    def read(self, *names: str) -> DataFrame:
        """Records of topics. Partition and offset predicates prune folders and row groups."""
        frames = []
        for name in names:
            self.describe(name)
            at = self._records(name)
            self._mend(name)
            if self._exists(at):
                frames.append(self.spark.read.schema(RECORD_SCHEMA).parquet(at).select(*FIELDS))
        return log.subscribe(*frames) if frames else self.spark.createDataFrame([], RECORD_SCHEMA)

    def stream(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(RECORD_SCHEMA)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(self._records(name)).select(*FIELDS)

    def write(self, name: str, records: DataFrame, mode: str = "append") -> None:
        """Records with their offsets; files are sorted by offset so that offset ranges skip row groups."""
        records.select(*FIELDS).sortWithinPartitions("partition", "offset").write.mode(mode).partitionBy("partition").parquet(self._records(name))

    def produce(self, name: str, rows: DataFrame, order: list[str], now_ns: Column | None = None, partitioner: log.Partitioner | None = None) -> None:
        topic = self.describe(name)
        self.write(name, log.append(name, rows, topic.partitions, log.high_water(self.read(name)), order, now_ns, partitioner))

    def poll(self, group: str, names: list[str], most: int, paused: tuple[tuple[str, int], ...] = ()) -> DataFrame:
        """The next records for a group, ``most`` at most, from its committed offsets; paused partitions keep theirs."""
        return log.poll(log.without(self.read(*names), paused), self.committed(group).select("topic", "partition", "next_offset"), most)

    def seek(self, group: str, names: list[str], to: str | int = "begin") -> None:
        """Commit the begin, the end or one offset for all partitions of topics."""
        ends = log.stats(self.read(*names)).select("topic", "partition", "log_start", "high_water")
        at = {"begin": F.col("log_start"), "end": F.col("high_water")}[to] if isinstance(to, str) else F.lit(to)
        self.commit(group, ends.select("topic", "partition", at.alias("next_offset")))

    def position(self, group: str, name: str) -> dict[int, int]:
        """A group's next offset in each partition of a topic; one row a partition."""
        return {r.partition: r.next_offset for r in self.committed(group).where(F.col("topic") == name).collect()}

    def total_lag(self, group: str) -> int:
        found = log.total_lag(self.lag(group)).first()
        return found.lag if found else 0

    # -- groups
    def _offsets(self) -> DataFrame:
        at = f"{self.path}/offsets"
        return self.spark.read.schema(OFFSETS).parquet(at) if self._exists(at) else self.spark.createDataFrame([], OFFSETS)

    def commit(self, group: str, offsets: DataFrame) -> None:
        """Append (topic, partition, next_offset) for a group; the latest commit of each counts, -1 forgets."""
        self._commit(offsets.select(F.lit(group).alias("group"), "topic", "partition", F.col("next_offset").cast("long")))

    def _commit(self, rows: DataFrame) -> None:
        # a number, not a join: commits are few and small
        at = self._offsets().agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("at")).first().at
        rows.withColumn("at", F.lit(at).cast("long")).coalesce(1).write.mode("append").parquet(f"{self.path}/offsets")

    def committed(self, group: str | None = None) -> DataFrame:
        rows = self._offsets()
        if group is not None:
            rows = rows.where(F.col("group") == group)
        return rows.groupBy("group", "topic", "partition").agg(F.max_by("next_offset", "at").alias("next_offset")).where("next_offset >= 0")

    def groups(self) -> list[str]:
        return sorted(r[0] for r in self.committed().select("group").distinct().collect())

    def lag(self, group: str) -> DataFrame:
        own = self.committed(group)
        topics = [r[0] for r in own.select("topic").distinct().collect()]
        return log.lag(log.high_water(self.read(*topics)), own).where("group IS NOT NULL") if topics else log.lag(self.spark.createDataFrame([], "topic string, partition int, high_water long"), own)

    def reset(self, group: str, to: str = "earliest") -> None:
        """Set all committed offsets of a group to the first or past the last record."""
        own = self.committed(group).select("topic", "partition")
        topics = [r[0] for r in own.select("topic").distinct().collect()]
        if not topics:
            return
        ends = log.stats(self.read(*topics)).select("topic", "partition", F.col("log_start" if to == "earliest" else "high_water").alias("next_offset"))
        self.commit(group, own.join(ends, ["topic", "partition"]))

    def rename(self, old: str, new: str) -> None:
        """One commit: the new group's offsets and the old one's end come in a single file."""
        own = self.committed(old).drop("group")
        both = own.select(F.lit(new).alias("group"), "*").unionByName(own.select(F.lit(old).alias("group"), "topic", "partition", F.lit(-1).cast("long").alias("next_offset")))
        self._commit(both)

    def forget(self, group: str) -> None:
        self.commit(group, self.committed(group).withColumn("next_offset", F.lit(-1)))

    # -- maintenance
    def rewrite(self, name: str, records: DataFrame) -> None:
        """Put other records in a topic's place: written beside it first, then swapped by two renames.

        The old ones go last. Where a swap was cut off between the renames, the next use of the topic ends it.
        """
        self.describe(name)
        beside, aside = (f"{self.path}/records/.{name}.{x}" for x in ("new", "old"))
        records.select(*FIELDS).sortWithinPartitions("partition", "offset").write.mode("overwrite").partitionBy("partition").parquet(beside)
        self._fs.delete(self._path(aside), True)
        self._fs.rename(self._path(self._records(name)), self._path(aside))
        self._fs.rename(self._path(beside), self._path(self._records(name)))
        self._fs.delete(self._path(aside), True)

    def _mend(self, name: str) -> None:
        beside, aside = (f"{self.path}/records/.{name}.{x}" for x in ("new", "old"))
        if not self._exists(self._records(name)) and self._exists(aside):
            whole = self._exists(f"{beside}/_SUCCESS")
            self._fs.rename(self._path(beside if whole else aside), self._path(self._records(name)))

    def compact(self, name: str, segment_records: int) -> None:
        df = self.read(name)
        self.rewrite(name, log.compact(df, log.segments(df, segment_records)))

    def expire(self, name: str, now_ns: int, segment_records: int) -> None:
        topic = self.describe(name)
        if topic.retention_ms > 0:
            df = self.read(name)
            self.rewrite(name, log.retain_time(df, now_ns - topic.retention_ms * 1_000_000, log.segments(df, segment_records)))
