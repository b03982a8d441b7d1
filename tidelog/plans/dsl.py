"""A lazy, immutable stream DSL over record tables.

A ``Topology`` names its topics' DataFrames. Each step adds to a logical plan; terminals register what
is to be written, and ``run`` hands each to Catalyst as a whole. The same steps run over batch tables
(every window closed at the end of input) and, where no global order is needed, over streams.

    top = Topology({"events": events})
    top.stream("events").filter("...").group_by_key().count().to("counts")
    counts = top.run()["counts"]
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators import aggregate, joins, log, ordered, stateless, windows
from tidelog.sources.topics import Catalog

Expr = Column | str


@dataclass
class Topology:
    """Sources by name; sinks and tables that its streams registered."""

    sources: Mapping[str, DataFrame]
    order: Sequence[str] = model.ARRIVAL
    timestamp: Column | None = None  # event time in nanoseconds; the record's own where None
    sinks: dict[str, list[DataFrame]] = field(default_factory=dict)
    tables: dict[str, KTable] = field(default_factory=dict)
    letters: list[DataFrame] = field(default_factory=list)
    actions: list[tuple[DataFrame, Callable[[DataFrame], None]]] = field(default_factory=list)
    catalog: Catalog | None = None
    group: str | None = None
    ends: DataFrame | None = None

    @classmethod
    def on(cls, catalog: Catalog, group: str, *topics: str, timestamp: Column | None = None) -> Topology:
        """A topology whose sources are a catalog's topics, from what the group has committed up to their present ends."""
        records = catalog.read(*topics)
        # a row a partition: fixed now, so that what is read later is what is committed
        ends = records.sparkSession.createDataFrame([tuple(r) for r in log.high_water(records).collect()], "topic string, partition int, high_water long")
        known = records.join(F.broadcast(ends), list(log.PART)).where(F.col("offset") < F.col("high_water")).drop("high_water")
        new = log.subscribe(known, starts=catalog.committed(group).select("topic", "partition", "next_offset"))
        return cls({t: new.where(F.col("topic") == t) for t in topics}, timestamp=timestamp, catalog=catalog, group=group, ends=ends)

    def stream(self, topic: str) -> Stream:
        df = self.sources[topic] if topic in self.sources else self._sunk(topic)
        if self.timestamp is not None:
            df = df.withColumn("ts_ns", self.timestamp.cast("long"))
            df = df.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
        return Stream(self, df)

    def _sunk(self, topic: str) -> DataFrame:
        first, *rest = self.sinks[topic]
        for df in rest:
            first = first.unionByName(df, allowMissingColumns=True)
        return first

    def table(self, topic: str, store: str | None = None) -> KTable:
        """The last value of each non-empty key of a topic; one table for a topic and store."""
        name = store or topic
        if name not in self.tables:
            self.tables[name] = KTable(self.stream(topic).df, self.order)
        return self.tables[name]

    def watermark(self, *topics: str) -> DataFrame:
        """The largest event time over topics, or over all sources."""
        frames = [self.stream(t).df.agg(F.max("ts_ns").alias("ts_ns")) for t in topics or self.sources]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.agg(F.max("ts_ns").alias("watermark_ns"))

    def run(self) -> dict[str, DataFrame]:
        """DataFrames of all sinks, and callbacks' batches handed over. Dead letters are under ``dead_letters``."""
        out = {name: self._sunk(name) for name in self.sinks}
        for df, call in self.actions:
            call(df)
        if self.letters:
            dead = self.letters[0]
            for df in self.letters[1:]:
                dead = dead.unionByName(df, allowMissingColumns=True)
            out["dead_letters"] = dead
        return out

    def run_on_catalog(self, partitions: int = 1, now_ns: Column | None = None, partitioner: log.Partitioner | None = None) -> None:
        """Write all sinks, tables and dead letters to their topics, which are made where there are none, then commit the group's offsets.

        A table's changes go to the topic ``NAME-changelog``. A run that fails before the commit is run again
        from the same offsets: what it wrote before comes twice, as everywhere where delivery is at least once.
        """
        catalog = self.catalog
        if catalog is None:
            raise ValueError("run_on_catalog needs a topology that Topology.on has made")
        out = self.run() | {f"{name}-changelog": t.changes for name, t in self.tables.items() if name not in self.sources}
        there = {t.name for t in catalog.list()}
        for name, df in out.items():
            if name not in there:
                catalog.create(name, partitions)
            catalog.produce(name, df, list(self.order), now_ns, partitioner)
        catalog.commit(self.group, self.ends.select("topic", "partition", F.col("high_water").alias("next_offset")))


@dataclass(frozen=True)
class KTable:
    changes: DataFrame
    order: Sequence[str] = model.ARRIVAL
    empty_keys: bool = False  # whether an empty key, though not a null one, is a key

    def final(self) -> DataFrame:
        rows = self.changes.where("key IS NOT NULL") if self.empty_keys else self.changes
        return aggregate.latest(rows, self.order, empty_keys=self.empty_keys)

    def get(self, key: bytes) -> DataFrame:
        """One key's last record: the key reaches the scan as a pushed filter."""
        return KTable(self.changes.where(F.col("key") == F.lit(key)), self.order, self.empty_keys).final()

    def range(self, low: bytes, high: bytes) -> DataFrame:
        """Keys from ``low`` up to, not with, ``high``."""
        return KTable(self.changes.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high))), self.order, self.empty_keys).final()

    def partitions(self) -> DataFrame:
        return self.changes.select("partition").distinct()


@dataclass(frozen=True)
class Stream:
    top: Topology
    df: DataFrame

    def _next(self, df: DataFrame) -> Stream:
        return replace(self, df=df)

    # -- one record at a time
    def filter(self, p: Expr) -> Stream:
        return self._next(stateless.filter_(self.df, p))

    def filter_not(self, p: Expr) -> Stream:
        return self._next(stateless.filter_not(self.df, p))

    def map(self, columns: dict[str, Expr]) -> Stream:
        return self._next(stateless.map_(self.df, columns))

    def map_values(self, value: Expr) -> Stream:
        return self._next(stateless.map_values(self.df, value))

    def map_key_value(self, key: Expr, value: Expr) -> Stream:
        return self._next(stateless.map_key_value(self.df, key, value))

    def select_key(self, key: Expr) -> Stream:
        return self._next(stateless.select_key(self.df, key))

    def flat_map(self, values: Expr) -> Stream:
        return self._next(stateless.flat_map(self.df, values))

    def peek(self, name: str, *metrics: Column) -> Stream:
        return self._next(stateless.peek(self.df, name, *metrics))

    tap = peek

    def branch(self, *predicates: Expr) -> list[Stream]:
        return [self._next(df) for df in stateless.branch(self.df, *predicates)]

    def route(self, rules: Sequence[stateless.Rule]) -> dict[str, Stream]:
        """A stream for each target that any rule names, from one scan with a target column."""
        routed = stateless.route(self.df, rules)
        names = sorted({t for r in rules for t in r.targets})
        return {n: self._next(routed.where(F.col("target") == n).drop("target")) for n in names}

    def transform(self, columns: dict[str, Expr], keep: Expr | None = None, error: Expr | None = None) -> Stream:
        return self._next(stateless.transform(self.df, columns, keep, error))

    def attempt(self, value: Expr, error: Expr) -> Stream:
        """Map values; records whose new value is null are dead letters with ``error`` as a header."""
        made = self.df.withColumn("_made", stateless.column(value))
        bad = made.where("_made IS NULL").withColumn("headers", model.with_header(model.ERROR, F.encode(stateless.column(error), "UTF-8"))).drop("_made")
        self.top.letters.append(bad)
        return self._next(made.where("_made IS NOT NULL").withColumn("value", F.col("_made")).drop("_made"))

    def apply(self, f: Callable[[bytes | None], bytes | None], on_error: str = "dead_letter") -> Stream:
        """Map values by any Python function. Where it raises: dead_letter (with the error as a header), skip or fail."""
        made = stateless.applied(self.df, f)
        if on_error == "fail":
            made = made.where(F.when(F.col("_made.error").isNotNull(), F.raise_error(F.col("_made.error")).cast("boolean")).otherwise(True))
        elif on_error == "dead_letter":
            bad = made.where("_made.error IS NOT NULL").withColumn("headers", model.with_header(model.ERROR, F.encode("_made.error", "UTF-8"))).drop("_made")
            self.top.letters.append(bad)
        elif on_error != "skip":
            raise ValueError("on_error is dead_letter, skip or fail")
        return self._next(made.where("_made.error IS NULL").withColumn("value", F.col("_made.value")).drop("_made"))

    # -- arrival order
    def take(self, n: int) -> Stream:
        return self._next(ordered.take(self.df, n, self.top.order))

    def skip(self, n: int) -> Stream:
        return self._next(ordered.skip(self.df, n, self.top.order))

    def sample(self, n: int) -> Stream:
        return self._next(ordered.sample_nth(self.df, n, self.top.order))

    def distinct(self, key: Column | str = "key") -> Stream:
        return self._next(ordered.distinct_first(self.df, key, self.top.order))

    def throttle(self, per_second: float) -> Stream:
        return self._next(ordered.throttle(self.df, per_second, order=self.top.order))

    # -- grouping and joining
    def group_by_key(self, scope: str = "global") -> Grouped:
        return Grouped(self, F.col("key"), ("partition",) if scope == "partition" else ())

    def group_by(self, key: Expr, scope: str = "global") -> Grouped:
        return self.select_key(key).group_by_key(scope)

    def join(self, other: Stream, window_ns: int) -> Joined:
        return Joined(self.top, joins.interval_join(self.df, other.df, window_ns, "inner"))

    def left_join(self, other: Stream, window_ns: int) -> Joined:
        return Joined(self.top, joins.interval_join(self.df, other.df, window_ns, "left"))

    def outer_join(self, other: Stream, window_ns: int) -> Joined:
        return Joined(self.top, joins.interval_join(self.df, other.df, window_ns, "full"))

    def join_table(self, table: KTable, how: str = "left", as_of: bool = False) -> Stream:
        """``table_value`` and ``hit`` beside each record: the table's final values, or those at the record's time."""
        if not as_of:
            return self._next(joins.table_join(self.df, table.final(), how))
        out = joins.asof_join(self.df, table.changes, ("value",)).withColumn("hit", F.col("table_value").isNotNull())
        return self._next({"left": out, "inner": out.where("hit"), "anti": out.where("NOT hit")}[how])

    # -- terminals
    def through(self, topic: str) -> Stream:
        """Write to a topic and go on from it."""
        self.to(topic)
        return self._next(self.df)

    def to(self, topic: str) -> None:
        self.top.sinks.setdefault(topic, []).append(self.df)

    def to_table(self, store: str) -> KTable:
        self.top.tables[store] = KTable(self.df, self.top.order, empty_keys=True)
        return self.top.tables[store]

    def for_each(self, call: Callable[[DataFrame], None]) -> None:
        """Hand the whole DataFrame to a function when the topology runs."""
        self.top.actions.append((self.df, call))

    def for_each_row(self, call: Callable[[object], None]) -> None:
        self.top.actions.append((self.df, lambda df: df.foreach(call)))

    def lines(self, prefix: str = "") -> DataFrame:
        """What ``print`` shows, as a column of lines."""
        shown = lambda c: F.coalesce(F.decode(c, "UTF-8"), F.lit(""))
        return self.df.select(F.format_string('%s offset=%d key="%s" value="%s"', F.lit(prefix), "offset", shown("key"), shown("value")).alias("line"))

    def print(self, prefix: str = "", n: int = 20) -> None:
        for r in Stream(self.top, self.df.orderBy(*self.top.order).limit(n)).lines(prefix).collect():
            print(r.line)


@dataclass(frozen=True)
class Grouped:
    stream: Stream
    key: Column
    scope: tuple[str, ...] = ()

    def _key(self) -> Column:
        """The key, with the partition in front where state is kept by partition."""
        own = model.group_key(self.key)
        return F.concat(F.encode(F.concat(F.col("partition").cast("string"), F.lit("/")), "UTF-8"), own) if self.scope else own

    def _running(self, how: str, value: Expr | None, stretch: int | None) -> Stream:
        v = stateless.column(value) if value is not None else None
        out = aggregate.running(self.stream.df, how, v, self._key(), self.stream.top.order, "agg", stretch)
        return self.stream._next(out)

    # changelogs: a row for each record, with its key's aggregate up to it in ``agg``
    def count(self, stretch: int | None = None) -> Stream:
        return self._running("count", None, stretch)

    def sum(self, value: Expr, stretch: int | None = None) -> Stream:
        return self._running("sum", value, stretch)

    def max(self, value: Expr, stretch: int | None = None) -> Stream:
        return self._running("max", value, stretch)

    def min(self, value: Expr, stretch: int | None = None) -> Stream:
        return self._running("min", value, stretch)

    def reduce(self, value: Expr, merge: Callable[[Column, Column], Column]) -> Stream:
        return self.stream._next(aggregate.running_reduce(self.stream.df, stateless.column(value), merge, self._key(), self.stream.top.order))

    def reduce_python(self, value: Expr, merge: Callable[[object, object], object], result: str) -> Stream:
        """By any Python function of (accumulator, value)."""
        return self.stream._next(aggregate.running_reduce_python(self.stream.df, stateless.column(value), merge, result, self._key(), self.stream.top.order))

    def aggregate_changes(self, value: Expr, step: Callable[[object, object], object], start: object, result: str) -> Stream:
        """The same from ``start``."""
        return self.stream._next(aggregate.running_fold(self.stream.df, stateless.column(value), step, result, self._key(), self.stream.top.order, start=start))

    # tables: a row for each key
    def final(self, how: str, value: Expr | None = None) -> DataFrame:
        return aggregate.final(self.stream.df, how, stateless.column(value) if value is not None else None, self._key())

    def final_reduce(self, value: Expr, merge: Callable[[Column, Column], Column]) -> DataFrame:
        return aggregate.reduce_(self.stream.df, stateless.column(value), merge, self._key(), self.stream.top.order)

    def aggregate(self, value: Expr, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        return aggregate.fold(self.stream.df, stateless.column(value), start, step, self._key(), self.stream.top.order)

    def aggregate_python(self, step: Callable[[object, dict], object], result: str) -> DataFrame:
        return aggregate.fold_python(self.stream.df, step, result, self._key(), self.stream.top.order)

    # windows
    def _replayed(self, late: str, aggs: Sequence[Column] | None, size_ns: int, advance_ns: int | None) -> DataFrame | None:
        """Each partition's emissions in the order of its offsets, where late records are to be emitted again."""
        if late not in ("drop", "reemit"):
            raise ValueError("late is drop or reemit")
        if late == "drop":
            return None
        if aggs:
            raise ValueError("emissions are counted anew for counts alone")
        return windows.replay(self.stream.df.withColumn("key", self._key()), size_ns, advance_ns)

    def tumbling(self, size_ns: int, aggs: Sequence[Column] | None = None, late: str = "drop") -> DataFrame:
        again = self._replayed(late, aggs, size_ns, None)
        return again if again is not None else windows.tumbling(self.stream.df, size_ns, aggs, self._key())

    def hopping(self, size_ns: int, advance_ns: int, aggs: Sequence[Column] | None = None, late: str = "drop") -> DataFrame:
        again = self._replayed(late, aggs, size_ns, advance_ns)
        return again if again is not None else windows.hopping(self.stream.df, size_ns, advance_ns, aggs, self._key())

    def session(self, gap_ns: int, aggs: Sequence[Column] | None = None) -> DataFrame:
        return windows.session(self.stream.df, gap_ns, aggs, self._key())


@dataclass(frozen=True)
class Joined:
    """Pairs (left, right); a side is null where it had no match."""

    top: Topology
    pairs: DataFrame

    def select(self, columns: dict[str, Expr]) -> Stream:
        return Stream(self.top, self.pairs.select(*[stateless.column(e).alias(k) for k, e in columns.items()]))

    def to(self, topic: str, columns: dict[str, Expr]) -> None:
        self.select(columns).to(topic)
