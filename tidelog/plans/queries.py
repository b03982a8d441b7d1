"""One query for each operator, over the driver's tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import model, registry
from tidelog.functions import routing
from tidelog.operators import aggregate, joins, log, ordered, stateless, windows
from tidelog.plans.dsl import Stream, Topology

HOUR = 3_600_000_000_000
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


# -- the events table as a topic
def events(spark: SparkSession, d: str, partitions: int = 1) -> DataFrame:
    """Key: the user; value: the properties; one header, the type. Offsets follow the ids."""
    e = spark.read.parquet(f"{d}/events.parquet")
    micros = F.unix_micros(e["ts"].cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    heads = F.array(F.struct(F.lit("event-type").alias("key"), F.encode("event_type", "UTF-8").alias("value")))
    return e.select(
        F.lit("events").alias("topic"),
        (F.col("event_id") % partitions).cast("int").alias("partition"),
        F.floor(F.col("event_id") / partitions).cast("long").alias("offset"),
        (micros * 1000).alias("ts_ns"),
        F.timestamp_micros(micros).alias("ts"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.encode("props", "UTF-8").alias("value"),
        heads.alias("headers"),
    )


def kind() -> Column:
    return model.text(model.header("event-type"))


def user() -> Column:
    return model.text("key").cast("long")


def number() -> Column:
    return F.regexp_extract(model.text("value"), r"(-?\d+)", 1).cast("long")



def is_type(name: str) -> Column:
    return kind() == name


def stream(spark: SparkSession, d: str, partitions: int = 1) -> Stream:
    return Topology({"events": events(spark, d, partitions)}, ("offset",) if partitions == 1 else model.ARRIVAL).stream("events")


def view(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


E = "SELECT event_id AS off, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, props, CAST(regexp_extract(props, '(-?\\d+)', 1) AS BIGINT) AS num FROM events"


def with_e(sql: str) -> str:
    return f"WITH e AS ({E}) {sql}"


# -- one record at a time
@query(with_e("SELECT off, user_id FROM e WHERE event_type = 'purchase'"))
def filter(spark, d):
    return view(stream(spark, d).filter(is_type("purchase")).df, off="offset", user_id=user())


@query(with_e("SELECT off, user_id FROM e WHERE event_type <> 'view'"))
def filter_not(spark, d):
    return view(stream(spark, d).filter_not(is_type("view")).df, off="offset", user_id=user())


@query(with_e("SELECT off + 1000 AS off, 'u' || user_id AS k, upper(event_type) AS v FROM e"))
def map(spark, d):
    s = stream(spark, d).map({"offset": F.col("offset") + 1000, "key": F.concat(F.lit(b"u"), "key"), "value": F.encode(F.upper(kind()), "UTF-8")})
    return view(s.df, off="offset", k=model.text("key"), v=model.text("value"))


@query(with_e("SELECT off, upper(props) AS v FROM e"))
def map_values(spark, d):
    return view(stream(spark, d).map_values(F.encode(F.upper(model.text("value")), "UTF-8")).df, off="offset", v=model.text("value"))


@query(with_e("SELECT off, event_type AS k, CAST(user_id AS VARCHAR) AS v FROM e"))
def map_key_value(spark, d):
    return view(stream(spark, d).map_key_value(model.header("event-type"), F.col("key")).df, off="offset", k=model.text("key"), v=model.text("value"))


@query(with_e("SELECT off, event_type AS k FROM e"))
def select_key(spark, d):
    return view(stream(spark, d).select_key(model.header("event-type")).df, off="offset", k=model.text("key"))


@query(with_e("SELECT off, unnest(string_split(event_type, 'i')) AS v FROM e"))
def flat_map(spark, d):
    parts = F.transform(F.split(kind(), "i", -1), lambda x: F.encode(x, "UTF-8"))
    return view(stream(spark, d).flat_map(parts).df, off="offset", v=model.text("value"))


@query(with_e("SELECT off, CASE WHEN event_type = 'purchase' THEN 'buyers' WHEN user_id % 2 = 0 THEN 'even' END AS branch FROM e WHERE event_type = 'purchase' OR user_id % 2 = 0"))
def branch(spark, d):
    a, b = stream(spark, d).branch(is_type("purchase"), user() % 2 == 0)
    return view(a.df, off="offset", branch=F.lit("buyers")).unionByName(view(b.df, off="offset", branch=F.lit("even")))


RULES = [
    stateless.Rule(stateless.Match(header_equals={"event-type": "purchase"}), ["orders", "audit"]),
    stateless.Rule(stateless.Match(key_prefix="1"), ["audit", "ones"]),
    stateless.Rule(stateless.Match(header_exists=["event-type"], key_regex="^.{1,2}$"), ["short"]),
]


@query(with_e("""SELECT off, target FROM e, unnest(list_distinct(list_concat(
    CASE WHEN event_type = 'purchase' THEN ['orders', 'audit'] ELSE CAST([] AS VARCHAR[]) END,
    list_concat(CASE WHEN starts_with(CAST(user_id AS VARCHAR), '1') THEN ['audit', 'ones'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN length(CAST(user_id AS VARCHAR)) <= 2 THEN ['short'] ELSE CAST([] AS VARCHAR[]) END)))) AS t(target)"""))
def router_fanout(spark, d):
    return view(stateless.route(events(spark, d), RULES), off="offset", target="target")


@query(with_e("SELECT off FROM e WHERE starts_with(CAST(user_id AS VARCHAR), '1') AND event_type IN ('click', 'error')"))
def router_match_any(spark, d):
    m = stateless.Match(key_prefix="1", any=[stateless.Match(header_equals={"event-type": t}) for t in ("click", "error")])
    return view(stream(spark, d).filter(m.column()).df, off="offset")


@query(with_e("SELECT off, upper(event_type) AS v FROM e WHERE user_id % 3 <> 0"))
def transform_drop(spark, d):
    return view(stream(spark, d).transform({"value": F.encode(F.upper(kind()), "UTF-8")}, keep=user() % 3 != 0).df, off="offset", v=model.text("value"))


@query(with_e("SELECT off, CASE WHEN num % 10 <> 0 THEN 'ok' ELSE 'dead' END AS state, CASE WHEN num % 10 <> 0 THEN CAST(100 // (num % 10) AS VARCHAR) ELSE 'no tenth of ' || num END AS v FROM e"))
def dead_letters(spark, d):
    top = Topology({"events": events(spark, d)})
    s = top.stream("events").attempt(F.encode(F.floor(100 / F.nullif(number() % 10, F.lit(0))).cast("string"), "UTF-8"), F.concat(F.lit("no tenth of "), number().cast("string")))
    s.to("ok")
    out = top.run()
    return view(out["ok"], off="offset", state=F.lit("ok"), v=model.text("value")).unionByName(view(out["dead_letters"], off="offset", state=F.lit("dead"), v=model.text(model.header(model.ERROR))))


@query(with_e("SELECT off, CASE WHEN num % 10 <> 0 THEN 'ok' ELSE 'dead' END AS state, CASE WHEN num % 10 <> 0 THEN CAST(100 // (num % 10) AS VARCHAR) ELSE 'ZeroDivisionError' END AS v FROM e"))
def error_handler(spark, d):
    def tenth(value: bytes) -> bytes:
        import re

        return str(100 // (int(re.search(rb"-?\d+", value)[0]) % 10)).encode()

    top = Topology({"events": events(spark, d)})
    top.stream("events").apply(tenth).to("ok")
    out = top.run()
    error = F.substring_index(model.text(model.header(model.ERROR)), ":", 1)
    return view(out["ok"], off="offset", state=F.lit("ok"), v=model.text("value")).unionByName(view(out["dead_letters"], off="offset", state=F.lit("dead"), v=error))


@query(with_e("SELECT off FROM e"))
def peek(spark, d):
    return view(stream(spark, d).peek("seen").df, off="offset")


@query(with_e("SELECT off, event_type || '!' AS v FROM e WHERE event_type = 'signup'"))
def through(spark, d):
    top = Topology({"events": events(spark, d)})
    top.stream("events").filter(is_type("signup")).map_values(model.header("event-type")).through("mid").map_values(F.concat("value", F.lit(b"!"))).to("out")
    return view(top.run()["out"], off="offset", v=model.text("value"))


@query(with_e("SELECT off, 'DBG offset=' || off || ' key=\"' || user_id || '\" value=\"' || event_type || '\"' AS line FROM e WHERE event_type = 'error'"))
def print_lines(spark, d):
    s = stream(spark, d).filter(is_type("error")).map_values(model.header("event-type"))
    return view(s.lines("DBG").withColumn("off", F.regexp_extract("line", r"offset=(\d+)", 1).cast("long")), off="off", line="line")


# -- arrival order
@query(with_e("SELECT off FROM e ORDER BY off LIMIT 25"))
def take(spark, d):
    return view(stream(spark, d).take(25).df, off="offset")


@query(with_e("SELECT off FROM e ORDER BY ts_ns, off OFFSET 100"))
def skip(spark, d):
    return view(ordered.skip(events(spark, d), 100, ("ts_ns", "offset")), off="offset")


@query(with_e("SELECT off FROM (SELECT off, row_number() OVER (ORDER BY ts_ns, off) - 1 AS i FROM e) WHERE i % 7 = 0"))
def sample_nth(spark, d):
    return view(ordered.sample_nth(events(spark, d), 7, ("ts_ns", "offset")), off="offset")


@query(with_e("SELECT user_id, min(off) AS off FROM e GROUP BY user_id"))
def distinct_first(spark, d):
    return view(stream(spark, d).distinct().df, user_id=user(), off="offset")


@query(f"""WITH RECURSIVE e AS ({E}), q AS (SELECT row_number() OVER (ORDER BY off) AS i, off, ts_ns // 10000 AS ts FROM e),
r(i, off, ts, tokens, passed) AS (SELECT i, off, ts, CAST(1.0 AS DOUBLE), true FROM q WHERE i = 1
  UNION ALL SELECT i, off, ts, full_ - CASE WHEN full_ >= 1 THEN 1.0 ELSE 0.0 END, full_ >= 1
  FROM (SELECT q.i, q.off, greatest(q.ts, r.ts) AS ts, least(CAST(2.0 AS DOUBLE), r.tokens + CAST(greatest(q.ts - r.ts, 0) AS DOUBLE) / 1e9 * 2.0) AS full_ FROM r JOIN q ON q.i = r.i + 1))
SELECT off FROM r WHERE passed""")
def throttle(spark, d):
    # time runs ten thousand times as fast, so that records are bursts
    fast = events(spark, d).withColumn("ts_ns", F.floor(F.col("ts_ns") / 10_000).cast("long"))
    return view(ordered.throttle(fast, 2.0, order=("offset",)), off="offset")


@query(with_e("""SELECT off FROM (SELECT off, (off * 7919) % 1000 AS seq, max((off * 7919) % 1000) OVER (PARTITION BY event_type ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e) WHERE m IS NULL OR seq > m"""))
def idempotent_dedup(spark, d):
    return view(ordered.idempotent(events(spark, d), kind(), (F.col("offset") * 7919) % 1000, ("offset",), stretch=20_000), off="offset")


# -- keyed aggregation
@query(with_e("SELECT user_id, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY user_id"))
def group_count(spark, d):
    return view(stream(spark, d).filter(is_type("purchase")).group_by_key().final("count"), user_id=user(), n="agg")


@query(with_e("SELECT off, count(*) OVER (PARTITION BY user_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS n FROM e"))
def running_count(spark, d):
    return view(stream(spark, d).group_by_key().count(stretch=20_000).df, off="offset", n="agg")


@query(with_e("SELECT off, CAST(sum(num) OVER (PARTITION BY event_type ORDER BY off ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM e"))
def running_sum(spark, d):
    return view(stream(spark, d).group_by(model.header("event-type")).sum(number(), stretch=20_000).df, off="offset", s="agg")


@query(with_e("SELECT off, max(num) OVER (PARTITION BY user_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS m FROM e"))
def reduce_max(spark, d):
    return view(stream(spark, d).group_by_key().max(number()).df, off="offset", m="agg")


@query(with_e("SELECT user_id, string_agg(event_type, '|' ORDER BY off) AS v FROM e GROUP BY user_id"))
def reduce_concat(spark, d):
    return view(stream(spark, d).group_by_key().final_reduce(kind(), lambda a, b: F.concat(a, F.lit("|"), b)), user_id=user(), v="agg")


@query(with_e("SELECT user_id, CAST(sum(num * num) + 7 AS BIGINT) AS v FROM e GROUP BY user_id"))
def aggregate_fold(spark, d):
    return view(stream(spark, d).group_by_key().aggregate(number(), F.lit(7).cast("long"), lambda a, x: a + x * x), user_id=user(), v="agg")


@query(with_e("SELECT off, string_agg(substr(event_type, 1, 1), '') OVER (PARTITION BY user_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS v FROM e"))
def running_concat(spark, d):
    return view(stream(spark, d).group_by_key().reduce(F.substring(kind(), 1, 1), lambda a, b: F.concat(a, b)).df, off="offset", v="agg")


@query(with_e("SELECT off, CAST(7 + sum(num * num) OVER (PARTITION BY user_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM e"))
def aggregate_changelog(spark, d):
    return view(stream(spark, d).group_by_key().aggregate_changes(number(), lambda a, x: a + x * x, 7, "long").df, off="offset", v="agg")


@query(with_e("SELECT user_id, off FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS r FROM e WHERE event_type <> 'view') WHERE r = 1"))
def to_table(spark, d):
    return view(stream(spark, d).filter_not(is_type("view")).to_table("last").final(), user_id=user(), off="offset")


@query(with_e("SELECT event_type, CAST(sum(num) AS BIGINT) AS s FROM e GROUP BY event_type"))
def final_sum(spark, d):
    return view(stream(spark, d).group_by(model.header("event-type")).final("sum", number()), event_type=model.text("key"), s="agg")


@query(with_e("SELECT off % 4 AS part, user_id, count(*) AS n FROM e GROUP BY ALL"))
def partition_scoped_count(spark, d):
    out = stream(spark, d, 4).group_by_key("partition").final("count")
    both = F.split(model.text("key"), "/")
    return view(out, part=both[0].cast("long"), user_id=both[1].cast("long"), n="agg")


@query(with_e("SELECT user_id, off, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS r FROM e) WHERE r = 1"))
def ktable_latest(spark, d):
    return view(Topology({"events": events(spark, d)}, ("offset",)).table("events").final(), user_id=user(), off="offset", event_type=kind())


@query(with_e("SELECT user_id, off FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS r FROM e) WHERE r = 1 AND event_type <> 'error'"))
def ktable_tombstone(spark, d):
    df = events(spark, d).withColumn("value", F.when(~is_type("error"), F.col("value")))
    return view(Topology({"events": df}, ("offset",)).table("events").final(), user_id=user(), off="offset")


@query(with_e("SELECT off, event_type FROM e WHERE user_id = 7 ORDER BY off DESC LIMIT 1"))
def ktable_get(spark, d):
    return view(Topology({"events": events(spark, d)}, ("offset",)).table("events").get(b"7"), off="offset", event_type=kind())


@query(with_e("SELECT user_id, max(off) AS off FROM e WHERE CAST(user_id AS VARCHAR) >= '2' AND CAST(user_id AS VARCHAR) < '5' GROUP BY user_id"))
def ktable_range(spark, d):
    return view(Topology({"events": events(spark, d)}, ("offset",)).table("events").range(b"2", b"5"), user_id=user(), off="offset")


@query(with_e("SELECT off, user_id FROM e WHERE event_type = 'click'"))
def for_each(spark, d):
    seen = []
    top = Topology({"events": events(spark, d)})
    top.stream("events").filter(is_type("click")).for_each(seen.append)
    top.run()
    return view(seen[0], off="offset", user_id=user())


# -- windows
@query(with_e(f"SELECT user_id, ts_ns // {HOUR} * {HOUR} AS start_ns, (ts_ns // {HOUR} + 1) * {HOUR} AS end_ns, count(*) AS n FROM e GROUP BY ALL"))
def tumbling_count(spark, d):
    return view(stream(spark, d).group_by_key().tumbling(HOUR), user_id=user(), start_ns="window_start_ns", end_ns="window_end_ns", n="count")


@query(with_e(f"SELECT event_type, w AS start_ns, count(*) AS n FROM e, unnest(range((ts_ns // {HOUR} - 2) * {HOUR}, (ts_ns // {HOUR} + 1) * {HOUR}, {HOUR})) AS t(w) WHERE w > ts_ns - {3 * HOUR} AND w <= ts_ns GROUP BY ALL"))
def hopping_count(spark, d):
    return view(stream(spark, d).group_by(model.header("event-type")).hopping(3 * HOUR, HOUR), event_type=model.text("key"), start_ns="window_start_ns", n="count")


@query(with_e(f"SELECT user_id, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM e)) GROUP BY user_id, s"))
def session_count(spark, d):
    return view(stream(spark, d).group_by_key().session(6 * HOUR), user_id=user(), start_ns="window_start_ns", end_ns="window_end_ns", n="count")


SHUFFLED = "SELECT row_number() OVER (ORDER BY off + (off * 7919) % 50, off) - 1 AS i, ts_ns, event_type FROM e"




def replay_sql(size: int, advance: int) -> str:
    """Emissions by their number: closings of a window before a record are its place less the first place at which the
    watermark has reached the window's end, less the window's own records since."""
    return f"""WITH e AS ({E}), q AS ({SHUFFLED}),
p AS (SELECT i, event_type, ts_ns, ts_ns // {advance} * {advance} AS own, max(ts_ns) OVER (ORDER BY i) AS wm FROM q),
h AS (SELECT i, event_type, w FROM p, unnest(range(own - {(size - 1) // advance * advance}, own + {advance}, {advance})) AS t(w) WHERE w > ts_ns - {size} AND w >= 0),
marks AS (SELECT wm, min(i) AS at FROM p GROUP BY wm),
reach AS (SELECT d.w, m.at AS f FROM (SELECT DISTINCT w, w + {size} AS t FROM h) d ASOF LEFT JOIN marks m ON d.t <= m.wm),
late AS (SELECT p.own, p.i, count(*) OVER (PARTITION BY p.own ORDER BY p.i) AS n FROM p JOIN reach ON p.own = reach.w WHERE p.i >= reach.f),
a AS (SELECT h.i, h.event_type, h.w, r.f, coalesce(l.n, 0) AS n, coalesce(x.n, 0) AS most FROM h JOIN reach r ON h.w = r.w
  ASOF LEFT JOIN late l ON h.w = l.own AND h.i > l.i LEFT JOIN (SELECT own, max(n) AS n FROM late GROUP BY own) x ON x.own = h.w)
SELECT event_type, w AS start_ns, chunk AS emission, count(*) AS n FROM (
  SELECT event_type, w, CASE WHEN i <= f THEN 0 ELSE i - f - n END AS chunk, (SELECT count(*) FROM p) - f - most AS closings FROM a WHERE f IS NOT NULL) WHERE chunk < closings GROUP BY ALL"""


@query(replay_sql(HOUR, HOUR))
def tumbling_replay(spark, d):
    moved = ordered.arrival_index(events(spark, d).withColumn("o", F.col("offset") + (F.col("offset") * 7919) % 50), ("o", "offset"), into="i")
    df = moved.withColumn("offset", F.col("i")).withColumn("key", model.header("event-type"))
    return view(windows.replay(df, HOUR), event_type=model.text("key"), start_ns="window_start_ns", emission="emission", n="count")


@query(replay_sql(3 * HOUR, HOUR))
def hopping_replay(spark, d):
    moved = ordered.arrival_index(events(spark, d).withColumn("o", F.col("offset") + (F.col("offset") * 7919) % 50), ("o", "offset"), into="i")
    df = moved.withColumn("offset", F.col("i")).withColumn("key", model.header("event-type"))
    return view(windows.replay(df, 3 * HOUR, HOUR), event_type=model.text("key"), start_ns="window_start_ns", emission="emission", n="count")


@query(with_e(f"SELECT user_id, lpad(upper(to_hex(ts_ns // {HOUR} * {HOUR})), 16, '0') AS start_hex, (ts_ns // {HOUR} + 1) * {HOUR} AS end_ns, (ts_ns // {HOUR} + 1) * {HOUR} AS ts_ns, count(*) AS n FROM e GROUP BY ALL"))
def window_headers(spark, d):
    out = windows.emitted(stream(spark, d).group_by_key().tumbling(HOUR))
    return view(out, user_id=user(), start_hex=F.hex(model.header(model.WINDOW_START)), end_ns=model.decode_be64(model.header(model.WINDOW_END)), ts_ns="ts_ns", n=model.decode_be64("value"))


@query(with_e(f"SELECT t.at AS at_ns, (SELECT count(*) FROM e WHERE e.ts_ns <= t.at) AS records FROM (SELECT unnest(range((min(ts_ns) + {24 * HOUR - 1}) // {24 * HOUR} * {24 * HOUR}, max(ts_ns) // {24 * HOUR} * {24 * HOUR} + 1, {24 * HOUR})) AS at FROM e) t"))
def punctuate(spark, d):
    return view(windows.punctuations(events(spark, d), 24 * HOUR), at_ns="at_ns", records="records")


@query(with_e(f"SELECT greatest(max(ts_ns), CAST({4 * 10**18} AS BIGINT)) AS watermark_ns FROM e"))
def idle_watermark(spark, d):
    return windows.watermark(events(spark, d), idle_ns=HOUR, last_arrival_ns=4 * 10**18 - 2 * HOUR, now_ns=4 * 10**18)


@query(with_e(f"SELECT user_id, num * {HOUR} // {5 * HOUR} * {5 * HOUR} AS start_ns, count(*) AS n FROM e GROUP BY ALL"))
def timestamp_extractor(spark, d):
    top = Topology({"events": events(spark, d)}, ("offset",), timestamp=number() * HOUR)
    return view(top.stream("events").group_by_key().tumbling(5 * HOUR), user_id=user(), start_ns="window_start_ns", n="count")


@query(with_e(f"SELECT user_id, ts_ns // {24 * HOUR} * {24 * HOUR} AS start_ns, count(*) AS n FROM e WHERE (ts_ns // {24 * HOUR} + 1) * {24 * HOUR} <= (SELECT max(ts_ns) FROM e) GROUP BY ALL"))
def closed_windows(spark, d):
    made = stream(spark, d).group_by_key().tumbling(24 * HOUR)
    return view(windows.closed(made, windows.watermark(events(spark, d))), user_id=user(), start_ns="window_start_ns", n="count")


# -- joins
def sides(spark, d):
    e = events(spark, d)
    return e.where(is_type("view")), e.where(is_type("purchase"))


NEAR = f"l.user_id = r.user_id AND abs(l.ts_ns - r.ts_ns) <= {HOUR}"
LR = "(SELECT * FROM e WHERE event_type = 'view') l {} JOIN (SELECT * FROM e WHERE event_type = 'purchase') r ON " + NEAR


@query(with_e("SELECT l.off AS loff, r.off AS roff FROM " + LR.format("")))
def interval_join(spark, d):
    return view(joins.interval_join(*sides(spark, d), HOUR), loff="left.offset", roff="right.offset")


@query(with_e("SELECT l.off AS loff, r.off AS roff FROM " + LR.format("LEFT")))
def interval_left_join(spark, d):
    return view(joins.interval_join(*sides(spark, d), HOUR, "left"), loff="left.offset", roff="right.offset")


@query(with_e("SELECT l.off AS loff, r.off AS roff FROM " + LR.format("FULL")))
def interval_outer_join(spark, d):
    return view(joins.interval_join(*sides(spark, d), HOUR, "full"), loff="left.offset", roff="right.offset")


def customers(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.lit("customers").alias("topic"), F.lit(0).alias("partition"), F.col("c_custkey").alias("offset"), F.lit(0).cast("long").alias("ts_ns"), F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("key"), F.when(F.col("c_mktsegment") != "BUILDING", F.encode("c_mktsegment", "UTF-8")).alias("value"))


@query(with_e("SELECT off, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, coalesce(c_mktsegment <> 'BUILDING', false) AS hit FROM e LEFT JOIN customer ON user_id = c_custkey"))
def table_join(spark, d):
    table = Topology({"c": customers(spark, d)}, ("offset",)).table("c")
    return view(stream(spark, d).join_table(table).df, off="offset", segment=model.text("table_value"), hit="hit")


@query(with_e("SELECT l.off AS off, r.off AS last_view FROM (SELECT * FROM e WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts_ns >= r.ts_ns"))
def asof_join(spark, d):
    views, buys = sides(spark, d)
    return view(joins.asof_join(buys, views, ("offset",)), off="offset", last_view="table_offset")


@query(with_e("SELECT off FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"))
def table_anti_join(spark, d):
    table = Topology({"c": customers(spark, d)}, ("offset",)).table("c")
    return view(stream(spark, d).join_table(table, "anti").df, off="offset")


# -- routing
FNV = "list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(with_e(f"SELECT off, CAST({FNV} AS BIGINT) AS h, CAST({FNV} % 6 AS INTEGER) AS part FROM e"))
def fnv_partition(spark, d):
    return view(events(spark, d), off="offset", h=routing.fnv1a32("key"), part=routing.partition_for("key", 6, F.lit(0)))


@query(with_e("SELECT off, CAST((row_number() OVER (ORDER BY ts_ns, off) - 1) % 5 AS INTEGER) AS part FROM e"))
def round_robin(spark, d):
    return view(ordered.arrival_index(events(spark, d), ("ts_ns", "offset")), off="offset", part=F.pmod("idx", F.lit(5)).cast("int"))


@query(with_e(f"SELECT off, CAST(ts_ns // {HOUR} % 5 AS INTEGER) AS part FROM e"))
def sticky_partition(spark, d):
    return view(events(spark, d), off="offset", part=routing.sticky("ts_ns", HOUR, 5))


def parts(spark, d):
    return events(spark, d, 7).select("topic", "partition").distinct()


MEMBERS = ["b", "a", "c"]


@query("SELECT 'events' AS topic, CAST(p AS INTEGER) AS part, ['a', 'b', 'c'][n] AS member FROM (SELECT p, ntile(3) OVER (ORDER BY p) AS n FROM range(7) t(p))")
def assign_range(spark, d):
    return view(routing.range_assign(parts(spark, d), MEMBERS), topic="topic", part="partition", member="member")


@query("SELECT 'events' AS topic, CAST(p AS INTEGER) AS part, ['a', 'b', 'c'][p % 3 + 1] AS member FROM range(7) t(p)")
def assign_round_robin(spark, d):
    return view(routing.round_robin_assign(parts(spark, d), MEMBERS), topic="topic", part="partition", member="member")


# -- logs
@query(with_e("SELECT off // 4 AS off FROM e WHERE off % 4 = 2 ORDER BY off LIMIT 10"))
def head(spark, d):
    return view(log.head(events(spark, d, 4), 2), off="offset")


@query(with_e("SELECT off // 4 AS off FROM e WHERE off % 4 = 1 ORDER BY off DESC LIMIT 10"))
def last(spark, d):
    return view(log.last(events(spark, d, 4), 1), off="offset")


@query(with_e("SELECT min(off) AS off FROM e WHERE event_type = 'error' AND off >= 50"))
def record_fetch(spark, d):
    return view(log.fetch(events(spark, d).where(is_type("error")), 0, 50), off="offset")


@query(with_e("SELECT off // 4 AS off, ts_ns FROM e WHERE off % 4 = 3 AND off // 4 >= 100"))
def assign_partition(spark, d):
    return view(log.assign(events(spark, d, 4), 3, 100), off="offset", ts_ns="ts_ns")


@query(with_e("SELECT off % 4 AS part, off // 4 AS off FROM e WHERE off // 4 >= 100 * (off % 4)"))
def subscribe_committed(spark, d):
    starts = spark.range(4).select(F.lit("events").alias("topic"), F.col("id").cast("int").alias("partition"), (F.col("id") * 100).alias("next_offset"))
    return view(log.subscribe(events(spark, d, 4), starts=starts), part=F.col("partition").cast("long"), off="offset")


@query(with_e("SELECT off % 4 AS part, min(off // 4) AS log_start, max(off // 4) + 1 AS high_water, count(*) AS records, CAST(sum(length(CAST(user_id AS VARCHAR)) + length(props)) AS BIGINT) AS bytes FROM e GROUP BY off % 4"))
def topic_stats(spark, d):
    return view(log.stats(events(spark, d, 4)), part=F.col("partition").cast("long"), log_start="log_start", high_water="high_water", records="records", bytes="bytes")


@query(with_e("SELECT p AS part, CASE WHEN p < 3 THEN 'g' END AS grp, coalesce(h - 10 * p, -1) AS lag FROM (SELECT p, CASE WHEN p < 3 THEN (SELECT max(off // 4) + 1 FROM e WHERE off % 4 = p) END AS h FROM range(4) t(p))"))
def group_lag(spark, d):
    committed = spark.range(3).select(F.lit("g").alias("group"), F.lit("events").alias("topic"), F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("next_offset"))
    return view(log.lag(log.high_water(events(spark, d, 4)), committed), part=F.col("partition").cast("long"), grp="group", lag="lag")


SEG = 2000


@query(with_e(f"""SELECT off FROM (SELECT off, event_type, off // {SEG} AS seg, max(off // {SEG}) OVER () AS newest, row_number() OVER (PARTITION BY user_id, off // {SEG} < (SELECT max(off // {SEG}) FROM e) ORDER BY off DESC) AS r FROM e) WHERE seg = newest OR (r = 1 AND event_type <> 'error')"""))
def compact(spark, d):
    df = events(spark, d).withColumn("value", F.when(~is_type("error"), F.col("value")))
    return view(log.compact(df, log.segments(df, SEG)), off="offset")


@query(with_e(f"SELECT off FROM e WHERE off // {SEG} >= (SELECT coalesce(min(CASE WHEN newest >= (SELECT max(ts_ns) FROM e) - {240 * HOUR} THEN s END), max(s)) FROM (SELECT off // {SEG} AS s, arg_max(ts_ns, off) AS newest FROM e GROUP BY 1))"))
def time_retention(spark, d):
    df = events(spark, d)
    now = df.agg(F.max("ts_ns")).first()[0]
    return view(log.retain_time(df, now - 240 * HOUR, log.segments(df, SEG)), off="offset")


@query(with_e(f"SELECT off FROM e JOIN (SELECT s, sum(b) OVER (ORDER BY s DESC) AS upto, max(s) OVER () AS newest FROM (SELECT off // {SEG} AS s, sum(length(CAST(user_id AS VARCHAR)) + length(props)) AS b FROM e GROUP BY 1)) ON off // {SEG} = s WHERE upto <= 60000 OR s = newest"))
def size_retention(spark, d):
    df = events(spark, d)
    return view(log.retain_size(df, 60_000, log.segments(df, SEG)), off="offset")


@query(with_e("""SELECT off, '{"partition":0,"offset":' || off || ',"timestamp":' || ts_ns || ',"key":"' || user_id || '","value":"' || replace(props, '"', '\\"') || '","headers":[{"key":"event-type","value":"' || event_type || '"}]}' AS line FROM e"""))
def dump_jsonl(spark, d):
    df = log.dump(events(spark, d))
    return view(df.withColumn("off", F.get_json_object("value", "$.offset").cast("long")), off="off", line="value")


@query(with_e("SELECT off, ts_ns, user_id, props AS v, event_type FROM e"))
def load_jsonl(spark, d):
    return view(log.load(log.dump(events(spark, d)), "again"), off="offset", ts_ns="ts_ns", user_id=user(), v=model.text("value"), event_type=kind())


def places(spark: SparkSession, step: int) -> DataFrame:
    """Offset ``step`` times its number for each of four partitions."""
    return spark.range(4).select(F.lit("events").alias("topic"), F.col("id").cast("int").alias("partition"), (F.col("id") * step).alias("offset"))


@query(with_e("SELECT off // 4 AS off, CAST(off % 4 AS INTEGER) AS part FROM e WHERE off // 4 >= 10 * (off % 4)"))
def seek(spark, d):
    return view(log.seek(events(spark, d, 4), places(spark, 10)), off="offset", part="partition")


@query(with_e("SELECT off FROM e WHERE false"))
def seek_to_end(spark, d):
    return view(log.seek(events(spark, d, 4), where="end"), off="offset")


@query(with_e("SELECT off // 4 AS off, CAST(off % 4 AS INTEGER) AS part FROM e WHERE off % 4 NOT IN (1, 3)"))
def pause(spark, d):
    return view(log.without(events(spark, d, 4), [("events", 1), ("events", 3)]), off="offset", part="partition")


@query(with_e("SELECT off // 4 AS off, CAST(off % 4 AS INTEGER) AS part FROM e WHERE off // 4 >= 7 * (off % 4) ORDER BY ts_ns, off % 4, off // 4 LIMIT 64"))
def poll(spark, d):
    return view(log.poll(events(spark, d, 4), places(spark, 7).withColumnRenamed("offset", "next_offset"), 64), off="offset", part="partition")


@query(with_e("SELECT CAST(p AS INTEGER) AS part, coalesce(n, 7 * p) AS next_offset FROM range(4) t(p) LEFT JOIN (SELECT off % 4 AS q, max(off // 4) + 1 AS n FROM (SELECT off FROM e WHERE off // 4 >= 7 * (off % 4) ORDER BY ts_ns, off % 4, off // 4 LIMIT 64) GROUP BY 1) ON p = q"))
def consume_position(spark, d):
    _, after = log.consume(events(spark, d, 4), places(spark, 7).withColumnRenamed("offset", "next_offset"), 64)
    return view(after, part="partition", next_offset="next_offset")


@query(with_e("SELECT off // 4 AS off, CAST(off % 4 AS INTEGER) AS part FROM e WHERE off // 4 >= 30 * (off % 4)"))
def tail(spark, d):
    return view(log.tail(events(spark, d, 4), places(spark, 30).withColumnRenamed("offset", "high_water")), off="offset", part="partition")


@query(with_e("SELECT 'g' AS \"group\", CAST(sum(c - 5 * p) AS BIGINT) AS lag FROM (SELECT off % 4 AS p, max(off // 4) + 1 AS c FROM e GROUP BY 1)"))
def total_lag(spark, d):
    committed = places(spark, 5).select(F.lit("g").alias("group"), "topic", "partition", F.col("offset").alias("next_offset"))
    return log.total_lag(log.lag(log.high_water(events(spark, d, 4)), committed))


@query(with_e("SELECT user_id, CAST(num % 3 AS INTEGER) AS part, row_number() OVER (PARTITION BY num % 3 ORDER BY off) - 1 + 100 AS off FROM e"))
def custom_partitioner(spark, d):
    rows = events(spark, d).select("key", "value", "headers", "ts_ns", F.col("offset").alias("o"))
    ends = spark.range(3).select(F.lit("out").alias("topic"), F.col("id").cast("int").alias("partition"), F.lit(100).alias("high_water"))
    return view(log.append("out", rows, 3, ends, ["o"], partitioner=lambda df, n: number() % n), user_id=user(), part="partition", off="offset")


@query(with_e("SELECT row_number() OVER (ORDER BY off) - 1 AS off, user_id, CAST(99 AS BIGINT) AS ts_ns FROM e WHERE event_type = 'click'"))
def topic_copy(spark, d):
    return view(log.copy(events(spark, d).where(is_type("click")), "copy", now_ns=F.lit(99)), off="offset", user_id=user(), ts_ns="ts_ns")


@query(with_e(f"SELECT user_id, CAST({FNV} % 3 AS INTEGER) AS part, row_number() OVER (PARTITION BY {FNV} % 3 ORDER BY off) - 1 + 100 AS off FROM e"))
def produce(spark, d):
    rows = events(spark, d).select("key", "value", "headers", "ts_ns", F.col("offset").alias("o"))
    ends = spark.range(3).select(F.lit("out").alias("topic"), F.col("id").cast("int").alias("partition"), F.lit(100).alias("high_water"))
    return view(log.append("out", rows, 3, ends, ["o"]), user_id=user(), part="partition", off="offset")


@query(with_e(f"SELECT off + 7 AS off, CAST((SELECT arg_min({FNV} % 3, off) FROM e) AS INTEGER) AS part FROM e"))
def produce_batch(spark, d):
    rows = events(spark, d).select("key", "value", "headers", F.col("offset").alias("o"))
    ends = spark.range(3).select(F.lit("out").alias("topic"), F.col("id").cast("int").alias("partition"), F.lit(7).alias("high_water"))
    return view(log.append_batch("out", rows, 3, ends, ["o"], F.lit(1)), off="offset", part="partition")


@query(with_e("SELECT event_type AS connector, CAST(user_id % 3 AS INTEGER) AS task, arg_max(off, off) AS pos FROM e GROUP BY ALL"))
def connector_offsets(spark, d):
    key = F.encode(F.concat(kind(), F.lit("/"), (user() % 3).cast("string")), "UTF-8")
    saved = events(spark, d).withColumns({"key": key, "value": F.encode(F.to_json(F.struct(F.col("offset").alias("pos"))), "UTF-8")})
    return view(log.connector_offsets(saved), connector="connector", task="task", pos=F.get_json_object("state", "$.pos").cast("long"))


@query(with_e("SELECT count(*) AS records, count(DISTINCT user_id) AS keys, CAST(4 AS BIGINT) AS partitions, max(ts_ns) AS newest_ns FROM e"))
def metrics(spark, d):
    return view(log.metrics(events(spark, d, 4)), records="records", keys="keys", partitions="partitions", newest_ns="newest_ns")


@query("SELECT DISTINCT event_type AS topic FROM events WHERE event_type = 'click' OR starts_with(event_type, 'p')")
def scope_match(spark, d):
    names = events(spark, d).select(kind().alias("topic")).distinct()
    return log.allowed(names, ["read:click", "*:p*", "write:view"], "read")


@query(with_e("SELECT off, num AS n, lpad(upper(to_hex(num)), 16, '0') AS hex FROM e"))
def be64(spark, d):
    b = model.encode_be64(number())
    return view(events(spark, d), off="offset", n=model.decode_be64(b), hex=F.hex(b))


# -- registry: each event type is a subject whose schemas ask for more or fewer fields
def schema_events(spark, d):
    e = events(spark, d)
    text = F.concat(F.lit('{"required":["f'), (number() % 5).cast("string"), F.lit('"]}'))
    return e.select("offset", kind().alias("subject"), F.lit("register").alias("kind"), text.alias("schema"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("level"))


REG = """SELECT event_type AS subject, off, num % 5 AS f FROM (SELECT *, lag(num % 5) OVER (PARTITION BY event_type ORDER BY off) AS p FROM e) WHERE p IS NULL OR p <> num % 5"""


@query(with_e(f"SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY off) AS version, off AS id, '{{\"required\":[\"f' || f || '\"]}}' AS schema FROM ({REG})"))
def registry_versions(spark, d):
    return view(registry.versions(schema_events(spark, d)), subject="subject", version=F.col("version").cast("long"), id=F.col("id").cast("long"), schema="schema")


@query(with_e(f"SELECT subject, count(*) AS version, max(off) AS id FROM ({REG}) GROUP BY subject"))
def registry_latest(spark, d):
    return view(registry.latest(schema_events(spark, d)), subject="subject", version=F.col("version").cast("long"), id=F.col("id").cast("long"))


@query(with_e(f"SELECT subject, id, f = p AS backward FROM (SELECT subject, off AS id, f, lag(f) OVER (PARTITION BY subject ORDER BY off) AS p FROM ({REG})) WHERE p IS NOT NULL"))
def schema_compat(spark, d):
    from pyspark.sql import Window

    v = registry.versions(schema_events(spark, d)).withColumn("old", F.lag("schema").over(Window.partitionBy("subject").orderBy("version"))).where("old IS NOT NULL")
    return view(v, subject="subject", id=F.col("id").cast("long"), backward=registry.compatible(F.col("old"), F.col("schema"), F.lit("BACKWARD")))


@query(with_e(f"""SELECT subject, version, id, f FROM (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY off) AS version, off AS id, f, count(*) OVER (PARTITION BY subject) AS n FROM ({REG}))
  WHERE version <> n UNION ALL SELECT subject, count(*) + 1, (SELECT max(off) FROM e) + 2, arg_max(f, off) FROM ({REG}) GROUP BY subject"""))
def registry_deleted_version(spark, d):
    """The latest version goes, then the same schema comes again: as another version."""
    made = schema_events(spark, d)
    top = registry.latest(made).crossJoin(F.broadcast(made.agg(F.max("offset").alias("end"))))
    none = lambda kind: F.lit(None).cast(kind)
    gone = top.select((F.col("end") + 1).alias("offset"), "subject", F.lit("delete_version").alias("kind"), none("string").alias("schema"), none("int").alias("id"), "version", none("string").alias("level"))
    again = top.select((F.col("end") + 2).alias("offset"), "subject", F.lit("register").alias("kind"), "schema", none("int").alias("id"), none("int").alias("version"), none("string").alias("level"))
    out = registry.versions(made.unionByName(gone).unionByName(again))
    return view(out, subject="subject", version=F.col("version").cast("long"), id=F.col("id").cast("long"), f=F.regexp_extract("schema", r"f(\d)", 1).cast("long"))


def with_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.withColumn("kind", F.lit(kind))


@query(with_e("SELECT event_type AS subject, ['NONE', 'BACKWARD', 'FORWARD', 'FULL'][arg_max(num, off) % 4 + 1] AS level FROM e GROUP BY event_type"))
def registry_levels(spark, d):
    made = events(spark, d).select("offset", kind().alias("subject"), F.get(F.array(*[F.lit(x) for x in registry.LEVELS]), (number() % 4).cast("int")).alias("level"))
    return registry.levels(with_kind(made, "config"))


@query(with_e(f"SELECT subject, count(*) AS versions, min(off) AS first FROM ({REG.replace('FROM e)', 'FROM e WHERE off >= 500)')}) WHERE subject IN ('click', 'view') GROUP BY subject UNION ALL SELECT subject, count(*), min(off) FROM ({REG}) WHERE subject NOT IN ('click', 'view') GROUP BY subject"))
def registry_deleted_subject(spark, d):
    """Two subjects go before offset 500: their versions begin anew."""
    none = lambda kind: F.lit(None).cast(kind)
    gone = spark.createDataFrame([("click",), ("view",)], "subject string").select(F.lit(499.5).alias("place"), "subject", F.lit("delete_subject").alias("kind"), none("string").alias("schema"), none("int").alias("id"), none("int").alias("version"), none("string").alias("level"))
    made = schema_events(spark, d).withColumn("place", F.col("offset").cast("double")).withColumn("id", F.col("offset").cast("int")).drop("offset")
    both = made.unionByName(gone).withColumn("offset", (F.col("place") * 2).cast("long")).drop("place")
    return registry.versions(both).groupBy("subject").agg(F.count("*").alias("versions"), F.min("id").cast("long").alias("first"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
