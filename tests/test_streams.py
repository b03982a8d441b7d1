"""Streams give what batches give; terminals and registry on topics; folds, calls by time, errors."""

import time

import pytest
from pyspark.sql import functions as F

from tidelog import model, registry
from tidelog.operators import aggregate, joins, log, ordered, windows
from tidelog.plans.dsl import Topology
from tidelog.sources import http as web
from tidelog.sources.topics import Catalog
from tidelog.streaming import state
from tidelog.streaming.worker import Worker

MS = 1_000_000


@pytest.fixture
def land(spark, tmp_path):
    """A stream of batch tables, a file each."""

    def make(name, *parts):
        path = f"file://{tmp_path}/{name}"
        for df in parts:
            df.coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def drain(stream, name):
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def plain(df):
    text = lambda x: bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x
    return sorted((text(r.key), text(r.value), r.offset, [(h.key, text(h.value)) for h in r.headers]) for r in df.collect())


def test_counters_keep_the_record(spark, records, land):
    df = records([(k, str(v), 100 * i, [("h", k)]) for i, (k, v) in enumerate([("a", 1), ("b", 2), ("a", 2), ("c", 9), ("a", 2), ("b", 3), ("a", 7)])])
    stream = land("t", df.where("offset < 3"), df.where("offset >= 3"))
    at, number = F.col("offset"), F.decode("value", "UTF-8").cast("long")
    assert plain(drain(state.take(stream, 4, at), "s_take")) == plain(ordered.take(df, 4, ("offset",)))
    assert plain(drain(state.skip(stream, 4, at), "s_skip")) == plain(ordered.skip(df, 4, ("offset",)))
    assert plain(drain(state.sample_nth(stream, 3, at), "s_sample")) == plain(ordered.sample_nth(df, 3, ("offset",)))
    assert plain(drain(state.throttle(stream, 2.0, at), "s_throttle")) == plain(ordered.throttle(df, 2.0, order=("offset",)))
    fresh = ordered.idempotent(df, F.decode("key", "UTF-8"), number, ("offset",))
    assert plain(drain(state.idempotent(stream, F.decode("key", "UTF-8"), number, at), "s_fresh")) == plain(fresh)


def test_folds_on_streams(spark, records, land):
    df = records([("a", "x"), ("b", "y"), ("a", "z"), ("a", "w"), ("b", "v")])
    stream = land("f", df.where("offset < 2"), df.where("offset >= 2"))
    key, value = F.decode("key", "UTF-8"), F.decode("value", "UTF-8")
    merge = lambda a, b: f"{a}|{b}"
    got = drain(state.running_reduce(stream, value, merge, "string", key, F.col("offset")), "s_reduce")
    batch = aggregate.running_reduce_python(df, value, merge, "string", order=("offset",))
    assert sorted((r.order, r.agg) for r in got.collect()) == sorted((r.offset, r.agg) for r in batch.collect()) == [(0, "x"), (1, "y"), (2, "x|z"), (3, "x|z|w"), (4, "y|v")]
    got = drain(state.running_fold(stream, value, lambda a, v: a + [v], ["<"], "array<string>", key, F.col("offset")), "s_fold")
    assert {r.order: r.agg for r in got.collect()}[3] == ["<", "x", "z", "w"]
    assert [bytes(r.record.value).decode() for r in got.orderBy("order").collect()] == list("xyzwv")


def test_running_folds_in_any_order_and_scope(records):
    df = records([(None, "1"), ("", "2"), ("a", "3"), (None, "4")]).unionByName(records([("", "5")], partition=1))
    out = aggregate.running_fold(df, F.decode("value", "UTF-8").cast("long"), lambda a, v: a + v, "long", order=("partition", "offset"), start=0)
    assert sorted((r.partition, r.offset, r.agg) for r in out.collect()) == [(0, 0, 1), (0, 1, 3), (0, 2, 3), (0, 3, 7), (1, 0, 12)]
    by_part = Topology({"t": df}, ("offset",)).stream("t").group_by_key("partition").aggregate_python(lambda p, r: (p or 0) + int(r["value"]), "long")
    assert {bytes(r.key).decode(): r.agg for r in by_part.collect()} == {"0/": 7, "0/a": 3, "1/": 5}


def test_table_join_on_streams(spark, records, land):
    table = records([("a", "A"), ("b", "B"), ("a", None)], topic="table")
    clicks = records([("a", "1"), ("b", "2"), ("x", "3"), (None, "4")])
    both = state.join_table(land("clicks", clicks), land("table", table.where("offset < 2")), F.col("offset"))
    got = {(bytes(r.value).decode(), bytes(r.table_value).decode() if r.table_value is not None else None, r.hit) for r in drain(both, "s_table").collect()}
    assert got == {("1", "A", True), ("2", "B", True), ("3", None, False), ("4", None, False)}
    gone = state.join_table(land("clicks2", clicks), land("table2", table), F.col("offset"), "anti")
    assert {bytes(r.value).decode() for r in drain(gone, "s_anti").collect()} == {"1", "3", "4"}


def test_null_keys_join_on_streams(records, land):
    left, right = records([(None, "l", 5000), ("a", "m", 5000)]), records([("", "r", 5005)])
    got = drain(state.interval_join(land("l", left), land("r", right), "1 seconds"), "s_null")
    assert [(bytes(r.left.value), bytes(r.right.value)) for r in got.collect()] == [(b"l", b"r")]


def test_calls_by_the_clock(spark, records, land):
    stream = land("c", records([("a", "1"), ("a", "2"), ("b", "3")]))
    q = state.every(stream, 300, F.decode("key", "UTF-8")).writeStream.format("memory").queryName("s_every").outputMode("append").trigger(processingTime="200 milliseconds").start()
    until = time.monotonic() + 60
    while spark.table("s_every").where("key = 'a'").count() < 2 and time.monotonic() < until:
        time.sleep(0.5)
    assert q.exception() is None
    q.stop()
    rows = spark.table("s_every").where("key = 'a'").orderBy("at_ms").collect()
    assert len(rows) >= 2 and {r.records for r in rows} == {2} and rows[1].at_ms - rows[0].at_ms == 300


def test_punctuations_and_headers(records):
    df = records([("a", "", t) for t in (5, 12, 12, 41)])
    got = [(r.at_ns // MS, r.records) for r in windows.punctuations(df, 10 * MS).orderBy("at_ns").collect()]
    assert got == [(10, 1), (20, 3), (30, 3), (40, 3)]
    assert windows.punctuations(df.where("false"), 10 * MS).count() == 0
    out = windows.emitted(windows.tumbling(df, 10 * MS)).orderBy("ts_ns").first()
    assert (out.ts_ns // MS, int.from_bytes(out.value, "big"), [(h.key, int.from_bytes(h.value, "big") // MS) for h in out.headers]) == (10, 1, [(model.WINDOW_START, 0), (model.WINDOW_END, 10)])


def test_errors_of_user_code(records, kv):
    def half(v):
        return str(int(v) // 2).encode()

    df = records([("a", "8"), ("b", "x"), ("c", None)])
    top = Topology({"t": df}, ("offset",))
    top.stream("t").apply(half).to("out")
    out = top.run()
    assert kv(out["out"]) == [("a", "4")]
    dead = out["dead_letters"].select("key", "value", "offset", model.header(model.ERROR).alias("e"))
    assert [(k, v, e.split(":")[0]) for k, v, e in kv(dead, "e")] == [("b", "x", "ValueError"), ("c", None, "TypeError")]
    assert kv(top.stream("t").apply(half, "skip").df) == [("a", "4")]
    with pytest.raises(Exception, match="ValueError"):
        top.stream("t").apply(half, "fail").df.collect()


def test_topology_on_a_catalog(spark, tmp_path, kv):
    c = Catalog(spark, f"file://{tmp_path}/log")
    c.create("in", 2)
    rows = lambda *kv_: spark.createDataFrame([(k.encode(), v.encode(), i) for i, (k, v) in enumerate(kv_)], "key binary, value binary, n int")
    c.produce("in", rows(("a", "1"), ("b", "2"), ("a", "3")), ["n"], now_ns=F.lit(5))

    def run():
        top = Topology.on(c, "g", "in")
        s = top.stream("in").filter(F.decode("value", "UTF-8") != "2")
        s.to("out")
        s.to_table("last")
        c.produce("in", rows(("z", "late")), ["n"], now_ns=F.lit(6))  # comes after the topology's ends: for the next run
        top.run_on_catalog(now_ns=F.lit(7))

    run()
    values = lambda t: sorted(bytes(r.value).decode() for r in c.read(t).collect())
    assert values("out") == ["1", "3"] and values("last-changelog") == ["1", "3"] and c.total_lag("g") == 1
    run()
    assert values("out") == ["1", "3", "late"] and c.total_lag("g") == 1
    assert [r.offset for r in c.read("out").orderBy("offset").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        Topology({"t": c.read("in")}).run_on_catalog()
    # reading by hand
    c.seek("h", ["in"])
    first = c.poll("h", ["in"], 2)
    assert first.count() == 2
    c.commit("h", log.position(first, c.committed("h").select("topic", "partition", "next_offset")))
    assert c.total_lag("h") == c.read("in").count() - 2 == 3
    c.seek("h", ["in"], "end")
    assert c.total_lag("h") == 0 and sum(c.position("h", "in").values()) == 5
    c.rename("h", "k")
    assert "h" not in c.groups() and sum(c.position("k", "in").values()) == 5


def test_swap_that_was_cut_off(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/log")
    c.create("t", 1)
    c.produce("t", spark.createDataFrame([(b"a", b"1", 1)], "key binary, value binary, n int"), ["n"])
    c._fs.rename(c._path(c._records("t")), c._path(f"{c.path}/records/.t.old"))
    assert c.read("t").count() == 1
    c.rewrite("t", c.read("t").where("false"))
    assert c.read("t").count() == 0


def test_partitioner_of_ones_own(spark):
    ends = spark.createDataFrame([], "topic string, partition int, high_water long")
    rows = spark.createDataFrame([(None, str(i).encode(), i) for i in range(9)], "key binary, value binary, n int")
    number = F.decode("value", "UTF-8").cast("int")
    out = log.append("t", rows, 3, ends, ["n"], F.lit(1), partitioner=lambda df, n: number % n)
    assert sorted((r.partition, r.offset, int(r.value)) for r in out.collect()) == sorted((i % 3, i // 3, i) for i in range(9))
    with pytest.raises(Exception, match="out of range"):
        log.append("t", rows, 3, ends, ["n"], F.lit(1), partitioner=lambda df, n: number).collect()
    turns = log.append("t", rows, 3, ends, ["n"], F.lit(1))
    assert sorted((r.partition, r.offset) for r in turns.collect()) == [(p, o) for p in range(3) for o in range(3)]


def test_arrival_index_by_group_and_time(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.timestamp_micros(F.pmod(F.col("id") * 7919, F.lit(499))).alias("t"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(None, None, 1000)], "g long, t timestamp, i long"))
    rows = ordered.arrival_index(df, ("t", "i"), rows=20, by=("g",)).collect()
    for g in (0, 1, 2, None):
        own = sorted((r.idx, r.t, r.i) for r in rows if r.g == g)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_registry_on_a_topic(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/log")
    r = registry.Registry.open(c)
    a, b = '{"required": ["a"]}', '{"required": ["b"]}'
    one, two = r.register("s", a), r.register("s", b)
    r.delete_version("s", 2)
    assert r.get_latest("s") == (1, one, a)
    three = r.register("s", b)
    assert three not in (one, two) and r.list_versions("s") == [1, 3] and r.get_latest("s") == (3, three, b)
    again = registry.Registry.open(c)
    assert again.get_latest("s") == (3, three, b) and again.register("s", b) == three
    got = sorted((x.subject, x.version, x.id, x.schema) for x in registry.versions(again.frame()).collect())
    assert got == [("s", 1, one, a), ("s", 3, three, b)]
    again.delete_id(three)
    assert registry.Registry.open(c).list_versions("s") == [1]
    assert [x.version for x in registry.versions(again.frame()).collect()] == [1]


def test_worker_counts_bytes_and_makes_a_batch_once(spark, records, tmp_path):
    path = f"file://{tmp_path}/in"
    records([("a", "12"), ("b", "345"), (None, None)]).write.parquet(path)
    made = spark.sparkContext.accumulator(0)

    def touch(v):
        made.add(1)
        return v

    stream = spark.readStream.schema(records([]).schema).parquet(path).withColumn("value", F.udf(touch, "binary")("value"))
    w = Worker(f"file://{tmp_path}/check")
    w.add("c", stream, lambda df: df.write.mode("append").parquet(f"file://{tmp_path}/out"))
    w.wait()
    s = w.stats()["c"]
    assert (s.records, s.bytes, s.batches, s.failures) == (3, 7, 1, 0) and s.seconds > 0 and made.value == 3


def test_polling_options(monkeypatch):
    asked = []
    monkeypatch.setattr(web.Poll, "fetch", lambda self, cursor: asked.append((cursor, self.headers, self.timeout)) or (["x"], "1"))
    r = web.PollReader({"url": "http://x", "cursorparam": "c", "header.Authorization": "k", "timeout": "3", "interval": "60"})
    rows, at = r.read(r.initialOffset())
    assert list(rows) == [("x",)] and at == {"cursor": "1", "n": 1} and asked == [("", {"Authorization": "k"}, 3.0)]
    rows, same = r.read(at)
    assert list(rows) == [] and same == at and len(asked) == 1


def test_late_windows_need_counts(records):
    g = Topology({"t": records([("a", "", 1)])}, ("offset",)).stream("t").group_by_key()
    with pytest.raises(ValueError):
        g.tumbling(MS, [F.max("offset")], late="reemit")
    with pytest.raises(ValueError):
        g.hopping(2 * MS, MS, late="again")
    assert g.tumbling(MS, late="reemit").columns[-1] == "count"


def test_full_join_keeps_repeated_rows(records):
    df = records([("a", "x", 0)])
    twice = df.unionByName(df)
    got = joins.interval_join(twice, records([("b", "y", 0), ("b", "y", 0)]), MS, "full").collect()
    assert len(got) == 4 and sum(r.left is None for r in got) == 2


@pytest.mark.parametrize("stretch", [3 * MS, 40 * MS, 10**6 * MS])
def test_stretches_change_nothing(spark, stretch):
    """Sessions, as-of joins and idempotence against plain Python, for any width of stretches."""
    import random

    from tidelog.model import RECORD_SCHEMA

    r = random.Random(stretch)
    make = lambda n, topic: spark.createDataFrame([(topic, 0, i, r.randrange(200) * MS, None, r.choice([b"a", b"b", None]), str(r.randrange(30)).encode(), []) for i in range(n)], RECORD_SCHEMA).cache()
    left, right = make(60, "l"), make(40, "r")
    rows = lambda df: [(bytes(x.key or b""), x.ts_ns, x.offset, bytes(x.value)) for x in df.collect()]
    # sessions
    want, by = [], {}
    for k, t, *_ in sorted(rows(left)):
        own = by.setdefault(k, [])
        if own and t - own[-1][1] <= 5 * MS:
            own[-1] = (own[-1][0], t, own[-1][2] + 1)
        else:
            own.append((t, t, 1))
    want = sorted((k, *x) for k, l in by.items() for x in l)
    got = windows.session(left, 5 * MS, stretch_ns=stretch).collect()
    assert sorted((bytes(x.key), x.window_start_ns, x.window_end_ns, x["count"]) for x in got) == want
    # as-of: of a key's table rows at one time any may be the last
    table = rows(right)
    for x in joins.asof_join(left, right, ("value",), stretch_ns=stretch).collect():
        past = [(t, v) for k, t, _, v in table if k == bytes(x.key or b"") and t <= x.ts_ns]
        last = {v for t, v in past if t == max(p[0] for p in past)}
        assert (bytes(x.table_value) if x.table_value is not None else None) in (last or {None})
    # idempotence
    number = F.decode("value", "UTF-8").cast("long")
    top, fresh = {}, []
    for x in left.orderBy("offset").collect():
        k, v = x.key, int(x.value)
        if v > top.get(k, -1):
            fresh.append(x.offset)
        top[k] = max(v, top.get(k, -1))
    got = ordered.idempotent(left, "key", number, ("offset",), stretch=max(1, stretch // MS))
    assert sorted(x.offset for x in got.collect()) == fresh


def test_running_reduce_of_long_keys(records):
    df = records([("k" if i % 5 else "j", str(i)) for i in range(330)])
    out = aggregate.running_reduce(df, F.decode("value", "UTF-8").cast("long"), lambda a, b: b - a, order=("offset",))
    want, state = {}, {}
    for i in range(330):
        k = "k" if i % 5 else "j"
        want[i] = state[k] = i - state[k] if k in state else i
    assert {r.offset: r.agg for r in out.collect()} == want
