import random

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import routing
from tidelog.operators import aggregate, joins, log, ordered, stateless, windows
from tidelog.plans.dsl import Topology

MS = 1_000_000


@pytest.fixture(autouse=True)
def value_as_text(spark):
    """V: the value as text; columns need a session."""
    globals()["V"] = F.decode("value", "UTF-8")



def top(df, **more):
    return Topology({"input": df} | more, ("offset",))


def test_filter_map_and_twovalued_predicates(records, kv):
    df = records([("a", "one"), ("a", "skip"), ("b", "two"), ("c", None)])
    s = top(df).stream("input").filter(V != "skip").map_values(F.encode(F.concat(F.lit("transformed:"), V), "UTF-8"))
    assert kv(s.df) == [("a", "transformed:one"), ("b", "transformed:two")]
    assert kv(top(df).stream("input").filter_not(V == "skip").df) == [("a", "one"), ("b", "two"), ("c", None)]


def test_keys_and_values(records, kv):
    s = top(records([("orig", "abc")])).stream("input")
    upper = F.encode(F.upper(V), "UTF-8")
    assert kv(s.select_key(F.concat(F.lit(b"k:"), "value")).df) == [("k:abc", "abc")]
    assert kv(s.map_key_value(F.concat(F.lit(b"k:"), "key"), upper).df) == [("k:orig", "ABC")]


def test_flat_map_none_one_many_and_chained(records, kv):
    s = top(records([("a", ""), ("b", "x"), ("c", "x y")])).stream("input")
    words = F.transform(F.filter(F.split(V, " "), lambda w: w != ""), lambda w: F.encode(w, "UTF-8"))
    assert sorted(kv(s.flat_map(words).df)) == [("b", "x"), ("c", "x"), ("c", "y")]
    twice = F.array("value", F.concat("value", F.lit(b"!")))
    assert sorted(kv(s.flat_map(words).flat_map(twice).df)) == [("b", "x"), ("b", "x!"), ("c", "x"), ("c", "x!"), ("c", "y"), ("c", "y!")]


def test_branch_through_print_peek(records, kv):
    t = top(records([("k", x) for x in "abcab"]))
    a, b = t.stream("input").branch(V == "a", V == "b")
    assert (a.df.count(), b.df.count()) == (2, 2)
    up = F.encode(F.concat(F.lit("up:"), V), "UTF-8")
    t.stream("input").take(1).map_values(up).through("mid").map_values(F.concat(F.lit(b"dn:"), "value")).to("out")
    out = t.run()
    assert kv(out["mid"]) == [("k", "up:a")] and kv(out["out"]) == [("k", "dn:up:a")]
    assert a.lines("DBG").first().line == 'DBG offset=0 key="k" value="a"'
    assert t.stream("input").peek("seen").df.count() == 5


def test_ordered(records, kv):
    five = records([(k, f"v{i + 1}") for i, k in enumerate("abcde")])
    values = lambda df: [v for _, v in kv(df)]
    assert values(ordered.take(five, 2, ("offset",))) == ["v1", "v2"]
    assert values(ordered.skip(five, 2, ("offset",))) == ["v3", "v4", "v5"]
    assert ordered.take(five, 0).count() == 0 and ordered.skip(five, -1).count() == 5
    nine = records([("", f"v{i}") for i in range(1, 10)])
    assert values(ordered.sample_nth(nine, 3, ("offset",))) == ["v1", "v4", "v7"]
    assert ordered.sample_nth(nine, 0).count() == 0 and ordered.sample_nth(nine, 1).count() == 9
    twice = records([("a", "v1"), ("b", "v2"), ("a", "v3"), ("c", "v4"), ("b", "v5"), (None, "n"), ("", "e")])
    assert values(ordered.distinct_first(twice, order=("offset",))) == ["v1", "v2", "v4", "n"]


def test_arrival_index_over_many_stretches(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 7919, F.lit(997))).alias("t"), F.col("id").alias("i"))
    got = [(r.t, r.i) for r in ordered.arrival_index(df, ("t", "i"), rows=50).orderBy("idx").collect()]
    assert got == sorted(got)
    assert [r.idx for r in ordered.arrival_index(df, ("t", "i"), rows=50).orderBy("t", "i").collect()] == list(range(1000))


def test_throttle_and_idempotence(records, kv):
    assert ordered.throttle(records([("k", "v", 0)] * 10), 2.0, order=("offset",)).count() == 2
    assert ordered.throttle(records([("k", "v", 500 * i) for i in range(10)]), 2.0, order=("offset",)).count() == 10
    df = records([("p", str(n)) for n in (1, 2, 2, 1, 3, 5, 4)])
    assert [v for _, v in kv(ordered.idempotent(df, "key", V.cast("long"), ("offset",)))] == ["1", "2", "3", "5"]


def test_running_and_final(records):
    g = top(records([(k, "") for k in "aabab"])).stream("input").group_by_key()
    for stretch in (None, 2):
        assert [r.agg for r in g.count(stretch).df.orderBy("offset").collect()] == [1, 2, 1, 3, 2]
    assert {bytes(r.key): r.agg for r in g.final("count").collect()} == {b"a": 3, b"b": 2}
    s = top(records([("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")])).stream("input").group_by_key()
    for stretch in (None, 1):
        assert [r.agg for r in s.sum(V.cast("long"), stretch).df.orderBy("offset").collect()] == [1, 3, 3, 7]
        assert [r.agg for r in s.max(V.cast("long"), stretch).df.orderBy("offset").collect()] == [1, 2, 3, 4]
    r = top(records([("a", "1"), ("b", "x"), ("a", "2")])).stream("input").group_by_key()
    merge = lambda a, b: F.concat(a, F.lit("|"), b)
    assert [x.agg for x in r.reduce(V, merge).df.orderBy("offset").collect()] == ["1", "x", "1|2"]
    assert {bytes(x.key): x.agg for x in r.final_reduce(V, merge).collect()} == {b"a": "1|2", b"b": "x"}
    k = top(records([("k", x) for x in "1234"])).stream("input").group_by_key()
    assert k.aggregate(V.cast("int"), F.lit(0), lambda a, x: a + x).first().agg == 10
    assert k.aggregate_python(lambda prev, row: (prev or 0) + int(row["value"]), "long").first().agg == 10


def test_sum_wraps(records):
    df = records([("a", str(2**63 - 1)), ("a", "2")])
    assert aggregate.final(df, "sum", V.cast("long"), wrap=True).first().agg == -(2**63) + 1


def test_partition_scope(records):
    df = records([("a", ""), ("b", "")]).unionByName(records([("a", "")], partition=1))
    g = top(df).stream("input")
    assert g.group_by_key().final("count").count() == 2
    assert g.group_by_key("partition").final("count").count() == 3


def test_tables(records, kv):
    t = top(records([("a", "v1"), ("b", "v2"), ("a", "skip"), ("a", "v3"), ("c", "v4"), ("b", None), ("", "e"), (None, "n")]))
    assert kv(t.table("input").final()) == [("a", "v3"), ("c", "v4")]
    assert kv(t.table("input").get(b"c")) == [("c", "v4")]
    assert kv(t.table("input").range(b"b", b"d")) == [("c", "v4")]
    stored = t.stream("input").filter_not(V == "skip").to_table("s").final()
    assert kv(stored) == [("a", "v3"), ("c", "v4"), ("", "e")]


def test_windows(records):
    x = records([("x", "", 10), ("x", "", 20), ("x", "", 320)])
    rows = lambda df: sorted((r.window_start_ns // MS, r.window_end_ns // MS, r["count"]) for r in df.collect())
    assert rows(windows.tumbling(x, 150 * MS)) == [(0, 150, 2), (300, 450, 1)]
    one = records([("x", "", 1000)])
    assert rows(windows.hopping(one, 300 * MS, 100 * MS)) == [(800, 1100, 1), (900, 1200, 1), (1000, 1300, 1)]
    s = records([("x", "", 0), ("x", "", 50), ("x", "", 400)])
    assert rows(windows.session(s, 100 * MS)) == [(0, 50, 2), (400, 400, 1)]
    assert rows(windows.session(records([("x", "", 0), ("x", "", 100)]), 100 * MS)) == [(0, 100, 2)]
    assert rows(windows.session(records([("x", "", 0), ("x", "", 101)]), 100 * MS)) == [(0, 0, 1), (101, 101, 1)]
    with pytest.raises(ValueError):
        windows.hopping(one, 1, 2)


def _emissions(times, size, advance=None):
    """What a record-at-a-time engine emits: (key, window, count), by plain simulation."""
    state, wm, out = {}, 0, []
    step = advance or size
    for k, t in times:
        wm = max(wm, t)
        own = t // step * step
        starts = [w for w in range(own, -1, -step) if w > t - size] if advance else [own]
        for w in starts:
            state[k, w] = state.get((k, w), 0) + 1
        for key in [key for key in state if key[1] + size <= wm and key[1] != own]:
            out.append((*key, state.pop(key)))
    return sorted(out)


@pytest.mark.parametrize("advance", [None, 4, 5])
def test_replay_is_what_a_sequential_engine_emits(records, advance):
    rng = random.Random(advance)
    for _ in range(3):
        times = [(rng.choice("abc"), max(0, i + rng.randint(-12, 3))) for i in range(60)]
        df = records([(k, "", t) for k, t in times])
        got = sorted((bytes(r.key).decode(), r.window_start_ns // MS, r["count"]) for r in windows.replay(df, 10 * MS, advance * MS if advance else None).collect())
        assert got == _emissions(times, 10, advance)


def _replayed(spark, folder, name):
    """What a replay query gives for 2,600 records, and their types and times by arrival."""
    from pyspark.sql import functions as F

    from tidelog.plans import queries as plans

    n, base = 2_600, 36_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(base + F.col("id") * 300).alias("ts"), (F.col("id") % 9).alias("user_id"), F.element_at(F.array(*map(F.lit, ("view", "click", "error"))), ((F.col("id") * 5) % 3 + 1).cast("int")).alias("event_type"), F.lit("{}").alias("props"))
    df.write.parquet(f"file://{folder}/events.parquet")
    arrived = sorted(range(n), key=lambda k: (k + k * 7919 % 50, k))
    times = [(("view", "click", "error")[k * 5 % 3], (base + k * 300) * 1_000_000_000) for k in arrived]
    return sorted((r.event_type, r.start_ns, r.n) for r in plans.queries()[name](spark, f"file://{folder}").collect()), times


def test_tumbling_replay_query_covers_all_records(spark, tmp_path):
    from tidelog.plans.queries import HOUR

    got, times = _replayed(spark, tmp_path, "tumbling_replay")
    assert got == _emissions(times, HOUR)


def test_hopping_replay_query_covers_all_records(spark, tmp_path):
    from tidelog.plans.queries import HOUR

    got, times = _replayed(spark, tmp_path, "hopping_replay")
    assert got == _emissions(times, 3 * HOUR, HOUR)


def pairs(df):
    text = lambda x: bytes(x.value).decode() if x else None
    return sorted(((text(r.left), text(r.right)) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucketed", [True, False])
def test_interval_joins(records, bucketed):
    left = records([("a", "click-a", 0), ("b", "click-b", 5000), (None, "n", 0), ("z", "L", 0)])
    right = records([("a", "imp-a", 1000), ("b", "imp-b", 6001), ("", "m", 10), ("y", "R", 0)])
    join = lambda how: pairs(joins.interval_join(left, right, 1000 * MS, how, bucketed))
    assert join("inner") == [("click-a", "imp-a"), ("n", "m")]
    assert join("left") == sorted([("click-a", "imp-a"), ("n", "m"), ("click-b", None), ("L", None)], key=str)
    assert join("full") == sorted([("click-a", "imp-a"), ("n", "m"), ("click-b", None), ("L", None), (None, "imp-b"), (None, "R")], key=str)


def test_filtered_stream_joins_what_was_filtered(records):
    t = top(records([("a", "1", 0), ("a", "2", 0)]), right=records([("a", "r", 0)]))
    joined = t.stream("input").filter(V == "2").join(t.stream("right"), MS)
    assert pairs(joined.pairs) == [("2", "r")]


def test_table_joins(records, kv):
    clicks = records([("alice", "click-1", 10), ("charlie", "click-2", 20), ("bob", "click-3", 30)])
    table = records([("alice", "ALICE", 0), ("bob", "BOB", 25), ("alice", "NEW", 15)])
    t = top(clicks, table=table)
    s = t.stream("input").join_table(t.table("table"))
    assert kv(s.df, "table_value", "hit") == [("alice", "click-1", "NEW", True), ("charlie", "click-2", None, False), ("bob", "click-3", "BOB", True)]
    assert kv(t.stream("input").join_table(t.table("table"), "anti").df) == [("charlie", "click-2")]
    past = t.stream("input").join_table(t.table("table"), as_of=True)
    assert kv(past.df, "table_value") == [("alice", "click-1", "ALICE"), ("charlie", "click-2", None), ("bob", "click-3", "BOB")]


def test_dead_letters_and_transform(records, kv):
    df = records([("a", "1"), ("b", "BOOM"), ("c", "3")])
    t = top(df)
    t.stream("input").attempt(F.encode(F.try_add(F.lit(1), V.try_cast("int")).cast("string"), "UTF-8"), F.concat(F.lit("bad: "), V)).to("out")
    out = t.run()
    assert kv(out["out"]) == [("a", "2"), ("c", "4")]
    dead = out["dead_letters"].select("key", "value", "offset", model.header(model.ERROR).alias("e"))
    assert kv(dead, "e") == [("b", "BOOM", "bad: BOOM")]
    kept = stateless.transform(records([("a", "v1"), (None, "v2"), ("c", "v3")]), {}, keep="octet_length(key) > 0")
    assert kept.count() == 2
    with pytest.raises(Exception, match="boom"):
        stateless.transform(df, {}, error=F.lit("boom")).collect()


def test_router(records):
    df = records([("user-42", "o", 0, [("event-type", "order.placed")]), ("admin-1", "s", 0, [("event-type", "shipment.created"), ("event-type", "x")]), ("order-7", "p", 0, [])])
    M = stateless.Match
    hits = lambda m: [r.value.decode() for r in df.where(m.column()).orderBy("offset").collect()]
    assert hits(M()) == ["o", "s", "p"]
    assert hits(M(header_equals={"event-type": "order.placed"})) == ["o"]
    assert hits(M(header_equals={"event-type": "x"})) == []
    assert hits(M(key_prefix="user-")) == ["o"] and hits(M(key_regex=r"^order-\d+$")) == ["p"]
    assert hits(M(header_exists=["event-type"], key_prefix="admin")) == ["s"]
    assert hits(M(any=[M(key_prefix="user-"), M(key_prefix="order")])) == ["o", "p"]
    assert hits(M(header_exists=["event-type"], any=[M(key_prefix="order")])) == []
    rules = [stateless.Rule(M(key_prefix="user-"), ["a", "b"]), stateless.Rule(M(header_exists=["event-type"]), ["b"])]
    assert sorted((r.target, r.value.decode()) for r in stateless.route(df, rules).collect()) == [("a", "o"), ("b", "o"), ("b", "s")]


def test_codes(spark):
    df = spark.createDataFrame([(b"a",), (b"foobar",), (b"",), (None,)], "b binary")
    assert [r[0] for r in df.select(routing.fnv1a32("b")).collect()] == [0xE40C292C, 0xBF9CF968, 2166136261, 2166136261]
    n = spark.createDataFrame([(0,), (5,), (-2,)], "n long")
    assert [r[0] for r in n.select(model.decode_be64(model.encode_be64("n"))).collect()] == [0, 5, -2]
    assert spark.createDataFrame([(b"abc",)], "b binary").select(model.decode_be64("b")).first()[0] == 0
    empty = model.normalize_empty(spark.createDataFrame([(b"", b"", [("h", b"")])], "key binary, value binary, headers array<struct<key:string,value:binary>>"))
    assert empty.first().asDict(True) == {"key": None, "value": None, "headers": [{"key": "h", "value": None}]}


def test_assignment(spark):
    parts = spark.range(7).select(F.lit("t").alias("topic"), F.col("id").cast("int").alias("partition"))
    sizes = [r["count"] for r in routing.range_assign(parts, ["b", "c", "a"]).groupBy("member").count().orderBy("member").collect()]
    assert sizes == [3, 2, 2]
    assert [r.member for r in routing.round_robin_assign(parts, ["b", "a"]).orderBy("partition").collect()] == list("abababa")
    pool = [("t", k) for k in range(6)]
    one = routing.sticky_assign(pool, ["a", "b"], {})
    two = routing.sticky_assign(pool, ["a", "b", "c"], one)
    assert sorted(p for v in two.values() for p in v) == pool and {m: len(v) for m, v in two.items()} == {"a": 2, "b": 2, "c": 2}
    assert set(two["a"]) <= set(one["a"]) and routing.sticky_assign(pool, [], one) == {}


def test_compaction_and_retention(records, kv):
    df = records([("a", "a-1"), ("b", "b-1"), ("a", "a-2"), ("c", "c-1"), ("b", "b-2"), ("a", "a-3"), ("z", "z")])
    assert kv(log.compact(df, F.when(F.col("offset") < 6, 0).otherwise(1))) == [("c", "c-1"), ("b", "b-2"), ("a", "a-3"), ("z", "z")]
    dead = records([("a", "a-1"), ("a", None), ("b", "b-1"), (None, "n"), ("c", "c-1")])
    assert kv(log.compact(dead, F.when(F.col("offset") < 4, 0).otherwise(1))) == [("b", "b-1"), ("c", "c-1")]
    old = records([("k", str(i), t) for i, t in enumerate([1, 2, 9, 3, 4, 5])])
    seg = log.segments(old, 2)
    assert [v for _, v in kv(log.retain_time(old, 3 * MS, seg))] == ["2", "3", "4", "5"]
    assert [v for _, v in kv(log.retain_time(old, 99 * MS, seg))] == ["4", "5"]
    assert [v for _, v in kv(log.retain_size(old, 8, seg))] == ["2", "3", "4", "5"]
    assert [v for _, v in kv(log.retain_size(old, 1, seg))] == ["4", "5"]


def test_dump_and_load(records, kv):
    df = records([("a", "x", 5, [("h", "1")]), (b"\xffA", None), (None, "ü")])
    lines = [r.value for r in log.dump(df).collect()]
    assert '"key_b64":"/0E="' in lines[1] and '"value":"ü"' in lines[2]
    back = log.load(log.dump(df), "again")
    assert sorted(map(str, back.drop("topic").collect())) == sorted(map(str, df.drop("topic").collect()))
