import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog import registry
from tidelog.sources import files, http as web
from tidelog.sources.topics import Catalog
from tidelog.streaming import state
from tidelog.streaming.worker import Retry, Worker, dead_letters, fan_out, split_errors


def test_catalog_topics_groups(spark, tmp_path, kv):
    c = Catalog(spark, f"file://{tmp_path}/log")
    c.create("t", 2, retention_ms=1)
    for bad in (("t", 1), ("a b", 1), ("x", 0)):
        with pytest.raises(ValueError):
            c.create(*bad)
    rows = spark.createDataFrame([(b"a", b"1", 1), (b"b", b"2", 2), (None, b"3", 3), (None, b"4", 4)], "key binary, value binary, n int")
    c.produce("t", rows, ["n"], now_ns=F.lit(7))
    c.produce("t", rows, ["n"], now_ns=F.lit(8))
    df = c.read("t")
    assert df.count() == 8
    for p in (0, 1):
        offsets = [r.offset for r in df.where(F.col("partition") == p).orderBy("offset").collect()]
        assert offsets == list(range(len(offsets)))
    plan = df.where("partition = 1 and offset > 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan and "GreaterThan(offset,2)" in plan
    c.commit("g", df.groupBy("topic", "partition").agg(F.lit(1).alias("next_offset")))
    assert sum(r.lag for r in c.lag("g").collect()) == 6
    c.reset("g", "latest")
    assert sum(r.lag for r in c.lag("g").collect()) == 0
    c.rename("g", "h")
    assert c.groups() == ["h"]
    c.reset("h")
    assert sum(r.lag for r in c.lag("h").collect()) == 8
    c.compact("t", 1)
    assert c.read("t").where("key is not null").count() <= 4
    assert c.update("t", segment_bytes=5).retention_ms == 1 and c.describe("t").segment_bytes == 5
    assert c.stats().first().asDict() == {"topics": 1, "partitions": 2}
    c.delete("t")
    assert c.list() == []


def test_file_round_trip_and_tail(spark, tmp_path):
    (tmp_path / "in.txt").write_text("alpha\r\nbravo\ncharlie\n")
    df = files.read_lines(spark, f"file://{tmp_path}/in.txt")
    assert [bytes(r.value).decode() for r in df.collect()] == ["alpha", "bravo", "charlie"]
    files.write_lines(df, f"file://{tmp_path}/out", single=True)
    assert spark.read.text(f"file://{tmp_path}/out").count() == 3
    lines, pos = files.tail_from(str(tmp_path / "in.txt"), 0)
    assert lines == ["alpha", "bravo", "charlie"]
    with open(tmp_path / "in.txt", "a") as f:
        f.write("delta\nhalf")
    assert files.tail_from(str(tmp_path / "in.txt"), pos)[0] == ["delta"]
    spark.dataSource.register(files.TailSource)
    q = spark.readStream.format("tail").option("path", str(tmp_path / "in.txt")).load().writeStream.format("memory").queryName("tailed").start()
    q.processAllAvailable()
    q.stop()
    assert [r.value for r in spark.table("tailed").collect()] == ["alpha", "bravo", "charlie", "delta"]


@pytest.fixture
def server():
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            cursor = self.path.partition("since=")[2]
            body, status = ("alpha\n\nbravo\n", 200) if not cursor else ("charlie\n", 200) if cursor == "1" else ("", 200)
            if self.path.startswith("/bad"):
                status = 500
            self.send_response(status)
            self.send_header("X-Next", "1" if not cursor else "2")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_web_source_and_sink(spark, server, records):
    url, got = server
    p = web.Poll(url + "/x", "since", "X-Next")
    assert p.fetch("") == (["alpha", "bravo"], "1") and p.fetch("1") == (["charlie"], "2")
    with pytest.raises(OSError):
        web.Poll(url + "/bad").fetch("")
    web.send(records([("a", "one"), ("b", "two")]), url)
    assert sorted(got) == [b"one", b"two"]


def test_registry_rules(spark):
    r = registry.Registry(spark)
    need = lambda *f: '{"required": [' + ", ".join(f'"{x}"' for x in f) + "]}"
    r.set_level("s", "BACKWARD")
    one = r.register("s", need("id", "name"))
    assert r.register("s", need("id", "name")) == one
    two = r.register("s", need("id"))
    assert two != one and r.list_versions("s") == [1, 2]
    with pytest.raises(ValueError):
        r.register("s", need("id", "email"))
    r.set_level("s", "FULL")
    assert [r.check("s", need(*f)) for f in (("id", "name"), (), ("id",))] == [False, False, True]
    r.delete_version("s", 1)
    assert r.get_version("s", 1) is None and r.get_latest("s")[0] == 2
    got = [(x.subject, x.version, x.id) for x in registry.versions(r.frame()).collect()]
    assert got == [("s", 2, two)]
    r.delete_subject("s")
    assert r.list_subjects() == [] and registry.versions(r.frame()).count() == 0
    r.register("s", need("id"))
    assert r.list_versions("s") == [1] and [x.subject for x in registry.subjects(r.frame()).collect()] == ["s"]


def test_retry_and_dead_letters(spark):
    assert Retry(5, 0.1, 0.5).waits() == [0.1, 0.2, 0.4, 0.5]
    calls, buried, slept = [], [], []
    batch = spark.range(3)

    def fails(df):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")

    Retry(3, 0.1).run(fails, batch, slept.append)
    assert len(calls) == 3 and slept == [0.1, 0.2]

    def never(df):
        raise OSError("x")

    dead_letters(never, lambda df: buried.append(df.count()))(batch)
    assert buried == [3]
    seen = {}
    split_errors(lambda df: seen.update(ok=df.count()), lambda df: seen.update(bad=df.count()))(batch.withColumn("error", F.when(F.col("id") == 1, "e")))
    assert seen == {"ok": 2, "bad": 1}
    fan_out({"a": lambda df: seen.update(a=df.count())})(batch.withColumn("target", F.lit("a")))
    assert seen["a"] == 3


def _land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def _drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, records, tmp_path):
    df = records([(k, v, 1000 * i) for i, (k, v) in enumerate([("a", "1"), ("b", "2"), ("a", "3"), ("a", "1"), ("b", "7"), ("c", "5")])])
    path = f"file://{tmp_path}/t"
    _land(df, path)
    _land(df.where("offset >= 3").withColumn("offset", F.col("offset") + 3), path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    number = F.decode("value", "UTF-8").cast("long")
    got = _drain(state.running_sum(stream, number, F.decode("key", "UTF-8"), F.col("offset")), "sums")
    assert {(r.key, r["max(agg)"]) for r in got.groupBy("key").agg(F.max("agg")).collect()} == {("a", 6), ("b", 16), ("c", 10)}
    assert _drain(state.take(stream, 4, F.col("offset")), "taken").count() == 4
    assert _drain(state.idempotent(stream, F.decode("key", "UTF-8"), number, F.col("offset")), "fresh").count() == 5
    assert _drain(state.distinct_first(stream.withColumn("k", F.decode("key", "UTF-8")), "k"), "firsts").count() == 3


def test_windowed_stream(spark, records, tmp_path):
    path = f"file://{tmp_path}/w"
    df = records([("a", "", t) for t in (1000, 2000, 12000, 40000)])
    for k in range(4):
        _land(df.where(F.col("offset") == k), path)
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(state.windowed(stream, "key", "10 seconds"), "windows")
    assert sorted(r["count"] for r in got.collect()) == [1, 2]
    other = spark.readStream.schema(df.schema).parquet(path)
    both = state.interval_join(stream, other, "1 seconds")
    assert _drain(both, "joined").count() == 6


def test_worker_resumes(spark, records, tmp_path):
    path = f"file://{tmp_path}/in"
    _land(records([("a", "1"), ("b", "2")]), path)
    seen = []
    w = Worker(f"file://{tmp_path}/check")
    start = lambda: w.add("c", spark.readStream.schema(records([]).schema).parquet(path), lambda df: seen.extend(bytes(r.value).decode() for r in df.collect()))
    start()
    w.wait()
    _land(records([("c", "3")]), path)
    start()
    w.wait()
    assert seen == ["1", "2", "3"] and w.stats()["c"].records == 3
    w.stop()
    assert w.queries == {}
