"""The similarity join on hubs, long paths and large families."""

import random

from tidelog.llm import blocks, ngram_join
from tidelog.llm.scratch import Scratch

from test_llm import components, family, grams, prose


def test_tables_keep_their_length_as_the_input_grows():
    for total in (10**8, 10**9, 10**12, 10**14):
        ranges, block = blocks.shape(total, 200)
        assert block / ranges / blocks.GRAM_BYTES >= blocks.ROW_GRAMS / 2 and block <= 200 << 20


def test_long_paths_need_few_rounds(spark, monkeypatch):
    n, rounds = 300, []
    names = [f"{k:04d}" for k in range(n)]
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame([*zip(names, names[1:]), ("x", "y")], "u string, v string")
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, tag: rounds.append(tag) or write(self, df, tag))
    got = {r.node: r.label for r in ngram_join.connected(edges, Scratch(spark, "paths"), "p").collect()}
    assert got == {x: "0000" for x in names} | {"x": "x", "y": "x"}
    assert sum("near" in x for x in rounds) <= 11


def test_large_family_is_thinned_out(spark, monkeypatch):
    shipped = []
    tasks = ngram_join._tasks

    def counted(members, near, like):
        out = tasks(members, near, like)
        shipped.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_tasks", counted)
    base = prose(1, 60)
    # near copies of one text, a chain that leads away from it, and ordinary texts
    texts = [*family(400, 1, 1), *[base] * 30, None, ""]
    words = base.split()
    for k in range(12):
        words = words[3:] + [f"z{k}a", f"z{k}b", f"z{k}c"]
        texts.append(" ".join(words))
    texts = dict(enumerate(texts + [prose(k, 30) for k in range(50, 60)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.id: r.component for r in ngram_join.components(df, ngram_join.Likeness(3, 80, 100, 40)).collect()}
    want = components({i: grams(t, 3) for i, t in texts.items()}, 80, 100)
    assert got == want
    # all pairs of chunks would be 400 * 10 rows in a single step; each step ships a few rows a member at most
    assert max(shipped) <= 3 * 442 and len(shipped) >= 4


def test_families_without_a_large_component(spark):
    """Texts of common passages: one family, many components."""
    passages = [prose(k, 12) for k in range(14)]
    r = random.Random(9)
    texts = dict(enumerate(" ".join(r.sample(passages, 4)) for _ in range(150)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {x.id: x.component for x in ngram_join.components(df, ngram_join.Likeness(3, 80, 100, 8)).collect()}
    assert got == components({i: grams(t, 3) for i, t in texts.items()}, 80, 100)
