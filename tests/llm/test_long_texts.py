"""Very long lines and texts: no operator may recurse with them, nor take quadratic time."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tidelog.llm import licenses, line_rules, secrets

MANY = 100_000


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")


@pytest.fixture
def within():
    """Fails where a test took longer than it would if it grew faster than its input."""
    began = time.monotonic()
    yield
    assert time.monotonic() - began < 100


def test_long_lines(spark, within):
    texts = ["home " * MANY, "home " * MANY + "prose", "a|b " * MANY, "x" * 1_000_000, "日本語 " * MANY, "=\n" * MANY, "a b c d " + "y" * 1_000_000, "-" * MANY + " home", "Home - Contact us | LOG IN » sign up"]
    got = {r.doc_id: r for r in line_rules.quality_query(frame(spark, texts)).collect()}
    assert [got[k].n_words for k in range(len(texts))] == [len(t.split()) for t in texts]
    assert [got[k].n_failed_lines for k in (0, 1, 2, 7, 8)] == [1, 0, 1, 1, 1]
    assert got[0].n_repeat_words == MANY and got[2].n_repeat_words == MANY


def test_navigation_patterns_agree():
    whole = re.compile(line_rules.NAVIGATION, re.ASCII)
    item, start = re.compile(line_rules.ITEM, re.ASCII), re.compile(rf"^\W*{line_rules.ITEM.removeprefix('(?i)')}", re.ASCII | re.IGNORECASE)
    parts = ["home", "about", "about us", "us", "log in", "login", "in", "skip to content", "skip to main content", "print", "homes", "x", "-", " ", "|", "日", "SIGN UP", "sign", "up", "share this", "share", "this"]
    lines = [a + s + b + t + c for a in parts for b in parts for c in ("", "faq", "us", "x") for s in (" ", "", "-") for t in (" ", "")]
    assert all(bool(whole.match(x)) == bool(start.match(x) and not re.search(r"\w", item.sub("", x), re.ASCII)) for x in lines)


def test_many_licence_sentences(spark, within):
    s = licenses.SENTENCES
    known = s["mit-grant"] + ". " + (s["bsd-source"] + ". ") * MANY + s["mit-condition"] + ". " + s["mit-asis"] + "."
    addresses = "license " + "://" * MANY + " x"
    got = {r.doc_id: r for r in licenses.licenses_query(frame(spark, [known, (s["gpl-see"] + ".\n") * MANY, addresses])).collect()}
    assert (got[0].n_sentences, got[0].license, got[0].form) == (MANY + 3, "MIT", "full")
    assert (got[1].n_sentences, got[1].license) == (MANY, None) and got[2].n_sentences == 0


def test_rule_patterns_agree(spark):
    ids = [",".join(x) for x in (("a",), ("a", "b"), ("b", "a"), ("a", "x", "b"), ("a", "a", "b", "c"), ("ab", "b", "c"), ("a", "c", "b", "x", "c"), ())]
    df = spark.createDataFrame([(x,) for x in ids], "ids string")
    for rule in (("a",), ("a", "b"), ("a", "b", "c"), ("b", "c")):
        got = {r.ids: r.hit for r in df.select("ids", licenses.follows_rule(F.col("ids"), rule).alias("hit")).collect()}
        assert got == {x: bool(re.search(licenses.rule_pattern(rule), x)) for x in ids}


def test_many_secrets(spark, within):
    value = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:32]
    text = "é😀 " + "\n".join(f"token = {value(k)} z" for k in range(MANY // 4)) + "\n" + "plain " * MANY
    df = frame(spark, [text])
    got = secrets.secrets_query(df).first()
    spans = [(k, m.start(), m.end()) for k, p in (("assign", r"token = [0-9a-f]{32}"), ("hex", r"[0-9a-f]{24,}")) for m in re.finditer(p, text)]
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))
    assert (got.n_assign, got.n_hex, got.n_owned) == (MANY // 4,) * 3 and got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    clean = secrets.redacted(df, F.col("source"), F.col("lang")).first().clean_text
    assert clean == re.sub("[0-9a-f]{32}", "<secret>", text)
