"""Models and codecs against plain Python: probabilities, frequencies, transforms, rounding."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import bpe, langid, media, mixing, queries, toxicity
from tidelog.llm.words import plain


# -- toxicity: the interpolated estimates, from counters
def kneser_ney(texts, others, pair_discount, discount):
    """p(w | v) of one class; ``others``: the texts of the other one."""

    def pairs(all_texts):
        out = collections.Counter()
        for t in sorted(set(all_texts)):
            w = t.split()
            out.update(set(zip(["<"] + w, w)))
        return out

    own = pairs(texts)
    both = set(own) | set(pairs(others))
    shared = collections.Counter(w for _, w in both)
    follows = collections.Counter(w for _, w in own)
    context = collections.Counter()
    freed = collections.Counter()
    for (v, _), c in own.items():
        context[v] += c
        freed[v] += min(c, pair_discount)

    def p(v, w):
        base = (shared[w] + 0.5) / (sum(shared.values()) + 0.5 * (len(shared) + 1))
        low = (max(follows[w] - discount, 0) + sum(min(c, discount) for c in follows.values()) * base) / sum(follows.values())
        return (max(own[v, w] - pair_discount, 0) + freed[v] * low) / context[v] if context[v] else low

    return p, sorted(shared)


@pytest.mark.parametrize("by", [(0.75, 0.5), (2.0, 1.0)])
def test_kneser_ney_is_brute_force(by):
    r = random.Random(1)
    text = lambda words: " ".join(r.choices(words, k=r.randint(1, 30)))
    toxic, ordinary = [text("abcdexyz") for _ in range(20)], [text("abcdefgh") for _ in range(40)]
    models = toxicity.discounted(toxicity.fit_models(toxic + ordinary, np.array([1] * 20 + [0] * 40)), by)
    new = ["a b x q", "h h h", "z", "q q a", ""]
    h, offsets = toxicity.tokens(plain(pa.array(new)))
    v = toxicity.contexts(h, offsets)
    ratio = np.zeros(len(h))
    for sign, model, own, rest in ((1, models[0], toxic, ordinary), (-1, models[1], ordinary, toxic)):
        p, vocabulary = kneser_ney(own, rest, *by)
        want = [math.log(p(a, b)) for t in new for a, b in zip(["<"] + t.split(), t.split())]
        assert np.allclose(model.log(v, h), want)
        ratio += sign * np.array(want)
        # with one place for what no class has seen, a context's estimates add up to one
        for a in ("<", "a", "never"):
            assert math.isclose(sum(p(a, b) for b in [*vocabulary, "unseen"]), 1, rel_tol=1e-9)
    x = toxicity.features(models, h, offsets)
    for k, t in enumerate(new):
        own = ratio[offsets[k] : offsets[k + 1]]
        windows = [(own[max(0, j - 1) : j + 1].sum()) / 2 for j in range(len(own))]
        assert np.allclose(x[k], [own.mean() if t else 0, max(windows, default=0)], atol=1e-5)


def test_discounts_come_from_counts_or_from_rows_left_out():
    assert toxicity.estimated(np.array([1, 1, 1, 2, 5])) == 3 / 5 and toxicity.estimated(np.array([3.0])) == 0.5
    r = random.Random(2)
    rare = lambda: " ".join(f"w{r.randrange(10**5)}" for _ in range(40))
    texts = [rare() + " vile" * (k % 3 == 0) for k in range(300)]
    toxic = np.array([k % 3 == 0 for k in range(300)], float)
    scorer = toxicity.fit(texts, toxic)
    assert scorer.models[0].pair_discount > 1  # most words are rare and say nothing
    p = scorer.score(plain(pa.array([rare(), rare() + " vile", ""])))
    assert p[1] > 0.9 > 0.3 > p[0] and len(p) == 3


# -- language: words, then n-grams
def test_language_scores_are_brute_force():
    rows = [("the cat the dog sat", "en"), ("the house sat", "en"), ("die katze die maus saß", "de"), ("die katze das haus", "de")]
    model = langid.fit(rows)
    counts = {k: collections.Counter(w for t, x in rows if x == k for w in t.split()) for k in ("de", "en")}

    def log(table, item):
        known = {x for c in table.values() for x, n in c.items() if n >= 2}
        return [math.log((table[k][item] + 0.5) / (sum(table[k].values()) + 0.5 * (len(known) + 1))) for k in ("de", "en")] if item in known else None

    def grams(n):
        out = {k: collections.Counter() for k in counts}
        for k, c in counts.items():
            for w, m in c.items():
                s = f"^{w}$" if n > 1 else w
                for j in range(len(s) - n + 1):
                    out[k][s[j : j + n]] += m
        return out

    def score(word):
        if (found := log(counts, word)) is not None:
            return found
        for n in range(min(5, len(word) + 2), 0, -1):
            s = f"^{word}$" if n > 1 else word
            hits = [x for j in range(len(s) - n + 1) if (x := log(grams(n), s[j : j + n])) is not None]
            if hits:
                return [sum(c) / len(hits) for c in zip(*hits)]
        return None

    for word in ("the", "die", "cat", "katzen", "mausen", "sat", "x", "qqq", "haus"):
        got, want = model.score(word), score(word)
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want, atol=1e-5)), word


# -- pictures
@pytest.mark.parametrize("size", [64, 640, 64 * 33, 64 * 100])
def test_cosine_hash_is_the_plain_transform(size):
    rng = np.random.default_rng(size)
    rows = rng.integers(0, 256, size, dtype=np.uint8).reshape(-1, 64)
    h = len(rows)
    # means over areas of a 32 x 32 grid
    edge = lambda n, k: (k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32))
    small = [[float(np.mean([[float(v) for v in row[slice(*edge(64, j))]] for row in rows[slice(*edge(h, i))]])) for j in range(32)] for i in range(32)]
    c = lambda u, i: math.cos(math.pi * u * (2 * i + 1) / 64)
    low = [round(sum(small[i][j] * c(u, i) * c(v, j) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = [x > middle for x in low]
    want = bytes(sum(b << (7 - k) for k, b in enumerate(bits[at : at + 8])) for at in range(0, 64, 8))
    assert media.cosine_hash(rows) == want


def test_like_pictures_have_like_hashes():
    text = ("a line of words that goes on and on\n" * 200).encode()
    one, two = (media.decode(media.encode(media.padded(t))) for t in (text, text[:-30] + b"x" * 30))
    bits = lambda x: int.from_bytes(media.cosine_hash(x), "big")
    assert (bits(one) ^ bits(two)).bit_count() <= 16


# -- mixing: the rates are the tilt that meets the target, and copies are those rates
def test_rates_solve_the_dual(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randint(1, 9)), "ab"[k % 2]) for k in range(3000)]
    got = mixing.mixing_query(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {k: s for k, _, s in rows}
    for s in "ab":
        own = [x for x in got if source[x.doc_id] == s]
        total, target = own[0].source_size, own[0].target
        mean = total / len(own)
        rate = {x.size: x.rate for x in own}
        lo, hi = -100.0, 100.0
        for _ in range(200):  # bisection, in place of Newton's steps
            lam = (lo + hi) / 2
            if sum(2 / (1 + math.exp(-lam * x.size / mean)) * x.size for x in own) < target:
                lo = lam
            else:
                hi = lam
        assert all(abs(rate[z] - 2 / (1 + math.exp(-lam * z / mean))) < 1e-5 for z in rate)
        for z in rate:  # systematic rounding: copies of one size are its rate's whole part or one more
            copies = [x.copies for x in own if x.size == z]
            assert set(copies) <= {math.floor(rate[z]), math.ceil(rate[z])} and abs(sum(copies) - rate[z] * len(copies)) < 2


# -- tokens: threads change nothing
def test_threads_give_the_same_tokens():
    texts = ["word " * 5000 + "é" * 9000, "", "x" * 20000, "short"]
    one, many = (bpe.TreeBpe(queries.tokenizer_path(), 512, threads) for threads in (1, 4))
    assert all((a == b).all() for a, b in zip(one.encode_batch(texts), many.encode_batch(texts), strict=True))


def test_carried_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, _text string, _text_ string")
    out = bpe.digest(df, queries.tokenizer_path(), columns=("doc_id", "_text", "_text_")).first()
    assert (out["_text"], out["_text_"], out.n_tokens) == ("x", "y", 2)
