"""Toxicity from two Kneser-Ney models, one of toxic texts and one of ordinary ones.

Each class has an interpolated Kneser-Ney bigram model: discounted bigram counts, then discounted
continuation counts (how many words a word follows) of the class, then the continuation counts of both
classes together, so that an expression that is rare in either backs off to the same shared estimate
and says nothing. What is compared is the difference of the two log-likelihoods by length: over the whole
document, and over its most toxic passage of ``WINDOW`` words, as a few words in a long text are lost in
the whole's mean. A logistic curve turns the two into a score.

Discounts are not fixed. Those that counts of counts give, and greater ones, are tried on training rows
that the models did not see, and those of the least log loss of the curve are taken. Where most words are
rare, greater discounts win: the more rows there are, the more often an expression has to occur in a class
before it says anything of its own.

The models are fitted on a bounded sample of labelled rows (by default about 1,200 toxic and 4,800
ordinary ones at most, whole texts) and are broadcast as sorted arrays; scoring is one pass in Arrow batches.

Defined cases: null and empty texts have feature 0 and get the score that the curve gives there;
without training rows of both classes every score is the share of toxic rows (0 without rows);
repeated rows give equal scores; discounts that do equally well are taken in the order in which they are
tried; labels, language, source and id play no part in a score, and other columns are not read. A very long
text takes some thirty times its size while it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.memory import tidy
from tidelog.llm.samples import remainder, sample_by_label
from tidelog.llm.words import coded, hashes, joined, pieces, plain

START = np.uint64(0x5D0C)
# Discounts of pairs (texts that have one) and of words (words before one) that are tried beside the estimated ones.
TRIED = ((5.0, 2.0), (20.0, 2.0), (50.0, 5.0))
WINDOW = 2


def bare(words: pa.Array) -> pa.Array:
    """Words without signs at either end."""
    return pc.utf8_trim(words, ".,;:!?\"'`()[]{}<>|*#$%&@~^_=+-/\\…“”‘’«»¡¿")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased and bare, and offsets of the texts."""
    codes, offsets, words = coded(texts, lower="utf8")
    return hashes(bare(words))[codes] if len(words) else np.zeros(0, np.uint64), offsets


def contexts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word before each word; a fixed number at the start of a text."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    v[starts] = START
    return v


@dataclass
class Table:
    """Counts by sorted key."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        return cls(*(lambda k, c: (k, c.astype(np.float64)))(*np.unique(keys, return_counts=True)))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def estimated(counts: np.ndarray) -> float:
    """The discount that counts of counts give: n1 / (n1 + 2 n2); a half where nothing occurs once."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


@dataclass
class KneserNey:
    """One class; ``shared`` has the continuation counts of all classes."""

    pairs: Table
    context: Table  # tokens after a context
    after: np.ndarray  # each pair's context, by its place in ``context``
    follows: Table  # distinct contexts before a word
    shared: Table
    pair_discount: float = 0.0
    discount: float = 0.0
    freed: Table | None = None  # what discounting takes from a context's pairs

    @classmethod
    def of(cls, h: np.ndarray, offsets: np.ndarray) -> tuple[KneserNey, np.ndarray, np.ndarray]:
        """The counts, still without shared ones and discounts; the distinct pairs and their words."""
        v = contexts(h, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
        once = np.unique(joined(owner, v, h), return_index=True)[1]  # a text that repeats itself counts a pair once
        v, h = v[once], h[once]
        key, first, counts = np.unique(joined(v, h), return_index=True, return_counts=True)
        context = Table.of(v)
        return cls(Table(key, counts.astype(float)), context, np.searchsorted(context.keys, v[first]), Table.of(h[first]), Table.of(h[:0])), key, h[first]

    def discounted(self, by: tuple[float, float] | None) -> KneserNey:
        """With discounts for pairs and words; None: the estimated ones."""
        pair, word = by or (estimated(self.pairs.counts), estimated(self.follows.counts))
        freed = np.bincount(self.after, np.minimum(self.pairs.counts, pair), len(self.context.keys))
        return replace(self, pair_discount=pair, discount=word, freed=Table(self.context.keys, freed))

    def log(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        base = (self.shared.get(w) + 0.5) / (self.shared.counts.sum() + 0.5 * (len(self.shared.keys) + 1))
        total = self.follows.counts.sum()
        low = (np.maximum(self.follows.get(w) - self.discount, 0) + np.minimum(self.follows.counts, self.discount).sum() * base) / total if total else base
        c = self.context.get(v)
        high = (np.maximum(self.pairs.get(joined(v, w)) - self.pair_discount, 0) + self.freed.get(v) * low) / np.maximum(c, 1)
        return np.log(np.where(c > 0, high, low))


Models = tuple[KneserNey, KneserNey]


def fit_models(texts: list[str], toxic: np.ndarray) -> Models:
    made = []
    for label in (1, 0):
        own = sorted({t for t, y in zip(texts, toxic, strict=True) if y == label})  # a copied text counts once
        made.append(KneserNey.of(*tokens(plain(pa.array(own, pa.string())))))
    both = np.unique(np.concatenate([m[1] for m in made]), return_index=True)[1]
    shared = Table.of(np.concatenate([m[2] for m in made])[both])
    for m in made:
        m[0].shared = shared
    return made[0][0], made[1][0]


def discounted(models: Models, by: tuple[float, float] | None) -> Models:
    return models[0].discounted(by), models[1].discounted(by)


def features(models: Models, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two columns: the log-likelihood ratio by length, of each whole text and of its most toxic passage."""
    n = np.diff(offsets)
    if not len(h):
        return np.zeros((len(n), 2))
    v = contexts(h, offsets)
    ratio = np.append(0.0, np.cumsum(models[0].log(v, h) - models[1].log(v, h)))
    total = np.round(ratio[offsets[1:]] - ratio[offsets[:-1]], 6)
    # the passage of WINDOW words that ends at each word, or of as many as there are
    owner = np.repeat(np.arange(len(n)), n)
    end = np.arange(len(h))
    start = np.maximum(end - WINDOW + 1, offsets[:-1][owner])
    passage = np.append(np.round((ratio[end + 1] - ratio[start]) / WINDOW, 6), 0.0)
    most = np.where(n > 0, np.maximum.reduceat(passage, offsets[:-1]), 0.0)
    return np.stack([total / np.maximum(n, 1), most], axis=1)


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The curve's mean log loss."""
    z = np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)
    return float(np.mean(np.logaddexp(0, z) - y * z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Scorer:
    models: Models | None
    weights: np.ndarray
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.models is None:
            return np.full(len(texts), self.share)
        x = features(self.models, *tokens(texts))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, folds: int = 4, tried: Sequence[tuple[float, float] | None] = (None, *TRIED)) -> Scorer:
    """Choose discounts and fit the curve on features of rows left out of the models in turn, then the models on all rows."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if toxic.sum() < 2 or (toxic == 0).sum() < 2:
        return Scorer(None, np.zeros(3), share)
    fold = np.empty(len(toxic), int)
    for label in (0, 1):  # each fold has rows of both
        own = np.flatnonzero(toxic == label)
        fold[own] = np.arange(len(own)) % folds
    x = {by: np.zeros((len(toxic), 2)) for by in tried}
    for k in range(folds):
        out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(out):
            models, left = fit_models([texts[i] for i in rest], toxic[rest]), tokens(plain(pa.array([texts[i] for i in out], pa.string())))
            for by in tried:
                x[by][out] = features(discounted(models, by), *left)
    curves = {by: logistic(x[by], toxic) for by in tried}
    best = min(tried, key=lambda by: loss(x[by], toxic, curves[by]))
    return Scorer(discounted(fit_models(texts, toxic), best), curves[best], share)


def predict(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                p = shared.value.score(plain(part.column("text")))
                yield pa.record_batch({"id": part.column("id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())})

    kind = docs.schema[id].dataType.simpleString()
    return docs.selectExpr(f"`{id}` AS id", f"`{text}` AS text").mapInArrow(tidy(run), f"id {kind}, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, quota: dict[int, int]) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``quota`` training rows of each class."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # the chosen ids are at most twice the quotas' sum
    chosen = sample_by_label(usable, "toxic", F.col("doc_id"), quota)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def toxicity_query(docs: DataFrame, labels: DataFrame, toxic: int = 1200, ordinary: int = 4800) -> DataFrame:
    """The digest of op6."""
    rows = sorted(((r.doc_id, r.text or "", r.toxic) for r in training_rows(docs, labels, {1: toxic, 0: ordinary}).toLocalIterator()), key=lambda r: r[:2])
    scorer = fit([r[1] for r in rows], np.array([r[2] for r in rows], float))
    out = predict(docs.select("doc_id", "text"), scorer)
    return out.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 4) == 2).alias("held_out"), "score", "predicted")
