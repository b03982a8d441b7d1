"""Language identification: known words first, shorter and shorter character n-grams after that.

A word that training texts hold is scored by its log frequency in each language. An unseen word is
scored by its longest character n-grams that any language knows: five characters, then four, down to
one. A document's language is the one with the highest sum over all its words.

The model is fitted on at most about ``quota`` training documents of each language (whole texts), so it
has a bound that does not grow with the corpus, and is broadcast. Prediction is one pass in Arrow
batches; each distinct word of a batch is scored once.

Words and n-grams that no language has at least twice are left out of the model.

Defined cases: null texts and texts without any letter are ``und`` with score 0; where no word or
character is known all languages tie and the first by name wins; ties go to the first by name; with
no training rows every document is ``und``; repeated rows give equal results; language, source and id
play no part in a prediction, and other columns are not read. A very long text takes about ten times its
size, and for each distinct word a row of the score table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.memory import tidy
from tidelog.llm.samples import remainder, sample_by_label
from tidelog.llm.words import coded, pieces, plain

LONGEST = 5
UNKNOWN = "und"


def letters(word: str) -> str:
    """A word without what is not a letter at either end."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[k : k + n] for k in range(len(w) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length

    def score(self, word: str) -> np.ndarray | None:
        """Log frequencies by language, or None where nothing of the word is known."""
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.grams[n]
            found = [x for g in grams(word, n) if (x := table.get(g)) is not None]
            if found:
                return sum(found) / len(found)
        return None


def logs(counts: list[Counter], least: int = 1) -> dict[str, np.ndarray]:
    """Smoothed log frequencies of what any language has at least ``least`` times."""
    known = {k for c in counts for k, n in c.items() if n >= least}
    totals = [sum(c.values()) + 0.5 * (len(known) + 1) for c in counts]
    return {k: np.array([math.log((c[k] + 0.5) / t) for c, t in zip(counts, totals, strict=True)], np.float32) for k in known}


def fit(rows: Iterable[tuple[str, str]]) -> Model:
    """A model from (text, language) pairs."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(w for x in text.lower().split() if (w := letters(x)))
    languages = sorted(words)
    counts = [words[k] for k in languages]
    tables: list[dict[str, np.ndarray]] = [{}]
    for n in range(1, LONGEST + 1):
        by = []
        for c in counts:
            own: Counter = Counter()
            for w, k in c.items():
                for g in grams(w, n):
                    own[g] += k
            by.append(own)
        tables.append(logs(by, 2))
    return Model(languages, logs(counts, 2), tables)


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of each row; the score is the winner's share of the likelihoods."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n_lang = len(m.languages)
        seen: dict[str, np.ndarray | None] = {}
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                codes, offsets, words = coded(plain(part.column("text")), lower="utf8")
                table = np.zeros((len(words) + 1, n_lang))
                lettered = np.zeros(len(words) + 1, bool)
                if len(seen) > 500_000:
                    seen.clear()
                for k, w in enumerate(words.to_pylist()):
                    lettered[k] = any(map(str.isalpha, w))
                    core = letters(w)
                    if core not in seen:
                        seen[core] = m.score(core) if core else None
                    if (s := seen[core]) is not None:
                        table[k] = s
                n = len(offsets) - 1
                # sums over each text's words; one more code at the end keeps empty texts in range
                at = np.append(codes, len(words))
                full = np.add.reduceat(table[at], offsets[:-1], axis=0) if n else np.zeros((0, n_lang))
                has = np.logical_or.reduceat(lettered[at], offsets[:-1]) if n else np.zeros(0, bool)
                has &= np.diff(offsets) > 0
                full[~has] = 0
                if n_lang:
                    best = full.argmax(axis=1)
                    share = 1 / np.exp(np.maximum(full - full.max(axis=1, keepdims=True), -700)).sum(axis=1)
                    names = np.array(m.languages, object)[best]
                else:
                    names, share = np.full(n, UNKNOWN, object), np.zeros(n)
                    has &= False
                yield pa.record_batch({"id": part.column("id"), "lang_pred": pa.array(np.where(has, names, UNKNOWN), pa.string()), "score": pa.array(np.where(has, share, 0.0), pa.float64())})

    kind = docs.schema[id].dataType.simpleString()
    return docs.selectExpr(f"`{id}` AS id", f"`{text}` AS text").mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double")


def langid_query(docs: DataFrame, quota: int = 1000) -> DataFrame:
    """The digest of op8."""
    train = docs.where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sample_by_label(train.select("doc_id", "text", "lang"), "lang", F.col("doc_id"), quota).select("text", "lang")
    model = fit((r.text, r.lang) for r in rows.toLocalIterator(prefetchPartitions=False))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")
