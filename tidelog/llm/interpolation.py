"""Deleted interpolation: a bigram model mixed with shorter ones by how often the context was seen.

p(w | v) = m2 c(v w)/c(v) + m1 c(w)/N + m0 /(V + 1), where the weights m depend on the bucket of c(v):
its whole logarithm to base two. The weights are learned by expectation-maximisation on held-out counts:
a part of the training documents is left out of the counts, and its tokens, as a histogram over (bucket,
log of the bigram's share, log of the word's count), say which weights predict it best. Counts for
scoring are those of all training documents.

Blocks of documents (see ``blocks``) send packed n-gram counts to hash ranges and
get the corpus's counts back where they differ; what is gathered is every distinct n-gram of every
block, so it grows with the corpus. A second reading brings each block's word sequence, as codes, to
where its answers meet; the block then writes the counts that its tokens met, and scoring is one pass
over those once the weights are known. The histogram that comes to the driver has a fixed number of cells.

Words are identified by 64-bit hashes. Text is lower-cased (A to Z); a token is a word, then one end.

Defined cases: null and empty texts are a single end token; without training documents N = V = 0 and
every probability is 1/(V + 1) = 1; repeated rows count as often as they occur and score the same; a
null id is hashed as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm import blocks
from tidelog.llm.memory import small_batches, tidy, tidy_group, tidy_pair
from tidelog.llm.samples import remainder
from tidelog.llm.scratch import Scratch
from tidelog.llm.words import coded, hashes, joined, plain

END = np.uint64(0x0123456789ABCDEF)
START = np.uint64(0xFEDCBA9876543210)
PAIR, WORD = 1, 2  # kinds of tables

# Cells of the histogram: 48 buckets, logs in quarters of an octave.
BUCKETS, CELLS = 48, 200
NONE = CELLS - 1


def bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 0) + 1).astype(np.int64), BUCKETS - 1)


BLOCK = 12 << 20  # bytes of text in a block, at least

# Rows of packed tables: what a block asks of a range, and what it is answered.
TABLE = "range int, block long, kind int, data binary"
TABLE_SCHEMA = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SIZES = 3  # a kind: a range's share of the vocabulary


def sequence(codes: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, document) of all tokens as codes; n_words is the end's code, n_words + 1 the start's."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n + 1)
    ends = offsets[1:] + np.arange(len(n))
    w = np.full(len(codes) + len(n), n_words, np.int64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner] = codes
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[offsets[:-1] + np.arange(len(n))] = n_words + 1
    return w, v, owner


def _tables(w: np.ndarray, v: np.ndarray, role: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, sorted hashes, training counts, the held-out part of those). Role: 0 scored only, 1 counted, 2 held out."""
    base = np.int64(len(h))
    for kind, key in ((PAIR, v * base + w), (WORD, w)):
        distinct, at = np.unique(key, return_inverse=True)
        t = np.bincount(at, role > 0, len(distinct)).astype(np.uint64)
        k = np.bincount(at, role == 2, len(distinct)).astype(np.uint64)
        g = joined(h[distinct // base], h[distinct % base]) if kind == PAIR else h[distinct]
        order = np.argsort(g)
        yield kind, g[order], t[order], k[order]


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words, offsets, and hashes of codes, the end's and the start's at their end."""
    codes, offsets, words = coded(plain(table.column("text")))
    return codes, offsets, np.append(hashes(words), [END, START])


def _ask(ranges: int, most: int):
    """Texts to what their blocks ask of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(blocks.gathered(batches, most)):
            block = blocks.block_number(number)
            codes, offsets, h = _tokens(table)
            w, v, owner = sequence(codes, offsets, len(h) - 2)
            for kind, g, t, held in _tables(w, v, table.column("role").to_numpy()[owner], h):
                made = [(at, blocks.pack(blocks.steps(g[s:e]), t[s:e], held[s:e])) for at, s, e in blocks.split(g, ranges)]
                n = len(made)
                yield pa.record_batch([pa.array([x for x, _ in made], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([x for _, x in made], pa.binary())], schema=TABLE_SCHEMA)

    return run


def _keep(id_type: pa.DataType, most: int):
    """The same texts to their blocks' documents and word sequences: one row a block.

    Both passes read the same splits of the same table, so they cut it into the same blocks.
    """
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("roles", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(blocks.gathered(batches, most)):
            codes, offsets, h = _tokens(table)
            data = blocks.pack(codes.astype(np.uint64), h[:-2])
            yield pa.record_batch([[blocks.block_number(number)], [table.column("id").to_pylist()], [table.column("role").to_pylist()], [(np.diff(offsets) + 1).tolist()], [data]], schema=schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: the corpus's counts, for each block where they differ from its own.

    A block knows its own hashes, so the answer is a bit for each, and counts where the bit is set.
    """
    at = table.column("range")[0].as_py()
    kinds = table.column("kind").to_numpy()
    out = []
    for which in (PAIR, WORD):
        sent = table.filter(pa.array(kinds == which))
        if not sent.num_rows:
            continue
        got = [blocks.unpack(x) for x in sent.column("data").to_pylist()]
        lengths = [len(x[0]) for x in got]
        g = np.concatenate([blocks.walk(x[0]) for x in got])
        own = [np.concatenate([x[c] for x in got]) for c in (1, 2)]
        order = np.argsort(g, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(g[order]) != 0))
        counts = np.diff(np.append(edge, len(order)))
        totals = []
        for x in own:
            full = np.empty_like(x)
            full[order] = np.repeat(np.add.reduceat(x[order], edge), counts)
            totals.append(full)
        if which == WORD:
            known = int((totals[0][order][edge] > 0).sum())
            out.append((at, -1, SIZES, blocks.pack(np.array([known], np.uint64))))
        differs = (totals[0] != own[0]) | (totals[1] != own[1])
        bounds = np.append(0, np.cumsum(lengths))
        for block, s, e in zip(sent.column("block").to_pylist(), bounds, bounds[1:], strict=False):
            d = differs[s:e]
            if d.any():
                bits = np.packbits(np.append(d, np.zeros(-len(d) % 64, bool))).view("<u8")
                out.append((at, block, which, blocks.pack(bits, totals[0][s:e][d], totals[1][s:e][d], g[s:e].sum(keepdims=True))))
    return pa.table([pa.array([x[c] for x in out], f.type) for c, f in enumerate(TABLE_SCHEMA)], schema=TABLE_SCHEMA)


def _quarter(x: np.ndarray) -> np.ndarray:
    """Logs to base two in whole quarters."""
    return np.round(4 * np.log2(x)).astype(np.int64)


def _met_fields(id_type: str) -> str:
    return f"kind int, a long, b long, ids array<{id_type}>, roles array<int>, ns array<long>, known array<long>, logs array<double>, data binary"


DOCUMENTS, VOCABULARY, TOKENS, CELL = 0, 1, 2, 3


def _met(ranges: int, id_type: pa.DataType):
    """One block: the counts that its documents' tokens met; of held-out ones, cells of the histogram too."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(id_type)), ("roles", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("logs", pa.list_(pa.float64())), ("data", pa.binary())])

    def numbers(kind: int, pairs: list[tuple[int, int]]) -> pa.Table:
        rest = [pa.nulls(len(pairs), f.type) for f in list(schema)[3:]]
        return pa.table([pa.array([kind] * len(pairs), pa.int32()), pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64()), *rest], schema=schema)

    def run(kept: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = answers.column("kind").to_numpy() if answers.num_rows else np.zeros(0, int)
        if not kept.num_rows:  # what the ranges say of the vocabulary
            return numbers(VOCABULARY, [(sum(int(blocks.unpack(x)[0][0]) for x in answers.column("data").to_pylist()), 0)])
        codes, vocabulary = blocks.unpack(kept.column("data")[0].as_py())
        n, role = (np.array(kept.column(c)[0].as_py(), np.int64) for c in ("ns", "roles"))
        h = np.append(vocabulary, [END, START])
        w, v, owner = sequence(codes.astype(np.int64), np.append(0, np.cumsum(n - 1)), len(vocabulary))
        roles, base = role[owner], np.int64(len(h))
        counts = {}
        for which, g, t, held in _tables(w, v, roles, h):
            places = {at: (s, e) for at, s, e in blocks.split(g, ranges)}
            own = answers.filter(pa.array(kinds == which)) if answers.num_rows else answers
            for at, data in zip(own.column("range").to_pylist(), own.column("data").to_pylist(), strict=True):
                bits, full, part, asked = blocks.unpack(data)
                s, e = places.get(at, (0, 0))
                if len(bits) != (e - s + 63) // 64 or g[s:e].sum() != asked[0]:
                    raise ValueError("the two readings of the table came in different orders; write it first")
                place = s + np.flatnonzero(np.unpackbits(bits.view(np.uint8)))
                t[place], held[place] = full, part
            counts[which] = g, t, held
        pairs, back = np.unique(v * base + w, return_inverse=True)
        at2 = np.searchsorted(counts[PAIR][0], joined(h[pairs // base], h[pairs % base]))[back]
        # a word is a context as often as it occurs, and the start as often as the end
        words = np.unique(w)
        by_code = np.zeros((2, len(h)), np.uint64)
        at1 = np.searchsorted(counts[WORD][0], h[words])
        for c in (0, 1):
            by_code[c, words] = counts[WORD][c + 1][at1]
            by_code[c, -1] = by_code[c, -2]
        c2, c1 = counts[PAIR][1][at2], by_code[0, w]
        edge = np.append(0, np.cumsum(n))
        known = np.diff(np.append(0, np.cumsum(c1 > 0))[edge])
        logs = np.add.reduceat(np.log10(c1.astype(float) + 1), edge[:-1])
        row = [[DOCUMENTS], [None], [None], kept.column("ids"), kept.column("roles"), kept.column("ns"), [known.tolist()], [logs.tolist()], [blocks.pack(c2, c1, by_code[0, -1:])]]
        out = [pa.table(row, schema=schema), numbers(TOKENS, [(int(n[role > 0].sum()), int(n[role == 1].sum()))])]
        held = roles == 2
        if held.any():
            k2 = (counts[PAIR][1] - counts[PAIR][2])[at2][held].astype(float)
            k1, kv = ((by_code[0] - by_code[1])[x[held]].astype(float) for x in (w, v))
            share = np.where(k2 > 0, np.clip(-_quarter(np.maximum(k2, 1) / np.maximum(kv, 1)), 0, NONE - 1), NONE)
            single = np.where(k1 > 0, np.clip(_quarter(np.maximum(k1, 1)), 0, NONE - 1), NONE)
            cells, found = np.unique((bucket(kv) * CELLS + share) * CELLS + single, return_counts=True)
            out.append(numbers(CELL, list(zip(cells.tolist(), found.tolist(), strict=True))))
        return pa.concat_tables(out)

    return run


def learn(cells: np.ndarray, found: np.ndarray, tokens: float, vocabulary: float, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Weights (bucket, order) by expectation-maximisation over the histogram."""
    single, share, at = cells % CELLS, cells // CELLS % CELLS, cells // CELLS // CELLS
    p = np.stack([np.full(len(cells), 1 / (vocabulary + 1)), np.where(single == NONE, 0, 2.0 ** (single / 4)) / max(tokens, 1), np.where(share == NONE, 0, 2.0 ** (-share / 4))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    total = np.bincount(at, found, BUCKETS)
    for _ in range(rounds):
        part = weights[at] * p
        part *= (found / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(at, part[:, k], BUCKETS) for k in range(3)], axis=1)
        # a few tokens of the last weights keep every weight above nothing
        new = (new + 0.3 / 3) / (total + 0.3)[:, None]
        moved = np.abs(new - weights).max()
        weights = new
        if moved < tolerance:
            break
    return weights


def score(docs: DataFrame, role: object, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, role, n, known, logs, score) of each row, and train_tokens and vocabulary.

    ``role``: a Column, 0 for documents that are scored only, 1 for counted ones, 2 for the held-out part of training.
    """
    scratch = Scratch(docs.sparkSession, "interpolation")
    ranges, most = blocks.layout(docs, BLOCK)
    kind = docs.schema[id].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id].dataType)
    read = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), role.cast("int").alias("role"))
    answers = read.mapInArrow(tidy(_ask(ranges, most)), TABLE).groupBy("range").applyInArrow(tidy_group(_answer), TABLE)
    kept = read.mapInArrow(tidy(_keep(id_type, most)), f"block long, ids array<{kind}>, roles array<int>, ns array<long>, data binary")
    with small_batches(docs.sparkSession):
        met = scratch.write(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(_met(ranges, id_type)), _met_fields(kind)), "met")
    scratch.tidy()
    sums = {r.kind: (float(r.a or 0), float(r.b or 0)) for r in met.where(F.col("kind").isin(VOCABULARY, TOKENS)).groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    tokens, counted = sums.get(TOKENS, (0.0, 0.0))
    vocabulary = sums.get(VOCABULARY, (0.0, 0.0))[0]
    # at most BUCKETS * CELLS * CELLS rows
    cells = met.where(F.col("kind") == CELL).groupBy("a").agg(F.sum("b").alias("b")).toPandas()
    weights = learn(cells["a"].to_numpy(np.int64), cells["b"].to_numpy(float), counted, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c2, c1, first = blocks.unpack(batch.column("data")[k].as_py())
                n = np.array(batch.column("ns")[k].as_py(), np.int64)
                starts = np.append(0, np.cumsum(n))[:-1]
                cv = np.append(0, c1[:-1])
                cv[starts] = first
                m, cv = weights[bucket(cv.astype(float))], cv.astype(float)
                p = m[:, 2] * c2 / np.maximum(cv, 1) + m[:, 1] * c1 / max(tokens, 1) + m[:, 0] / (vocabulary + 1)
                scores = np.add.reduceat(np.log10(p), starts)
                lists = [batch.column(c)[k].values for c in ("ids", "roles", "ns", "known", "logs")]
                yield pa.record_batch([*lists, pa.array(scores, pa.float64())], names=["id", "role", "n", "known", "logs", "score"])

    out = met.where(F.col("kind") == DOCUMENTS).select("ids", "roles", "ns", "known", "logs", "data").mapInArrow(tidy(run), f"id {kind}, role int, n long, known long, logs double, score double")
    return out.withColumns({"train_tokens": F.lit(int(tokens)).cast("long"), "vocabulary": F.lit(int(vocabulary)).cast("long")})


def interpolation_query(docs: DataFrame) -> DataFrame:
    """The digest of op2: remainder 2 is scored only, remainder 3 of the rest is the held-out part."""
    r = remainder(F.col("doc_id"), 7)
    out = score(docs.select("doc_id", "text"), F.when(r == 2, 0).when(r == 3, 2).otherwise(1))
    base = F.col("logs") - F.col("n") * F.log10(F.col("train_tokens") + F.col("vocabulary") + 1.0)
    return out.select(F.col("id").alias("doc_id"), (F.col("role") == 0).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), "train_tokens", base.alias("base_score"), "score")
