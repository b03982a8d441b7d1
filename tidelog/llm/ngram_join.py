"""Similarity join of documents on word n-grams: multiple-global-order filtering.

A document's set has its distinct n-grams of ``words`` words. Two documents link when
den * |intersection| >= num * |union|. If they do, then under any one order of all n-grams they share
one among their first |set| - ceil(num/den |set|) + 1. Here three orders are used, all of which put
n-grams of a single document first: by frequency, and two random ones. Candidates share a first n-gram
by frequency; pairs that do not share one under each of the other orders too are dropped, and what is
left is verified exactly.

Only n-grams that several documents have can be shared, so blocks of documents (see ``blocks``) learn
the corpus frequency of those alone, and prefixes and intersections are computed from them: n-grams
of one document count by number. Documents with equal sets are one class and are compared once.

Classes that are candidates of each other, directly or through others, form families. Most fit into a
chunk and are verified by one task, which keeps a union-find so that pairs that are already connected
are not verified again. A larger family is thinned out: chunks of it are verified, then one member of
each component found, and so on while they get fewer; in the end only members of different components
meet that share a first n-gram (or, where one component has all but a few chunks of a family, those few
with all), each pair of chunks in one task. So a family of near copies costs in proportion to its size,
and no link between different components is left out. No step emits all pairs of a group: tasks return
links that span what they connected, and connected components of those are the answer.

A very long text is one row in one block, which then is larger than others by as much; its task needs
about ten times its size. Defined cases: null and empty texts have an empty set and link with nothing, equal ones included; a
text of fewer words than ``words`` has its whole sequence as its only n-gram; repeated rows and equal
texts are in one component, named by the smallest id; a null id is larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import blocks
from tidelog.llm.memory import small_batches, tidy, tidy_group
from tidelog.llm.scratch import Scratch
from tidelog.llm.words import chained, coded, hashes, joined, mixed, plain

SPREAD = 64  # documents of a block that travel together
TOP = np.uint64(0xFFFFFFFFFFFFFF00)  # 56 bits tell n-grams apart; the others would only travel
SECOND, THIRD = np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0x1234567FEDCBA987)


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    num: int = 80
    den: int = 100
    chunk: int = 500  # members of a family in one chunk


def ngram_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram hash), distinct and sorted, as two arrays."""
    codes, offsets, dictionary = coded(texts)
    h = hashes(dictionary)[codes] if len(dictionary) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(np.arange(len(h)) + words <= offsets[1:][owner]) if len(h) else np.zeros(0, np.int64)
    docs, grams = [owner[whole]], [chained(h[whole + k] for k in range(words))]
    for size in range(1, words):
        short = np.flatnonzero(n == size)
        docs.append(short)
        # the length sets these apart from full n-grams
        grams.append(joined(*(h[offsets[short] + k] for k in range(size)), np.full(len(short), size, np.uint64)))
    owner, grams = np.concatenate(docs), np.concatenate(grams) & TOP
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[keep], grams[keep]


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums by document, modulo 2^64."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _send(like: Likeness, ranges: int, most: int):
    """Texts to rows for the ranges, and a row for each distinct set of a block with all documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(blocks.gathered(batches, most)):
            block, n = blocks.block_number(k), table.num_rows
            owner, grams = ngram_sets(plain(table.column("text")), like.words)
            size = np.bincount(owner, minlength=n)
            a, b = _sums(mixed(grams), owner, n), _sums(mixed(grams ^ SECOND), owner, n)
            # of equal sets in a block one is sent
            sets, first, which = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
            place = np.full(n, -1)
            place[first] = np.arange(len(first))
            owner = place[owner]
            grams, owner = grams[owner >= 0], owner[owner >= 0]
            order = np.argsort(grams, kind="stable")
            owner, grams = owner[order].astype(np.uint64), grams[order]
            own = pa.array(np.argsort(which, kind="stable"))
            edges = pa.array(np.append(0, np.cumsum(np.bincount(which, minlength=len(first)))).astype(np.int32))
            listed = lambda c: pa.ListArray.from_arrays(edges, flat(table.column(c)).take(own))
            signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
            schema = table_schema(table.schema.field("id").type)
            # documents travel beside the ranges, some to each
            beside = ranges + (blocks.home(block, ranges) + np.arange(len(first)) // SPREAD) % ranges
            yield from pa.table(
                blocks.rows(len(first), range=pa.array(beside, pa.int32()), block=block, idx=pa.array(np.arange(len(first))), ids=listed("id"), marks=listed("mark"), n=pa.array(size[first]), a=signed(sets[:, 0]), b=signed(sets[:, 1]), data=None), schema=schema
            ).to_batches()
            sent = [(at, blocks.pack(blocks.steps(grams[s:e]), owner[s:e])) for at, s, e in blocks.split(grams, ranges)]
            yield pa.record_batch(
                blocks.rows(len(sent), range=pa.array([x for x, _ in sent], pa.int32()), block=block, idx=None, ids=None, marks=None, n=None, a=None, b=None, data=pa.array([x for _, x in sent], pa.binary())), schema=schema
            )

    return run


def table_schema(id_type: pa.DataType) -> pa.Schema:
    types = {"range": pa.int32(), "block": pa.int64(), "idx": pa.int64(), "ids": pa.list_(id_type), "marks": pa.list_(pa.int64()), "n": pa.int64(), "a": pa.int64(), "b": pa.int64(), "data": pa.binary()}
    return pa.schema(list(types.items()))


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: which n-grams several documents have, and how many, by block."""
    docs = table.filter(pa.compute.is_null(table.column("data")))
    sent = table.filter(pa.compute.is_valid(table.column("data")))
    if not sent.num_rows:
        return docs
    got = [blocks.unpack(x) for x in sent.column("data").to_pylist()]
    grams = np.concatenate([blocks.walk(g[0]) for g in got])
    owner = np.concatenate([g[1] for g in got])
    source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    order = np.argsort(grams, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(grams[order]) != 0))
    counts = np.diff(np.append(edge, len(order)))
    df = np.empty(len(order), np.int64)
    df[order] = np.repeat(counts, counts)
    several = df > 1
    grams, owner, df, source = grams[several], owner[several], df[several].astype(np.uint64), source[several]
    bounds = np.searchsorted(source, np.arange(len(got) + 1))
    home = sent.column("block").to_pylist()
    data = [(home[k], blocks.pack(blocks.steps(grams[s:e]), owner[s:e], df[s:e])) for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)) if e > s]
    n = len(data)
    if not n:
        return docs
    made = pa.table(blocks.rows(n, range=0, block=pa.array([x[0] for x in data], pa.int64()), idx=None, ids=None, marks=None, n=None, a=None, b=None, data=pa.array([x[1] for x in data], pa.binary())), schema=table.schema)
    return pa.concat_tables([docs, made])


CANDIDATE = "a long, b long, n long, prefix int, shared array<long>, p1 array<long>, heads array<long>, ties array<struct<a: long, b: long>>"


def _candidates(like: Likeness):
    """One block: documents that share a first n-gram with another, with their shared n-grams and prefixes."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_null(table.column("data"))).sort_by("idx")
        data = [blocks.unpack(x) for x in table.column("data").to_pylist() if x is not None]
        pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("prefix", pa.int32()), *[(k, pa.list_(pa.int64())) for k in ("shared", "p1", "heads")], ("ties", pa.list_(pair))])
        if not data or not own.num_rows:
            return kinds.empty_table()
        grams = np.concatenate([blocks.walk(d[0]) for d in data])
        owner = np.concatenate([d[1] for d in data]).astype(np.int64)
        df = np.concatenate([d[2] for d in data])
        n = own.column("n").to_numpy()
        several = np.bincount(owner, minlength=len(n))
        # how many of the shared n-grams the prefix still holds after those of one document
        left = np.maximum(n - (like.num * n + like.den - 1) // like.den + 1 - (n - several), 0)
        left[several == 0] = 0
        chosen = np.flatnonzero(left)
        pick = np.zeros(len(n), bool)
        pick[chosen] = True
        inside = pick[owner]
        grams, owner, df = grams[inside], owner[inside], df[inside]
        order = np.lexsort((grams, df, owner))
        o = owner[order]
        place = np.arange(len(o)) - np.repeat(np.searchsorted(o, chosen), several[chosen])
        first = grams[order][place < left[o]]
        prefix = np.minimum(left, several)[chosen]
        # within the block each prefix n-gram ties its documents to the first of them, which alone stands for it outside
        holder = np.repeat(np.arange(len(chosen)), prefix)
        by = np.lexsort((holder, first))
        g, h = first[by], holder[by]
        new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
        centre = h[np.flatnonzero(new)][np.cumsum(new) - 1] if len(g) else h
        heads, head_of = g[new], h[new]
        tie = np.unique(h[~new] * len(chosen) + centre[~new])
        tied, to = tie // max(len(chosen), 1), tie % max(len(chosen), 1)
        lists = [(grams[np.argsort(owner, kind="stable")], several[chosen]), (first, prefix), (heads[np.argsort(head_of, kind="stable")], np.bincount(head_of, minlength=len(chosen)))]
        offsets = lambda c: pa.array(np.append(0, np.cumsum(c)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets(c), pa.array(g.view(np.int64))) for g, c in lists]
        a, b, size = (own.column(k).take(pa.array(chosen)).combine_chunks() for k in ("a", "b", "n"))
        ends = pa.StructArray.from_arrays([flat(x).take(pa.array(to)) for x in (a, b)], fields=list(pair))
        return pa.table([a, b, size, pa.array(prefix.astype(np.int32)), *arrays, pa.ListArray.from_arrays(offsets(np.bincount(tied, minlength=len(chosen))), ends)], schema=kinds)

    return run


def flat(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _links(like: Likeness):
    """Groups in chunks: links that span what is connected and was not known to be."""
    out = pa.schema([("u", pa.string()), ("v", pa.string())])

    def one(m: dict[str, list], flat: dict[str, tuple[np.ndarray, np.ndarray]], lo: int, hi: int, links: list[tuple[str, str]]) -> None:
        """Members lo..hi of the sorted table; sizes rise, and sides differ where two chunks meet."""
        size, side = m["n"][lo:hi], m["side"][lo:hi]
        parts = {}
        for k, (values, offsets) in flat.items():
            v = values[offsets[lo] : offsets[hi]]
            codes = np.unique(v, return_inverse=True)[1] if len(v) else v.astype(np.int64)
            parts[k] = codes, offsets[lo : hi + 1] - offsets[lo], np.zeros(codes.max(initial=-1) + 1, bool)
        count = hi - lo
        label = np.unique(m["label"][lo:hi], return_inverse=True)[1]
        two = side.min() != side.max()
        for x in range(count - 1):
            y = np.arange(x + 1, count)
            y = y[(label[y] != label[x]) & (like.den * size[x] >= like.num * size[y])]
            if two:
                y = y[side[y] != side[x]]
            for k in ("p1", "p2", "p3", "shared"):
                if not len(y):
                    break
                codes, offsets, mark = parts[k]
                own = codes[offsets[x] : offsets[x + 1]]
                mark[own] = True
                lengths = offsets[y + 1] - offsets[y]
                at = np.repeat(offsets[y] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                common = np.add.reduceat(mark[codes[at]].astype(np.int64), np.append(0, np.cumsum(lengths)[:-1]))
                mark[own] = False
                if k != "shared":
                    y = y[common > 0]
                else:
                    y = y[like.den * common >= like.num * (size[x] + size[y] - common)]
            for z in y.tolist():
                if label[z] != label[x]:
                    links.append((m["key"][lo + x], m["key"][lo + z]))
                    label[label == label[z]] = label[x]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("n", "ascending"), ("key", "ascending")]).combine_chunks()
        m = {"n": table.column("n").to_numpy(), "side": table.column("side").to_numpy(), "key": table.column("key").to_pylist(), "label": table.column("label").to_numpy()}
        flat = {}
        for k in ("shared", "p1"):
            lists = table.column(k).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat[k] = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
        # the prefixes under the two random orders
        values, offsets = flat["shared"]
        prefix = table.column("prefix").to_numpy().astype(np.int64)
        grams, owner = values.view(np.uint64), np.repeat(np.arange(len(prefix)), np.diff(offsets))
        for k, seed in (("p2", SECOND), ("p3", THIRD)):
            order = np.lexsort((mixed(grams ^ seed), owner))
            head = np.arange(len(order)) - offsets[:-1][owner] < prefix[owner]
            flat[k] = values[order][head], np.append(0, np.cumsum(prefix))
        names = list(zip(table.column("family").to_pylist(), table.column("i").to_pylist(), table.column("j").to_pylist(), strict=True))
        links: list[tuple[str, str]] = []
        lo = 0
        for hi in range(1, len(names) + 1):
            if hi == len(names) or names[hi] != names[lo]:
                one(m, flat, lo, hi, links)
                lo = hi
        return pa.table([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], schema=out)

    return run


def connected(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) of the nodes of edges (u, v): the smallest node that each reaches.

    In each round a node takes the smallest label of its neighbours, hands it to the node that was its
    label (so that a whole tree hangs itself below a smaller one at once), then takes its label's own
    label. Paths halve, so rounds grow with the logarithm of the longest one. Labels stay in written
    tables. Minima have a partial form, and a hub's label meets its many edges in a plain join.
    """
    both = scratch.write(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{tag}-edges")
    labels = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")), f"{tag}-0")
    k = 0
    while labels.where("moved").head(1):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        own = labels.select("node", "label").join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        own = scratch.write(own, f"{tag}-near-{k}")
        hung = own.where("label < old").select(F.col("old").alias("node"), "label").unionByName(own.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        far = hung.select(F.col("node").alias("at"), F.col("label").alias("far"))
        done = hung.join(far, F.col("label") == F.col("at")).select("node", F.least("label", "far").alias("label"))
        before = own.select(F.col("node").alias("at"), "old")
        done = done.join(before, F.col("node") == F.col("at")).select("node", "label", (F.col("label") != F.col("old")).alias("moved"))
        k += 1
        labels = scratch.write(done, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        scratch.drop(f"{tag}-near-{k - 1}")
    scratch.drop(f"{tag}-edges")
    return labels.select("node", "label")


def _tasks(members: DataFrame, near: DataFrame, like: Likeness) -> DataFrame:
    """Rows for ``_links`` of groups' members (family, key, label): those whose labels differ have to meet.

    Groups of up to a chunk are dealt out together. Of a larger one, members of its largest label never
    meet each other: they are cut into chunks of their own, which meet only the chunks of the others.
    """
    counts = members.groupBy("family", "label").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("family").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1")
    several = F.col("size") > like.chunk
    cut = lambda n: F.ceil(n / like.chunk).cast("int")
    tops = F.when(several & (F.col("most") > 1), cut(F.col("most"))).otherwise(F.lit(0))
    rest = F.when(F.col("tops") > 0, cut(F.col("size") - F.col("most"))).otherwise(cut(F.col("size")))
    sizes = sizes.withColumn("tops", tops).withColumn("rest", rest)
    own = members.join(sizes, "family")
    is_top = (F.col("tops") > 0) & (F.col("label") == F.col("top"))
    placed = own.withColumn("own", F.when(is_top, F.pmod(F.xxhash64("key"), F.col("tops"))).otherwise(F.col("tops") + F.pmod(F.xxhash64("label"), F.col("rest"))).cast("int"))
    first = F.when(F.col("own") < F.col("tops"), F.col("tops")).otherwise(F.lit(0))
    placed = placed.withColumn("other", F.explode(F.sequence(first, F.col("tops") + F.col("rest") - 1)))
    rows = placed.select("family", "key", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), F.when(several, F.col("family")).alias("large"))
    deal = F.when(F.col("large").isNull(), F.pmod(F.xxhash64("family"), F.lit(1 << 20)))
    return rows.withColumn("task", deal).join(near.select("key", "n", "prefix", "shared", "p1"), "key")


LINK = "u string, v string"


def _verified(tasks: DataFrame, like: Likeness, number: int) -> DataFrame:
    """Links of rows from ``_tasks``; groups of up to a chunk share ``number`` tasks."""
    tasks = tasks.withColumn("task", F.pmod("task", F.lit(max(1, number))))
    return tasks.groupBy("task", "large", "i", "j").applyInArrow(tidy_group(_links(like)), LINK)


def _family_links(near: DataFrame, families: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """Links that span what is connected within families (key, family, size); ``near`` has a row for each key."""
    whole = families.where(F.col("size") <= like.chunk).select("family", "key", F.col("key").alias("label"))
    links = [scratch.write(_verified(_tasks(whole, near, like), like, families.count() // like.chunk * 4), "links")]
    large = families.where(F.col("size") > like.chunk).select("key", "family")
    if not large.head(1):
        return links[0]
    # large ones: chunks of them first, then one member of each component found, as long as that thins them out
    large = scratch.write(large.withColumn("label", F.col("key")), "large-0")
    k, left = 0, large.count()
    while True:
        heads = large.where("label = key")
        dealt = heads.join(heads.groupBy("family").agg(F.ceil(F.count("*") / like.chunk).alias("parts")), "family")
        groups = dealt.select(F.concat_ws("/", "family", F.pmod(F.xxhash64("key", F.lit(k)), F.col("parts")).cast("string")).alias("family"), "key", "label")
        links.append(scratch.write(_verified(_tasks(groups, near, like), like, left // like.chunk * 4), f"links-{k}"))
        made = connected(links[-1], scratch, f"thin-{k}")
        found = large.join(made.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("key", "family", F.coalesce("new", "label").alias("label"))
        k += 1
        large = scratch.write(found, f"large-{k}")
        scratch.drop(f"large-{k - 1}")
        before, left = left, large.where("label = key").count()
        if left * 2 > before:
            break
    # what may still be linked: in families that one component fills but for a few chunks, those few with all;
    # in the others, what shares a first n-gram
    counts = large.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family").agg((F.sum("c") - F.max("c")).alias("rest"), F.count("*").alias("labels"))
    open_ = large.join(counts.where("labels > 1"), "family")
    few = F.col("rest") <= like.chunk * 8
    grams = open_.where(~few).join(near.select("key", F.explode("p1").alias("gram")), "key").select(F.concat_ws("/", "family", F.hex("gram")).alias("family"), "key", "label")
    last = open_.where(few).select("family", "key", "label").unionByName(grams)
    links.append(scratch.write(_verified(_tasks(last, near, like), like, left // like.chunk * 4), "links-last"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def components(docs: DataFrame, like: Likeness = Likeness(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, n, component) of each row: a hash of its text, its set's size, its component's smallest id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    ranges, most = blocks.layout(docs)
    read = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    schema = f"range int, block long, idx long, ids array<{docs.schema[id].dataType.simpleString()}>, marks array<long>, n long, a long, b long, data binary"
    with small_batches(spark):
        found = scratch.write(read.mapInArrow(tidy(_send(like, ranges, most)), schema).groupBy("range").applyInArrow(tidy_group(_answer), schema), "found")
    scratch.tidy()
    # a row for each block and distinct set: copies shrink before they meet
    rows = scratch.write(found.where(F.col("data").isNull()).select("ids", "marks", "n", "a", "b"), "rows")
    name = lambda x: F.concat(F.lpad(F.hex(x("a")), 16, "0"), F.lpad(F.hex(x("b")), 16, "0"))
    key = name(F.col).alias("key")
    near = found.select("block", "idx", "n", "a", "b", "data").groupBy("block").applyInArrow(tidy_group(_candidates(like)), CANDIDATE)
    near = scratch.write(near.select(key, "*"), "near")
    scratch.drop("found")
    scratch.tidy()

    # families: each prefix n-gram ties its documents to the smallest of them, in each block and then of blocks
    heads = near.select("key", F.explode("heads").alias("gram"))
    centre = heads.groupBy("gram").agg(F.min("key").alias("c"))
    far = heads.join(centre, "gram").where(F.col("key") != F.col("c")).select(F.col("key").alias("u"), F.col("c").alias("v"))
    local = near.select(F.col("key").alias("u"), F.explode("ties").alias("t")).select("u", name(lambda c: F.col(f"t.{c}")).alias("v")).where("u != v")
    families = connected(far.unionByName(local), scratch, "family")
    sizes = families.groupBy("label").agg(F.count("*").alias("size"))
    families = scratch.write(families.join(sizes, "label").select(F.col("node").alias("key"), F.col("label").alias("family"), "size"), "families")
    # equal sets of several blocks are one member
    once = near.join(families.select("key"), "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("a", "b", "n", "prefix", "shared", "p1")])
    once = scratch.write(once, "once")
    scratch.drop("near")
    scratch.tidy()
    linked = connected(_family_links(once, families, like, scratch), scratch, "component")

    some = rows.where("n > 0")
    classes = some.groupBy("a", "b").agg(F.min(F.array_min("ids")).alias("first"))
    sets = once.select("key", "a", "b")
    named = linked.join(sets, F.col("node") == F.col("key")).join(classes, ["a", "b"])
    named = named.join(named.groupBy("label").agg(F.min("first").alias("component")), "label").select("a", "b", "component")
    out = some.join(classes, ["a", "b"], "left").join(named, ["a", "b"], "left").select("ids", "marks", "n", F.coalesce("component", "first").alias("component"))
    out = out.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("marks").alias("mark"))).alias("d"), "n", "component").select("d.id", "d.mark", "n", "component")
    # a set of nothing links with nothing
    none = rows.where("n = 0").select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("marks").alias("mark"))).alias("d"), "n").select("d.id", "d.mark", "n", F.col("d.id").alias("component"))
    return out.unionByName(none)


def deduplicated(docs: DataFrame, like: Likeness = Likeness(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, then of the smallest text hash.

    Rows that are equal down to id and text come once, that of the smallest hash of all columns; they
    shrink before the exchange. Rows without words stay, all of them.
    """
    col = lambda c: F.col(f"`{c}`")
    place = lambda i, mark: [F.coalesce(i.cast("string"), F.lit("")).alias("_i"), i.isNull().alias("_none"), mark.alias("_mark")]
    found = components(docs, like, id, text).where("n > 0")
    kept = found.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("k")).select(*place(F.col("k.id"), F.col("k.mark")))
    word = col(text).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(F.struct(*map(col, docs.columns)).alias("row"), *place(col(id), F.xxhash64(col(text))), F.xxhash64(*map(col, docs.columns)).alias("_all"), F.coalesce(word, F.lit(False)).alias("_some"))
    once = keyed.where("_some").groupBy("_i", "_none", "_mark").agg(F.min_by("row", "_all").alias("row"))
    return once.join(kept, ["_i", "_none", "_mark"]).select("row.*").unionByName(keyed.where("NOT _some").select("row.*"))


def ngram_query(docs: DataFrame) -> DataFrame:
    """The digest of op5: three words, 90 of 100."""
    out = components(docs.select("doc_id", "text"), Likeness(words=3, num=90, den=100))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
