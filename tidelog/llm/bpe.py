"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its pieces are leaves; the leaves of all texts of a batch
are encoded together, and neighbours are joined up the tree. At each join a window of text around the
seam is encoded again. It grows until both sides agree exactly with what they had, so the joined
tokens are those of the whole text.

When they agree. The splitting pattern has no look-behind, and no piece of it holds a character
followed by white space, a letter followed by a digit or sign, a digit followed by a letter or sign,
or a sign other than the apostrophe followed by a letter. Such places are cuts in any text, so a
window between two cuts gives the tokens of the whole. Inside one long run of a single class, where
no cut is near, a BPE encoding is the only one in which each two neighbours, encoded together, give
themselves; so a window whose first and last tokens are the ones that stood there agrees too. Ends
of the text are cuts, so growth ends.

Defined cases: a null text is an empty one and has no tokens; strings of added tokens are those
tokens wherever they occur; repeated rows give equal rows; a carried column may have any name but those
of the results. Texts come as Arrow strings; bytes that are not UTF-8 fail there. Memory is a few
megabytes of texts and their tokens, or one very long text and its tokens, some twenty times its size.
The vocabulary's path must be readable on every node, as a package's data file is that all have installed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidelog.llm.memory import kept, tidy
from tidelog.llm.words import pieces

# Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEAF = 4096
FIRST_WINDOW = 32
BATCH_BYTES = 2 << 20
HALVES = 2  # threads for the leaves of long texts, at least


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _classes() -> bytes:
    """L, N, S or W of the first characters of Unicode, whose classes have long been settled."""
    import unicodedata

    out = bytearray()
    for k in range(0x250):
        c = chr(k)
        kind = unicodedata.category(c)[0]
        out += b"W" if c.isspace() else b"L" if kind == "L" else b"N" if kind == "N" else b"S"
    return bytes(out)


KIND = _classes()


def kind(c: str) -> int:
    k = ord(c)
    return KIND[k] if k < len(KIND) else 0


def is_cut(before: str, after: str) -> bool:
    """Whether every text is split between these two characters."""
    a, b = kind(before), kind(after)
    if not a or not b or a == 87:  # unknown, or white space before
        return False
    if b == 87:
        return True
    return a != b and not (a == 83 and b == 76 and before == "'")


class TreeBpe:
    def __init__(self, path: str, leaf: int = LEAF, threads: int = 1):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is needed")
        symbols = _bytes_of_symbols()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in added}
        self.core = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = added
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.length = {k: len(b) for b, k in ranks.items()}
        self.leaf, self.threads = max(2, leaf), threads
        self.joins = self.regrown = 0

    # -- encoding
    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text. All leaves of the batch are encoded together."""
        leaves: list[str] = []
        plans = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(t in text for t in self.added) else [text]
            plans.append([self.added[p] if p in self.added else self._halve(p, leaves) for p in parts if p])
        # leaves of texts that were halved are encoded side by side; the encoder works outside the interpreter's lock
        long = any(not isinstance(p, int) and len(p) > 1 for plan in plans for p in plan)
        encoded = self.core.encode_ordinary_batch(leaves, num_threads=max(HALVES, self.threads) if long else self.threads)
        out = []
        for plan in plans:
            ids: list[int] = []
            for p in plan:
                ids += [p] if isinstance(p, int) else self._gather(p, leaves, encoded)[1]
            out.append(np.array(ids, dtype="<u4"))
        return out

    def _halve(self, text: str, leaves: list[str]) -> tuple:
        """(k,) for a leaf, or (left, right)."""
        if len(text) <= self.leaf:
            leaves.append(text)
            return (len(leaves) - 1,)
        middle = len(text) // 2
        return (self._halve(text[:middle], leaves), self._halve(text[middle:], leaves))

    def _gather(self, tree: tuple, leaves: list[str], encoded: list[list[int]]) -> tuple[str, list[int]]:
        if len(tree) == 1:
            return leaves[tree[0]], encoded[tree[0]]
        left, right = self._gather(tree[0], leaves, encoded), self._gather(tree[1], leaves, encoded)
        return left[0] + right[0], self.join(*left, *right)

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Tokens of left + right, of which ``a`` and ``b`` are the tokens."""
        window = FIRST_WINDOW
        self.joins += 1
        while True:
            i, sure_i = self._left_edge(left, a, window)
            j, sure_j = self._right_edge(right, b, window)
            if i is not None and j is not None:
                na, text_a = i
                nb, text_b = j
                seen = self.core.encode_ordinary(text_a + text_b)
                # a cut agrees by itself; within a run the outermost tokens have to be the old ones
                if (sure_i or (seen and seen[0] == a[na])) and (sure_j or (seen and seen[-1] == b[nb - 1])):
                    return a[:na] + seen + b[nb:]
            window *= 2
            self.regrown += 1

    def _left_edge(self, text: str, ids: list[int], window: int):
        """((tokens before the window, the window's text), whether a cut is there), or (None, False)."""
        if window >= len(text):
            return (0, text), True
        start = len(text) - window
        for p in range(start, len(text)):
            if p and is_cut(text[p - 1], text[p]):
                return (self._before(ids, len(text[p:].encode())), text[p:]), True
        return self._run_edge(text, ids, text[start - 1 :], tail=True)

    def _right_edge(self, text: str, ids: list[int], window: int):
        if window >= len(text):
            return (len(ids), text), True
        for p in range(window, 0, -1):
            if is_cut(text[p - 1], text[p]):
                return (self._after(ids, len(text[:p].encode())), text[:p]), True
        return self._run_edge(text, ids, text[: window + 1], tail=False)

    def _run_edge(self, text: str, ids: list[int], near: str, tail: bool):
        """The edge at a token's border within a run of letters, digits or signs."""
        kinds = {kind(c) for c in near}
        if len(kinds) != 1 or not kinds <= {76, 78, 83} or "'" in near:
            return None, False
        most = len(near[1:].encode()) if tail else len(near[:-1].encode())
        raw = near.encode()
        n = size = 0
        for t in reversed(ids) if tail else ids:
            if size + self.length[t] > most:
                break
            n, size = n + 1, size + self.length[t]
        while n:
            at = raw[-size:] if tail else raw[:size]
            edge = at[0] if tail else raw[size]
            if edge & 0xC0 != 0x80:  # not within a character
                return ((len(ids) - n, at.decode()) if tail else (n, at.decode())), False
            t = ids[len(ids) - n] if tail else ids[n - 1]
            n, size = n - 1, size - self.length[t]
        return None, False

    def _before(self, ids: list[int], size: int) -> int:
        n = len(ids)
        while size > 0:
            n -= 1
            size -= self.length[ids[n]]
        assert size == 0, "a cut within a token"
        return n

    def _after(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= self.length[ids[n]]
            n += 1
        assert size == 0, "a cut within a token"
        return n

    # -- decoding
    def decode(self, ids: np.ndarray) -> str:
        return self.core.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def tokenizer(path: str, leaf: int = LEAF) -> TreeBpe:
    """One per Python worker, which may use as many threads as its task has cores."""
    context = TaskContext.get()
    threads = context.cpus() if context is not None else 1
    return kept(("bpe", path, leaf, threads), lambda: TreeBpe(path, leaf, threads))


def encode(docs: DataFrame, path: str, leaf: int = LEAF, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): token ids of each whole text, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, leaf)
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                ids = tok.encode_batch([x or "" for x in part.column("text").to_pylist()])
                yield pa.record_batch({"id": part.column("id"), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array([tok.decode(x) for x in ids], pa.string())})

    kind = docs.schema[id].dataType.simpleString()
    return docs.selectExpr(f"`{id}` AS id", f"`{text}` AS text").mapInArrow(tidy(run), f"id {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, leaf: int = LEAF, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` and the digest of op10: what ``encode`` gives, hashed where it is made."""
    body = "_text"
    while body in columns:
        body += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, leaf)
        for batch in batches:
            for part in pieces(batch, body, BATCH_BYTES):
                ids = tok.encode_batch([x or "" for x in part.column(body).to_pylist()])
                made = {
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(tok.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                }
                yield pa.record_batch({c: part.column(c) for c in columns} | made)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.selectExpr(*[f"`{c}`" for c in columns], f"`{text}` AS `{body}`").mapInArrow(tidy(run), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(docs: DataFrame, path: str) -> DataFrame:
    """The digest of op10."""
    return digest(docs, path)
