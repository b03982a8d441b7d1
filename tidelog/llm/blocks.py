"""Counting n-grams of blocks of documents against the whole corpus.

A block is some megabytes of consecutive texts of one input partition. It counts its own n-grams and
sends one packed table of (hash, counts) to each of many hash ranges. A range adds up what all blocks
sent and answers each block, but only where the corpus differs from the block itself: the many
n-grams that no other block has need no answer. Tables are sorted, so hashes travel as small
differences; each exchange has a few bytes for each distinct n-gram of a block, however often it occurs.

Every block meets every range, so with blocks of a fixed size a table would get shorter as the input
grows. Blocks and ranges grow with the input's square root instead, beyond a few gigabytes: a table
keeps at least ``ROW_GRAMS`` n-grams. At 100 TB a block is about 150 MB, for which a worker needs some 2 GB.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidelog.llm.memory import give_back
from tidelog.llm.words import pieces

LEAST = 4 << 20  # bytes of text for each block and each hash range, at least
ROW_GRAMS = 32  # n-grams in a table, about, at least
GRAM_BYTES = 7  # of text for each n-gram


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as byte planes, compressed; give sorted ones as differences."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T
        used = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1 if len(a) else 0
        parts.append(struct.pack("<QB", len(a), used) + planes[:used].tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        n, used = struct.unpack_from("<QB", raw, at)
        at += 9
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(raw, np.uint8, n * used, at).reshape(used, n)
        at += n * used
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    out = sorted_.copy()
    out[1:] -= sorted_[:-1]
    return out


def walk(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def layout(docs: DataFrame, least: int = LEAST) -> tuple[int, int]:
    """Hash ranges (a power of two), and bytes of text for each block, for an input of this many partitions."""
    conf = docs.sparkSession.conf
    size = conf.get("spark.sql.files.maxPartitionBytes")
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = size.lower().rstrip("b") or "0"
    most = int(number[:-1]) * units[number[-1]] if number[-1] in units else int(number)
    parts = docs.rdd.getNumPartitions()
    return shape(parts * max(most, LEAST), int(conf.get("spark.sql.shuffle.partitions")), least)


def shape(total: int, partitions: int, least: int = LEAST) -> tuple[int, int]:
    """The same for an input of ``total`` bytes at most."""
    root = int((total * ROW_GRAMS * GRAM_BYTES) ** 0.5)
    n = max(total // max(LEAST, root), partitions)
    return 1 << max(3, (n - 1).bit_length()), max(least, root)


def split(sorted_: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the non-empty ranges of sorted hashes."""
    shift = 64 - (ranges.bit_length() - 1)
    edges = np.searchsorted(sorted_, np.arange(1, ranges, dtype=np.uint64) << np.uint64(shift))
    bounds = [0, *edges.tolist(), len(sorted_)]
    return ((k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b)


def home(block: int, ranges: int) -> int:
    """Where a block's own rows travel: beside the ranges, spread evenly."""
    return ranges + ((block >> 24) * 7 + (block & 0xFFFFFF)) % ranges


def block_number(k: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + k


def gathered(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, column, most):
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                give_back()
    if held:
        yield pa.Table.from_batches(held)


def rows(count: int, /, **columns: object) -> dict[str, object]:
    """Columns of so many rows; what is given as None or a single value repeats."""
    return {k: v if isinstance(v, pa.Array | pa.ChunkedArray) else [v] * count for k, v in columns.items()}
