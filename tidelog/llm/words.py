"""Words of Arrow text columns, as integer codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    return pc.fill_null(texts.cast(pa.large_string()), "")


def coded(texts: pa.Array, lower: str = "ascii") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, each text's offsets (one more than texts), and the words.

    Words are runs of anything but blanks and the characters from tab to carriage return.
    """
    texts = pc.ascii_lower(texts) if lower == "ascii" else pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = flat.dictionary
    # white space at either end of a text leaves an empty piece
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return codes, offsets, words


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones (a finaliser of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(*parts: np.ndarray) -> np.ndarray:
    """Hashes of sequences of hashes."""
    return chained(parts)


def chained(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The same of parts that are made one at a time."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(0x632BE59BD9B4E019))
    return out


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, but for single rows that have more."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
