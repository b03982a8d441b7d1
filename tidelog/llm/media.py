"""Media columns: bytes as PNG, read back with every checksum tested, and cosine-transform hashes.

A payload becomes an 8-bit greyscale picture of 64 columns: signature, header, zlib data in chunks of
bounded size, end, each chunk with its checksum. Rows are filtered by the smallest sum of absolute
differences. Reading tests the signature, each chunk's checksum and the size, inflates chunk by chunk
and undoes the filters with numpy, runs of rows with one filter at a time. From the samples read back
come the hashes: the picture is reduced to 32 x 32, the 8 x 8 lowest frequencies of its cosine
transform are compared with their median, and the 64 bits are a binary column.

Defined cases: a null text is an empty one, whose payload is 64 zero bytes; equal texts give equal
values; every row gives one row, and other columns are not read; where frequencies tie with the median
their bits are 0. Memory is a batch of texts and one picture: a very long text takes about eight times its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.memory import tidy
from tidelog.llm.words import pieces

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A PNG whose samples are ``payload``, a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    ways = np.stack([rows, rows - left, rows - up])
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = ways[best, np.arange(len(rows))]
    data = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    parts += [chunk(b"IDAT", data[k : k + CHUNK]) for k in range(0, len(data), CHUNK)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk, its checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        body = png[at + 4 : at + 8 + n]
        if len(body) != n + 4 or zlib.crc32(body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum does not match")
        yield body[:4], body[4:]
        at += 12 + n


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of 8-bit greyscale rows, from their filter kinds and filtered bytes."""
    out = np.empty_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    borders = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(kinds)], strict=True):
        kind = kinds[a]
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            np.cumsum(lines[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(lines[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for r in range(a, b):
                out[r] = _serial(int(kind), lines[r], out[r - 1] if r else np.zeros_like(above))
        else:
            raise ValueError("no such filter")
        above = out[b - 1]
    return out


def _serial(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth, where each sample needs the one before it."""
    up, out = above.astype(int).tolist(), []
    left = corner = 0
    for x, b in zip(line.tolist(), up, strict=True):
        if kind == 3:
            guess = (left + b) // 2
        else:
            p = left + b - corner
            guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, b
        out.append(left)
    return np.array(out, np.uint8)


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, as rows."""
    size, raw, ended, inflate = None, [], False, zlib.decompressobj()
    for kind, data in chunks(png):
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", data)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale without interlacing is read")
            size = height, width
        elif kind == b"IDAT":
            raw.append(inflate.decompress(data))
        elif kind == b"IEND":
            ended = True
    raw.append(inflate.flush())
    if size is None or not ended or not inflate.eof:
        raise ValueError("the picture is not whole")
    lines = np.frombuffer(b"".join(raw), np.uint8).reshape(size[0], size[1] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), 2 * np.arange(n) + 1) / (2 * n))


LOW = cosines(32, 8)


def reduced(rows: np.ndarray, n: int = 32) -> np.ndarray:
    """Means over an n x n grid of areas; where there are fewer rows than areas, rows repeat."""
    for axis in (0, 1):
        size = rows.shape[axis]
        edges = np.arange(n) * size // n
        if size < n:
            rows = np.take(rows, edges, axis=axis).astype(float)
        else:
            shape = (-1, 1) if axis == 0 else (1, -1)
            rows = np.add.reduceat(rows, edges, axis=axis, dtype=float) / np.diff([*edges, size]).reshape(shape)
    return rows


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies exceed their median."""
    low = np.round(LOW @ reduced(rows) @ LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, text: str = "text", id: str = "doc_id", media: bool = True) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dct_hash[, media])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                rows = []
                for x in part.column("text"):
                    data = (x.as_py() or "").encode()
                    png = encode(padded(data))
                    samples = decode(png)
                    payload = samples.tobytes()
                    rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples), *([png] if media else [])))
                made = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                yield pa.record_batch({"id": part.column("id")} | {n: pa.array(c, k) for n, c, k in zip(names, made, kinds, strict=False)})

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dct_hash", *(["media"] if media else [])]
    kind = docs.schema[id].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dct_hash binary" + ", media binary" * media
    return docs.selectExpr(f"`{id}` AS id", f"`{text}` AS text").mapInArrow(tidy(run), f"id {kind}, {fields}")


def media_query(docs: DataFrame) -> DataFrame:
    """The digest of op3; the feature is the hash as hexadecimal digits."""
    return store(docs, media=False).selectExpr("id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "lower(hex(dct_hash)) AS feature")
