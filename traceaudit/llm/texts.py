"""Texts of an Arrow batch as one byte array: words, their hashes and slices of bounded size, all by numpy.

Words are runs of bytes other than the six ASCII white-space bytes, which is ``[^\\x20\\x09-\\x0D]+`` on the text:
UTF-8 never uses these bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``limit`` bytes together, or a single row."""
    bounds, _ = utf8(batch.column(name))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, rows) - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each text and the bytes of all; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if at is None or not len(texts):
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    bounds = np.frombuffer(at, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bounds - bounds[0], raw[bounds[0] : bounds[-1]]


def words(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (one more entry than texts)."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


@lru_cache(maxsize=4)
def _kept_powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(count, base, dtype=np.uint64)
    down = np.full(count, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of an odd base and of its inverse modulo 2**64."""
    if count <= SLICE_BYTES + 1:
        return tuple(x[:count] for x in _kept_powers(base, SLICE_BYTES + 1))
    return _kept_powers.__wrapped__(base, count)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, a polynomial over its bytes; ``lower`` maps A-Z first."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(_BYTE_BASE, len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[_LOWER[data] if lower else data] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` entries, modulo 2**64; entry i is the run that starts at i."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(base, len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[:count])


def run_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """For texts of so many words that stand one after the other: where each run of ``width`` words inside a text starts."""
    n = np.maximum(counts - width + 1, 0)
    before = np.cumsum(counts) - counts
    return np.repeat(before - (np.cumsum(n) - n), n) + np.arange(n.sum())


def hashed_words(batch: pa.RecordBatch, name: str = "text", lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, text after text, and the number of words of each text."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for part in slices(batch, name):
        bounds, data = utf8(part.column(name))
        starts, ends, before = words(bounds, data)
        hashes.append(word_hashes(data, starts, ends, lower))
        counts.append(np.diff(before))
    return np.concatenate(hashes), np.concatenate(counts)


def planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers as byte planes, compressed: small differences take a few bits each."""
    raw = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unplaned(raw: bytes, count: int, *kinds: str) -> list[np.ndarray]:
    flat, at, columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8), 0, []
    for kind in map(np.dtype, kinds):
        n = count * kind.itemsize
        columns.append(np.ascontiguousarray(flat[at : at + n].reshape(kind.itemsize, count).T).view(kind).ravel())
        at += n
    return columns


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_packed``, the compressed text, in place of ``text``: for texts that go through a shuffle."""
    at = docs.columns.index("text")
    names = ["_packed" if c == "text" else c for c in docs.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                packed = pa.array([None if t is None else tool.compress(t) for t in texts], pa.binary())
                columns = [packed if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("_packed", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(pack, T.StructType(fields))


def unpacked(column: pa.Array) -> pa.Array:
    tool = zstandard.ZstdDecompressor()
    return pa.array([None if p is None else tool.decompress(p) for p in column.to_pylist()], pa.binary())
