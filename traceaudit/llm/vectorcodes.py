"""Vector codes: each part of a vector becomes the number of the nearest entry in the part's codebook.

Everything is integer arithmetic, so results are exact. The nearest entry is found by equal-average search: entries
stand in the order of their component sums, and the search goes outward from a part's own sum. By Cauchy-Schwarz an
entry whose sum differs by g is at least g**2 / dimension away (squared), so a side ends where that bound strictly
exceeds the best distance found; an equal bound goes on, since ties go to the lower number. Parts of neighbouring sums
go through the search together, which ends when it has ended for each.

Codebooks have a fixed size, so they go to all tasks and come back as sums and counts, added up in Spark by block.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another
length than most rows have (of two lengths equally frequent the larger stays). Components are held within
``limit(width)``, far beyond usual embeddings, so that no sum of squares leaves 64 bits. Where the length is no multiple
of the number of parts, the first parts are one longer. Rows without id are encoded but start no entry; of rows that
repeat an id the smallest vectors start entries first. With fewer rows than entries the codebook is that much smaller.
Equal rows get equal codes. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Steps of a component of size 1.
SCALE = 1024
#: Parts searched together, entries that a side grows by, and entries whose sums are added up in one group.
_TOGETHER, _STEP, _BLOCK = 256, 8, 32


def limit(width: int) -> int:
    """Largest component, in steps, for which all sums over a part of ``width`` fit 64 bits."""
    return (1 << 30) // max(width, 2)


def widths(length: int, parts: int) -> list[int]:
    return [length // parts + (k < length % parts) for k in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the lowest number among the nearest rows of ``book``, and the squared distance."""
    count, width = x.shape
    codes, errors = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    sums = book.sum(axis=1)
    by_sum = np.argsort(sums, kind="stable")
    sums, entries = sums[by_sum], book[by_sum]
    own = x.sum(axis=1)
    order = np.argsort(own, kind="stable")
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    small = 4 * width * largest**2 < 1 << 53  # products of floats are exact then
    wide = entries.astype(np.float64) if small else entries
    square = (wide * wide).sum(axis=1)

    for at in range(0, count, _TOGETHER):
        rows = order[at : at + _TOGETHER]
        s, v = own[rows], x[rows].astype(wide.dtype)
        norm = (v * v).sum(axis=1)
        best = np.full(len(rows), (1 << 62) // max(width, 1), dtype=np.int64)
        code = np.full(len(rows), len(book), dtype=np.int64)

        def visit(a: int, b: int) -> None:
            nonlocal best, code
            far = (norm[:, None] + square[a:b] - 2 * (v @ wide[a:b].T)).astype(np.int64)
            found = far.min(axis=1)
            number = np.where(far == found[:, None], by_sum[a:b], len(book)).min(axis=1)
            better = (found < best) | ((found == best) & (number < code))
            best, code = np.where(better, found, best), np.where(better, number, code)

        low = high = int(np.searchsorted(sums, s[len(s) // 2]))
        while True:
            left = low > 0 and (np.maximum(s - sums[low - 1], 0) ** 2 <= width * best).any()
            right = high < len(sums) and (np.maximum(sums[high] - s, 0) ** 2 <= width * best).any()
            if not (left or right):
                break
            if left:
                visit(max(0, low - _STEP), low)
                low = max(0, low - _STEP)
            if right:
                visit(high, min(len(sums), high + _STEP))
                high = min(len(sums), high + _STEP)
        codes[rows], errors[rows] = code, best
    return codes, errors


def _parts(batch: pa.RecordBatch, cuts: list[int]) -> list[np.ndarray]:
    """The parts of a batch's vectors, in steps."""
    column = batch.column("v")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    held = limit(max(cuts))
    steps = np.clip(np.floor(SCALE * x), -held, held).astype(np.int64)
    ends = np.cumsum(cuts)
    return [steps[:, b - w : b] for w, b in zip(cuts, ends)]


def usable(vectors: DataFrame, vector: str, ident: str, label: str) -> tuple[DataFrame, int]:
    """``id, label, v`` of the vectors that take part, and their length."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(
        F.col(ident).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    ).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    # A vector of ten lengths is one of ten rows here.
    most = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = most.length if most else 0
    return rows.filter(F.size("v") == length), length


def fit(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks: one array per part, an entry per row."""
    cuts = widths(length, parts)
    first = rows.filter("id is not null").orderBy("id", "v").limit(entries).select("v").toArrow()
    books = _parts(first.combine_chunks().to_batches()[0], cuts) if first.num_rows else [np.zeros((0, w), dtype=np.int64) for w in cuts]
    if not len(books[0]):
        return books

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                for x, book, n, total in zip(_parts(batch, cuts), books, counts, sums):
                    code, _ = nearest(x, book)
                    n += np.bincount(code, minlength=len(book))
                    by_code = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.diff(code[by_code], prepend=-1))
                    total[code[by_code][starts]] += np.add.reduceat(x[by_code], starts, axis=0)
        out = [
            (p, at, np.column_stack([n[at : at + _BLOCK], total[at : at + _BLOCK]]).tobytes())
            for p, (n, total) in enumerate(zip(counts, sums))
            for at in range(0, len(n), _BLOCK)
        ]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, dtype=np.int64) for raw in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "at": table.column("at")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, at int, sums binary"
    for _ in range(rounds):
        moved = rows.select("v").mapInArrow(gather, schema).groupBy("part", "at").applyInArrow(add, schema).collect()
        after = [b.copy() for b in books]
        for row in moved:  # as many rows as the codebooks have blocks
            block = np.frombuffer(row.sums, dtype=np.int64).reshape(-1, cuts[row.part] + 1)
            used = np.flatnonzero(block[:, 0])
            after[row.part][row.at + used] = block[used, 1:] // block[used, :1]
        books = after
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def encode(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` of each vector that takes part.

    ``code`` has two hex digits per part; ``error`` is the squared distance from the vector, in steps, to its entries;
    ``label_error`` the sum over all rows of the label, rows without label together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: at most 256 entries")
    rows, length = usable(vectors, vector, ident, label)
    books, cuts = fit(rows, length, parts, entries, rounds), widths(length, parts)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(books[0]):
                found = [nearest(x, book) for x, book in zip(_parts(batch, cuts), books)]
                digits = np.column_stack([c for c, _ in found]).astype(np.uint8).tobytes().hex()
                codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(codes), pa.array(sum(e for _, e in found))],
                    ["id", "label", "code", "error"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    named = materialise(rows.mapInArrow(name, f"id bigint, label {kind}, code string, error bigint"))
    labels = named.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return named.join(labels, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "id", "label", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )
