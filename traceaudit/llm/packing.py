"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n**2``: the layers' work and attention within the piece. Whole
sequences are cut from the front of long documents. The rests that a task has gathered go, longest first, each to the
cheapest sequence that still has room, out of just as many sequences as their tokens need; what doesn't fit is cut and
goes on to the next cheapest. Sequences of a window miss fewer tokens together than one sequence holds.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.texts import slices, utf8
from traceaudit.llm.tokenizer import encoder

LENGTH = 1024
#: Cost of a token by itself, and of a pair of tokens: with these a piece of 1,024 costs twice its linear part.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens of rests that one task balances together; bounds its memory, and the padding to one sequence per window.
WINDOW_TOKENS = 1 << 20
_COLUMNS = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def balance(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of at most ``capacity`` tokens."""
    open_ = [(0.0, k, 0) for k in range(-(-sum(lengths) // capacity))]  # cost, sequence, tokens: a heap
    pieces = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        at = 0
        while at < lengths[doc]:
            cost, k, used = open_[0]
            n = min(lengths[doc] - at, capacity - used)
            pieces.append((doc, at, n, k, used))
            if used + n < capacity:
                heapq.heapreplace(open_, (cost + linear * n + quadratic * n * n, k, used + n))
            else:
                heapq.heappop(open_)
            at += n
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0,
    window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True,
    escape_special: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if wanted, ``ids``.

    Every row of ``docs`` (``doc_id``, ``text``) is a document of its own, so repeated ones are packed as often; a null
    or empty text is the end id alone; a null ``doc_id`` stays null. Each task packs what it reads, with no shuffle;
    ``sequence_id`` holds the task's number above bit 40. Read ``docs`` from files: a task that runs again after the
    loss of an executor then meets the same rows and packs them alike. Texts of any length are packed whole, ties in
    length go to the earlier document, an empty table gives no pieces, and other columns are ignored, whatever their
    names. The string of a special token in a text is that token, unless ``escape_special``.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(tokenizer_path, escape_special), np.uint32(end_id).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rests: list[tuple] = []  # doc_id, start, tokens of the document, bytes of the rest
        waiting = 0

        def emit(doc_id, start, total, ids, k, offset):
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, k, offset, ids))

        def batch_of(rows):
            kinds = [pa.int64()] * 7
            columns = [pa.array(x, type=t) for x, t in zip(zip(*[r[:7] for r in rows]), kinds)]
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            if with_ids:
                bounds = np.cumsum([0, *(r[2] for r in rows)]).astype(np.int32)
                values = np.frombuffer(b"".join(r[7] for r in rows), dtype="<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        def place():
            nonlocal sequence
            last = 0
            for d, at, n, k, offset in balance([len(r[3]) // 4 for r in rests], length, linear, quadratic):
                doc_id, start, total, ids = rests[d]
                emit(doc_id, start + at, total, ids[4 * at : 4 * (at + n)], sequence + k, offset)
                last = max(last, k + 1)
            sequence += last
            rests.clear()

        for batch in batches:
            for part in slices(batch):
                found, sizes = bpe.encode_texts(*utf8(part.column("text")))
                raw, ends = found.tobytes(), (4 * np.cumsum(sizes)).tolist()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), [0, *ends], ends):
                    ids = raw[a:b] + end
                    total = len(ids) // 4
                    whole = total // length * length
                    for at in range(0, whole, length):
                        emit(doc_id, at, total, ids[4 * at : 4 * (at + length)], sequence, 0)
                        sequence += 1
                    if total > whole:
                        rests.append((doc_id, whole, total, ids[4 * whole :]))
                        waiting += total - whole
                    if waiting >= window_tokens:
                        place()
                        waiting = 0
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows.clear()
        place()
        for at in range(0, len(rows), 5000):
            yield batch_of(rows[at : at + 5000])

    schema = _COLUMNS + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(tasks, schema)
