"""Exact substring dedup: repeated windows of words, merged into maximal removal intervals.

Every window of ``window`` consecutive words of a document gets a Rabin-Karp hash. Tasks keep the first window of each
hash among the documents they work on together and ship it, packed by hash bucket; a bucket's task finds the first of
each hash in the whole table. All windows but the first of their hash go: the words they cover are removed. A passage
that a third of the documents share reaches its bucket once per chunk of texts, not once per document.

Hash and bucket come from two polynomials, so windows are told apart by 64 bits and the bucket.

Defined results. Null or empty texts have no windows and stay as they are. Rows without ``doc_id`` take no part: they
lose nothing, and nothing is removed because of them. Rows that share a ``doc_id`` are versions of one document: equal
windows at equal places are the same window, and what goes from one version goes from all. Texts shorter than a window
stay. Other columns pass through; a column named ``_spans`` or ``_packed`` is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.texts import hashed_words, packed_texts, planes, run_starts, slices, unplaned, window_hashes

WINDOW = 20
#: Bytes of text whose windows one task compares before it ships them.
CHUNK_BYTES = 8 << 20
_BUCKET_BASE = 0xA24BAED4963EE407
_SPANS = "array<struct<start:int,end:int>>"


def bucket_counts(docs: DataFrame) -> tuple[int, int]:
    """Groups of hashes, several to a shuffle partition, so each is a small part of what a task holds; of documents."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 4 * partitions, partitions


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of each bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(bucket[rows[0]]), [c[rows] for c in columns]


def _differences(doc: np.ndarray) -> np.ndarray:
    return np.diff(doc, prepend=np.int64(0))


def _owner(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc.astype(np.uint64) * np.uint64(_BUCKET_BASE)) >> np.uint64(24)) % np.uint64(buckets)


def repeated_starts(doc: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the first (by document, then place) of each key, and those that come after it at another place."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(key) else np.zeros(0, dtype=np.int64)
    crowded = np.zeros(len(key), dtype=bool)
    crowded[:-1] |= same
    crowded[1:] |= same
    first = np.ones(len(key), dtype=bool)
    later = np.zeros(len(key), dtype=bool)
    rows, group = order[crowded], group[crowded]
    inner = np.lexsort((at[rows], doc[rows], group))
    rows, group = rows[inner], group[inner]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    lead = rows[np.flatnonzero(head)][np.cumsum(head) - 1] if len(rows) else rows
    first[rows] = head
    later[rows] = (doc[rows] != doc[lead]) | (at[rows] != at[lead])
    return first, later


def removal_spans(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id``, ``_spans``: word intervals [start, end) to remove, for documents that lose any words."""
    buckets, owners = bucket_counts(docs)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=chunk_bytes):
                hashes, counts = hashed_words(part)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                starts = run_starts(counts, window)
                if not len(starts):
                    continue
                windows = np.maximum(counts - window + 1, 0)
                doc = np.repeat(ids, windows)
                at = (starts - np.repeat(np.cumsum(counts) - counts, windows)).astype(np.uint32)
                key = window_hashes(hashes, window)[starts]
                first, later = repeated_starts(doc, at, key)
                bucket = window_hashes(hashes, window, _BUCKET_BASE)[starts] % np.uint64(buckets)
                # Documents in order: neighbours then differ little.
                keep = np.flatnonzero(first)
                keep = keep[np.argsort(doc[keep], kind="stable")]
                out = [
                    (b, k.tobytes(), planes(_differences(d), a))
                    for b, (d, a, k) in _packed(bucket[keep], doc[keep], at[keep], key[keep])
                ]
                gone = np.flatnonzero(later)
                out += [
                    (b, None, len(d).to_bytes(4, "little") + planes(_differences(d), a))
                    for b, (d, a) in _packed(_owner(doc[gone], buckets), doc[gone], at[gone])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())],
                    ["bucket", "hashes", "places"],
                )

    def compare(table: pa.Table) -> pa.Table:
        """One bucket: windows that are not the first of their hash, and those that tasks found themselves."""
        doc, at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        gone = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for raw, places in zip(table.column("hashes").to_pylist(), table.column("places").to_pylist()):
            if raw is None:
                d, a = unplaned(places[4:], int.from_bytes(places[:4], "little"), "i8", "u4")
                gone.append((np.cumsum(d), a))
            else:
                d, a = unplaned(places, len(raw) // 8, "i8", "u4")
                doc.append(np.cumsum(d))
                at.append(a)
                key.append(np.frombuffer(raw, dtype=np.uint64))
        doc, at, key = np.concatenate(doc), np.concatenate(at), np.concatenate(key)
        _, later = repeated_starts(doc, at, key)
        doc = np.concatenate([doc[later], *(g[0] for g in gone)])
        at = np.concatenate([at[later], *(g[1] for g in gone)])
        order = np.argsort(doc, kind="stable")
        out = [(b, len(d), planes(_differences(d), a)) for b, (d, a) in _packed(_owner(doc[order], owners), doc[order], at[order])]
        return pa.table({
            "owner": pa.array([r[0] for r in out], pa.int32()), "n": pa.array([r[1] for r in out], pa.int32()), "places": pa.array([r[2] for r in out], pa.binary()),
        })

    def merge(table: pa.Table) -> pa.Table:
        """The documents of one owner: their repeated windows as maximal intervals."""
        found = [unplaned(p, n, "i8", "u4") for n, p in zip(table.column("n").to_pylist(), table.column("places").to_pylist())]
        doc = np.concatenate([np.cumsum(d) for d, _ in found])
        at = np.concatenate([a for _, a in found]).astype(np.int64)
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        head = np.ones(len(doc), dtype=bool)
        head[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
        tail = np.roll(head, -1)
        starts, ends, owner = at[head], at[tail] + window, doc[head]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = owner[1:] != owner[:-1]
        cuts = np.append(np.flatnonzero(new), len(owner)).astype(np.int32)
        span = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
        return pa.table({"doc_id": owner[new], "_spans": pa.ListArray.from_arrays(pa.array(cuts), span)})

    known = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null")
    shipped = known.mapInArrow(ship, "bucket int, hashes binary, places binary")
    later = shipped.groupBy("bucket").applyInArrow(compare, "owner int, n int, places binary")
    return later.groupBy("owner").applyInArrow(merge, f"doc_id bigint, _spans {_SPANS}")


def _with_spans(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """``docs`` with the text packed (it goes through a shuffle) and the spans to remove."""
    clash = {"_spans", "_packed"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with those of substring dedup")
    return packed_texts(docs).join(removal_spans(docs, window, chunk_bytes), "doc_id", "left")


def _kept(packed: bytes | None, spans: list[dict] | None, tool) -> tuple[list[bytes], int, bytes | None]:
    """Kept words, number of removed words, and the text."""
    if packed is None:
        return [], 0, None
    text = tool.decompress(packed)
    words = text.split()
    if not spans:
        return words, 0, text
    kept, at = [], 0
    for span in spans:
        kept += words[at : span["start"]]
        at = max(at, span["end"])
    kept += words[at:]
    return kept, len(words) - len(kept), text


def dedup_substrings(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without the words that repeat an earlier passage, in the columns they have.

    A text that loses words becomes its kept words with a space between; the others are unchanged to the byte. Rows
    stay even where no word does.
    """
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for packed, spans in zip(batch.column("_packed").to_pylist(), batch.column("_spans").to_pylist()):
                kept, removed, text = _kept(packed, spans, tool)
                texts.append(b" ".join(kept) if removed else text)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in columns], columns)

    return _with_spans(docs, window, chunk_bytes).mapInArrow(cut, docs.schema)


def removal_digest(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256`` and ``spans``, the word intervals that go."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column("_packed").to_pylist(), batch.column("_spans").to_pylist()):
                kept, removed, _ = _kept(packed, spans, tool)
                rows.append((len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n_words, n_removed, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), batch.column("_spans")],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return _with_spans(narrow, window, chunk_bytes).mapInArrow(
        digest, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans {_SPANS}"
    )
