"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background corpus, share one vocabulary: every word of the background,
or its ``vocabulary`` most frequent words if a number is given, besides one entry for all other words and one for the
start of a document. They are matched: both are smoothed by the same shares of their own unigrams and of the uniform
distribution over the vocabulary, so a smaller corpus is not smoothed more; and neither has seen what it scores, since a
document's own counts are taken out of each model that holds them. A document's score is the mean over its words of the
target's loss minus the background's: below 0 for texts that the target's model expects more.

Texts are stored in chunks. Each chunk sends its distinct bigrams and words with their counts (words also as predecessors)
to buckets, once each however frequent they are; a bucket sums them over all chunks and answers each chunk with the sums
in the order in which it asked. So chunks are scored with the counts of their own words, and the models stay in Spark: the
driver gets two totals. Buckets are ranges of hashes, so ascending keys of a chunk differ by little.

Defined results: null, empty and blank texts have no words and null losses and score; rows without ``doc_id`` are
scored and counted as background; rows that repeat a ``doc_id`` are texts of their own, all of them target if the id is.
Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, told apart by 64-bit hashes (bigrams by 63 bits). Texts of any
length are scored whole; equal texts get equal results if both are target or neither is; an empty table gives an empty
one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise
from traceaudit.llm.texts import hashed_words, mixed, packed_texts, planes, slices, unpacked, unplaned, words

#: Stand for the hash of all other words and of the start of a document.
OTHER, START = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Kinds of keys, in their lowest bit.
PAIR, WORD = (np.uint64(k) for k in range(2))
#: Weight of bigrams beside unigrams, and of the uniform distribution beside what was counted.
BIGRAM_WEIGHT, UNIFORM_WEIGHT = 0.7, 0.1
CHUNK_BYTES = 8 << 20


def _buckets(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed_counts(keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Ascending keys with their counts, one row per bucket; buckets are ranges of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]) if len(keys) else ():
        out.append((int(bucket[a]), b - a, planes(np.diff(keys[a:b], prepend=np.uint64(0)), *[c[a:b] for c in counts])))
    columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 3, (pa.int32(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "packed"])


def _unpacked_counts(table: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket and their summed counts."""
    found = [unplaned(p, n, "u8", *["i4"] * columns) for n, p in zip(table.column("n").to_pylist(), table.column("packed").to_pylist())]
    keys = np.concatenate([np.cumsum(f[0]) for f in found])
    distinct, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, np.concatenate([f[c + 1] for f in found]), len(distinct)).astype(np.int64) for c in range(columns)]
    return distinct, sums


def word_vocabulary(background: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent words, ascending; ties go to the smaller hash."""
    buckets, wanted = _buckets(background), size - 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                keys, counts = np.unique(hashed_words(part, lower=True)[0], return_counts=True)
                yield _packed_counts(keys, [counts.astype(np.int32)], buckets)

    def most(table: pa.Table) -> pa.Table:
        keys, (counts,) = _unpacked_counts(table, 1)
        top = np.lexsort((keys, -counts))[:wanted]
        return pa.table({"keys": [keys[top].tobytes()], "counts": [counts[top].tobytes()]})

    packed = background.select("text").mapInArrow(count, "bucket int, n int, packed binary")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for b in batches for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist())]
        if held:
            keys, counts = map(np.concatenate, zip(*held))
            top = np.lexsort((keys, -counts))[:wanted]
            yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["word", "n"])

    # Buckets meet in the root of their number of tasks, which leaves the driver as many candidates of each at most.
    tops = packed.groupBy("bucket").applyInArrow(most, "keys binary, counts binary")
    words = tops.repartition(max(1, round(buckets**0.5))).mapInArrow(best, "word bigint, n bigint")
    # As in the buckets, ties go to the smaller unsigned hash.
    top = words.orderBy(F.desc("n"), F.col("word") < 0, "word").limit(wanted).select("word").toPandas()
    return np.sort(top["word"].to_numpy(dtype=np.int64).view(np.uint64))


def model_keys(batch: pa.RecordBatch, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word's bigram, of the word and of its predecessor (a word too), as three rows, and the words of each text."""
    words, counts = hashed_words(batch, lower=True)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), dtype=bool)
        words = np.where(known, words, OTHER)
    before = np.roll(words, 1)
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    tagged = lambda x, kind: (x & ~np.uint64(1)) | kind
    pairs = mixed(mixed(before) * np.uint64(0x9E3779B97F4A7C15) + words)
    return np.stack([tagged(pairs, PAIR), tagged(mixed(words), WORD), tagged(mixed(before), WORD)]), counts


def key_counts(place: np.ndarray, distinct: int) -> list[np.ndarray]:
    """How often each distinct key is met as bigram or word, and as predecessor."""
    return [np.bincount(p.ravel(), minlength=distinct).astype(np.int32) for p in (place[:2], place[2])]


def own_counts(place: np.ndarray, text: np.ndarray, distinct: int) -> np.ndarray:
    """For each word how often its own text holds its bigram, the word and its predecessor."""
    out = np.empty(place.shape, dtype=np.int64)
    for row, keys in zip(out, place):
        _, at, n = np.unique(text * distinct + keys, return_inverse=True, return_counts=True)
        row[:] = n[at]
    return out


_CHUNK = "chunk bigint, docs array<bigint>, targets array<boolean>, sizes array<bigint>, texts binary, words bigint, target_words bigint"


def text_chunks(flagged: DataFrame) -> DataFrame:
    """Rows of about ``CHUNK_BYTES`` of texts, compressed together, with their number of words: all and of the target."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = unpacked(batch.column("_packed")).to_pylist()
            for doc, target, text in zip(batch.column("doc_id").to_pylist(), batch.column("target").to_pylist(), texts):
                text = text or b""
                if held and size + len(text) > CHUNK_BYTES:
                    yield row_of(held)
                    held, size = [], 0
                held.append((doc, target, text))
                size += len(text)
        if held:
            yield row_of(held)

    def row_of(held: list[tuple]) -> pa.RecordBatch:
        docs, targets, texts = zip(*held)
        raw, sizes = b"".join(texts), [len(t) for t in texts]
        counts = np.diff(words(np.append(0, np.cumsum(sizes)), np.frombuffer(raw, dtype=np.uint8))[2])
        packed = zstandard.ZstdCompressor(level=3).compress(raw)
        columns = [uuid.uuid4().int >> 65, docs, targets, sizes, packed, int(counts.sum()), int(counts[np.array(targets)].sum())]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _CHUNK.split(", ")])

    return flagged.select("doc_id", "target", "_packed").mapInArrow(gather, _CHUNK)


def _texts(row: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
    """Texts of a chunk's only row."""
    raw = zstandard.ZstdDecompressor().decompress(row.column("texts")[0].as_py())
    at = np.append(0, np.cumsum(row.column("sizes")[0].as_py()))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([texts], ["text"])


def model_sums(chunks: DataFrame, vocabulary: np.ndarray | None, buckets: int) -> DataFrame:
    """For each chunk and bucket the packed sums of its keys: met and met before others, in the background and the target."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                keys, counts = model_keys(_texts(row), vocabulary)
                target = np.repeat(np.array(row.column("targets")[0].as_py(), dtype=bool), counts)
                distinct, place = np.unique(keys, return_inverse=True)
                place = place.reshape(keys.shape)
                counted = key_counts(place, len(distinct)) + key_counts(place[:, target], len(distinct))
                packed = _packed_counts(distinct, counted, buckets)
                chunk = pa.array([row.column("chunk")[0].as_py()] * packed.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, *packed.columns], ["chunk", *packed.schema.names])

    def answer(asked: pa.Table) -> pa.Table:
        parts = list(zip(*[asked.column(c).to_pylist() for c in ("chunk", "bucket", "n", "packed")]))
        distinct, sums = _unpacked_counts(asked, 4)
        rows = []
        for chunk, bucket, n, packed in parts:
            at = np.searchsorted(distinct, np.cumsum(unplaned(packed, n, "u8", *["i4"] * 4)[0]))
            rows.append((chunk, bucket, n, planes(*[c[at] for c in sums])))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "bucket", "n", "packed"])

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    schema = "chunk bigint, bucket int, n int, packed binary"
    asked = chunks.select("chunk", "targets", "sizes", "texts").mapInArrow(ask, schema)
    return asked.groupBy("bucket").applyInArrow(answer, schema)


def score(
    docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, weight: float = BIGRAM_WEIGHT, uniform: float = UNIFORM_WEIGHT
) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every document.

    The background is ``docs``; the target those of its documents whose ``doc_id`` is in ``target_ids``. ``vocabulary``
    counts the two special entries; without it every word has an entry. A word after another has the probability
    ``weight`` x its share of what follows the other, plus the rest x (its share of all words, ``uniform`` of which goes
    to all entries alike), from counts without the document itself. Where every word is an entry, an entry's part is as if
    there were one for each running word of the background, which needs no count of distinct words and is the same for
    both models.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    words_of = None if vocabulary is None else word_vocabulary(rows, vocabulary)
    buckets = _buckets(docs)
    marks = target_ids.select(F.col("doc_id").cast("bigint")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    flagged = packed_texts(rows).join(marks.hint("merge"), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    chunks = materialise(text_chunks(flagged))
    found = chunks.agg(F.sum("words").alias("b"), F.sum("target_words").alias("t")).first()
    totals = (found.t or 0, found.b or 0)
    # No word is the start.
    entries = max(vocabulary - 1 if vocabulary is not None else totals[1], 1)
    names = ["doc_id", "n_words", "target_loss", "background_loss", "score"]

    def add(asked: pa.Table, answers: pa.Table) -> pa.Table:
        keys, n = model_keys(_texts(asked), words_of)
        distinct, place = np.unique(keys, return_inverse=True)
        place = place.reshape(keys.shape)
        text = np.repeat(np.arange(len(n)), n)
        own = own_counts(place, text, len(distinct))
        parts = sorted(zip(*[answers.column(c).to_pylist() for c in ("bucket", "n", "packed")]))
        sides = [unplaned(packed, count, *["i8"] * 4) for _, count, packed in parts]
        met, before = ([np.concatenate([np.zeros(0, dtype=np.int64), *[s[c] for s in sides]]) for c in pair] for pair in ((0, 2), (1, 3)))
        target = np.array(asked.column("targets")[0].as_py(), dtype=bool)
        ends, means, none = np.cumsum(n), [], n == 0
        for side, total in zip((1, 0), totals):
            # The background holds every document, the target its own.
            without = own if side == 0 else own * target[text]
            length = np.repeat(n, n) if side == 0 else (n * target)[text]
            pair, word = met[side][place[0]] - without[0], met[side][place[1]] - without[1]
            after = before[side][place[2]] - without[2]
            single = (1 - uniform) * word / np.maximum(total - length, 1) + uniform / entries
            loss = -np.log(weight * pair / np.maximum(after, 1) + (1 - weight) * single)
            upto = np.concatenate([[0.0], np.cumsum(loss)])
            means.append((upto[ends] - upto[ends - n]) / np.maximum(n, 1))
        values = [pa.array(m, pa.float64(), mask=none) for m in (*means, means[0] - means[1])]
        return pa.table([pa.array(asked.column("docs")[0].as_py(), pa.int64()), pa.array(n, pa.int64()), *values], names)

    answers = model_sums(chunks, words_of, buckets)
    return (
        chunks.select("chunk", "docs", "targets", "sizes", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInArrow(add, "doc_id bigint, n_words bigint, target_loss double, background_loss double, score double")
    )
