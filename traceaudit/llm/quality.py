"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Features are binned at quantiles. Boosting cycles over the features: each step fits a shallow tree to the gradients of
one feature's bins and adds a part of it to that feature's lookup table; the pairs that lower the loss most then get
two-dimensional tables in the same way. A score is the sum of one entry per table, looked up for all rows at once.

Labels are learnt from a sample of at most ``max_rows`` labelled rows, those of the smallest hashes of ``doc_id``; the
scores cover every document. Defined results: null and empty texts have all features 0 and a score like others; rows
without ``doc_id`` are scored and never learnt from; several labels of one document all count; with labels of one class
only, or none, scores are that class's share (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.store import bounded_sample, materialise
from traceaudit.llm.texts import run_starts, slices, utf8, window_hashes, word_hashes, words

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 80, 8, 30, 0.2
FEATURES = (
    "words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "marks", "non_ascii", "lines", "distinct_words",
    "distinct_triples", "longest_word", "short_words", "no_letter_end",
    "stutter",
)


# Features


def _table(*ranges) -> np.ndarray:
    found = np.zeros(256, dtype=np.int64)
    for r in ranges:
        found[list(r)] = 1
    return found


_KINDS = (
    _table(range(65, 91)), _table(range(48, 58)), _table(b"#*$%&<>@^~+=_\\"), _table(b"!"), _table(b"|"),
    _table(b".,;:?'\"()-"), _table(range(0xC0, 256)), _table(b"\n"),
)
_LETTER = _table(range(65, 91), range(97, 123), range(128, 256)).astype(bool)


def _sums(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(weights) + 1, dtype=np.int64)
    np.cumsum(weights, out=total[1:])
    return np.diff(total[bounds])


def _distinct(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct keys of each text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, doc))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.bincount(doc[order][new], minlength=len(counts))


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text, from its whole bytes."""
    bounds, data = utf8(texts)
    starts, ends, before = words(bounds, data)
    counts, size = np.diff(before), np.maximum(np.diff(bounds), 1)
    n = np.maximum(counts, 1)
    hashes = word_hashes(data, starts, ends)
    length = ends - starts
    triples = np.maximum(counts - 2, 0)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[before[:-1][before[:-1] < len(hashes)]] = False  # the first word of a text follows none
    longest = np.zeros(len(counts), dtype=np.int64)
    full = counts > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, before[:-1][full])
    columns = [np.log1p(counts), _sums(length, before) / n]
    columns += [_sums(kind[data], bounds) / size for kind in _KINDS]
    columns += [
        _distinct(hashes, counts) / n,
        _distinct(window_hashes(hashes, 3)[run_starts(counts, 3)], triples) / np.maximum(triples, 1),
        np.log1p(longest), _sums(length <= 2, before) / n, _sums(~_LETTER[data[ends - 1]], before) / n,
        _sums(again, before) / n,
    ]
    return np.column_stack(columns).astype(np.float32)


# Model


@dataclass
class AdditiveModel:
    """Sum of an intercept, one table per feature and one per pair of features."""

    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, features[:, k], side="right") for k, c in enumerate(self.cuts)]

    def score(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.intercept)
        bins = self.bins(features)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _leaf(gradient, weight):
    return gradient / (weight + 1.0)


def _gain(gradient, weight):
    return gradient * gradient / (weight + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with summed gradients and weights."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of each bin by a tree of at most ``depth`` levels of cuts."""
    gain, at = _best_cut(g, h)
    if depth and gain > 1e-9:
        return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def shallow_tree_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis and then each side along the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(a.sum(axis=1), b.sum(axis=1))
        if not at:
            continue
        values, total = np.zeros_like(a), -_gain(a.sum(), b.sum())
        for rows in (slice(0, at), slice(at, None)):
            ga, hb = a[rows].sum(axis=0), b[rows].sum(axis=0)
            _, cut = _best_cut(ga, hb)
            for cols in (slice(0, cut), slice(cut, None)):
                total += _gain(ga[cols].sum(), hb[cols].sum())
                values[rows, cols] = _leaf(ga[cols].sum(), hb[cols].sum())
        if total > best[0]:
            best = (float(total), values.T if turned else values)
    return best


def fit_model(
    features: np.ndarray, labels: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS,
    pair_rounds: int = PAIR_ROUNDS, rate: float = RATE,
) -> AdditiveModel:
    count = features.shape[1] if features.ndim == 2 else len(FEATURES)
    y = labels.astype(float)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        empty = [np.zeros(0) for _ in range(count)]
        return AdditiveModel(empty, float(np.log(share / (1 - share))), [np.zeros(1)] * count)
    grid = np.arange(1, bins) / bins
    cuts = [np.unique(np.quantile(features[:, k], grid)) for k in range(count)]
    model = AdditiveModel(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    binned = model.bins(features)
    total = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, (b, table) in enumerate(zip(binned, model.tables)):
            g, h = gradients()
            step = rate * shallow_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            model.tables[k] = table + step
            total += step[b]

    def pair_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        cell = binned[i] * shape[1] + binned[j]
        g, h = gradients()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    ranked = sorted(combinations(range(count), 2), key=lambda p: -shallow_tree_pair(*pair_sums(*p)[1:])[0])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            cell, g, h = pair_sums(*pair)
            step = rate * shallow_tree_pair(g, h)[1]
            model.pair_tables[k] = model.pair_tables[k] + step
            total += step.ravel()[cell]
    return model


# Tables


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``features`` of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = text_features(part.column("text"))
                bounds = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
                rows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc_id", "features"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(measure, "doc_id bigint, features array<float>")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))


def learn(features: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on labelled rows (``doc_id``, ``quality``) that are not held out, at most ``max_rows`` of them."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    marked = features.join(usable.select("doc_id", "quality"), "doc_id")
    sample = bounded_sample(marked, "doc_id", max_rows, usable.count()).select("features", "quality").toPandas()
    values = np.array(sample["features"].tolist(), dtype=np.float32).reshape(len(sample), len(FEATURES))
    return fit_model(values, sample["quality"].to_numpy())


def score_features(features: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of features."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(values))], ["doc_id", "score"])

    scored = features.mapInArrow(add, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document with a model learnt from ``labels``."""
    features = materialise(document_features(docs))
    return score_features(features, learn(features, labels, max_rows), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, in the columns they have."""
    model = learn(document_features(docs), labels, max_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(text_features(part.column("text"))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
