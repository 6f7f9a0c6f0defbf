"""Query-traffic detectors over text embeddings.

A series is cut into count windows of ``batch_size`` queries. Every statistic
is computed per window, so the unit of work is bounded by the window size, and
null replicates are windows like any other, spread over the cluster.
Statistics follow the published papers: kernel two-sample test (Gretton et al.
2012), distance-distribution test (Juuti et al. 2019), pair-similarity test
(Zhang et al. 2021).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.operators.ordering import hash_draw, hash_fraction, positions, running_totals, seeded_hash, seeded_positions
from traceaudit.session import materialise

# Default parameters of the detectors.
BATCH_SIZE = 100
NULL_SAMPLES = 1000
NORMAL_TRAIN_RATIO = 0.8
THRESHOLD_PERCENTILE = 95.0
REFERENCE_REPEATS = 20
PAIR_SAMPLE_SIZE = 200_000
PAIR_PERCENTILE = 99.0
KERNEL_SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)

WINDOW_SCHEMA = "window bigint, queries bigint, score double"


def to_double(embedding: Column | str) -> Column:
    return F.transform(F.col(embedding) if isinstance(embedding, str) else embedding, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def windows(df: DataFrame, order: str, size: int = BATCH_SIZE, keep_last: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Count windows in arrival order, as ``(window, slot, embedding)``; with ``by``, within each entity."""
    ordered = positions(df, [order], by)
    cut = ordered.select(
        F.floor((F.col("position") - 1) / F.lit(size)).alias("window"),
        ((F.col("position") - 1) % F.lit(size)).alias("slot"),
        "*",
    ).drop("position")
    if keep_last:
        return cut
    # Only the last window can be short, so the row count alone tells which are full.
    if by:
        totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
        return cut.join(totals, list(by)).filter(F.col("window") < F.floor(F.col("_total") / F.lit(size))).drop("_total")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cut.filter(F.col("window") < F.floor(total / F.lit(size)))


def null_windows(benign: DataFrame, ident: str, samples: int, size: int, seed: int) -> DataFrame:
    """Bootstrap windows drawn from benign rows.

    Draws are ``samples * size`` generated rows, joined first to the numbered
    ids and then to the embeddings; Spark chooses the joins by their sizes.
    """
    pool = seeded_positions(benign.select(ident), ident, seed)
    total = benign.agg(F.count(F.lit(1)).alias("total"))
    draws = benign.sparkSession.range(samples * size).withColumn("total", total.scalar())
    picked = draws.select(
        F.floor(F.col("id") / F.lit(size)).alias("window"),
        (F.col("id") % F.lit(size)).alias("slot"),
        (hash_draw("id", seed + 1, F.col("total")) + 1).alias("position"),
    )
    chosen = pool.join(picked, "position").drop("position")
    return benign.join(chosen, ident)


def score_windows(cut: DataFrame, score: Callable[[np.ndarray], float]) -> DataFrame:
    """Apply a window statistic; one call of it sees the rows of one window only."""

    def scored(blocks: Iterator[tuple[tuple, pa.Table]]) -> Iterator[pa.RecordBatch]:
        for (window,), rows in blocks:
            value = score(_block(rows))
            yield pa.RecordBatch.from_pydict({"window": [window], "queries": [rows.num_rows], "score": [value]})

    return _per_window(cut, ["window"], ["embedding"], scored, WINDOW_SCHEMA)


def _block(rows: pa.Table) -> np.ndarray:
    vectors = rows.column("embedding").combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows.num_rows, -1)


def _per_window(cut: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """Run ``work`` on the windows of a partition, one after the other.

    Windows are clustered by a shuffle on their keys and sorted inside the
    partition, so each is a run of rows; only a run is held, whatever the
    number of windows, and one Python call serves all windows of a partition.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        held, key = [], None
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if held and ids[a] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = ids[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield key, pa.Table.from_batches(held)

    ordered = cut.select(*keys, "slot", *columns).repartition(*keys).sortWithinPartitions(*keys, "slot")
    return ordered.mapInArrow(lambda batches: work(runs(batches)), schema)


# Distances


def pairwise(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        unit_a = a / np.linalg.norm(a, axis=1, keepdims=True)
        unit_b = b / np.linalg.norm(b, axis=1, keepdims=True)
        return 1.0 - unit_a @ unit_b.T
    if metric != "euclidean":
        raise ValueError("metric must be 'euclidean' or 'cosine'")
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def nearest_earlier(block: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distance of each row to its nearest earlier row; the first row has none."""
    gaps = pairwise(block, block, metric)
    gaps[np.triu_indices(len(block))] = np.inf
    return gaps[1:].min(axis=1)


def min_prev_distance(cut: DataFrame, ident: str, metric: str = "euclidean", by: Sequence[str] = ()) -> DataFrame:
    """Distance to the nearest earlier query of the same window (and entity), null for the first."""
    keys = [*by, "window"]

    def distances(blocks: Iterator[tuple[tuple, pa.Table]]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks:
            block = _block(rows)
            gaps = [None, *(nearest_earlier(block, metric) if len(block) > 1 else ())]
            columns = [rows.column(k).combine_chunks() for k in (*keys, ident)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gaps, pa.float64())], [*keys, ident, "min_distance"])

    kinds = [f"{k} {cut.schema[k].dataType.simpleString()}" for k in (*keys, ident)]
    return _per_window(cut, keys, [ident, "embedding"], distances, ", ".join([*kinds, "min_distance double"]))


# Kernel two-sample statistic


@dataclass(frozen=True)
class KernelReference:
    """Benign reference blocks and the bandwidth; its size is set by parameters alone."""

    blocks: np.ndarray
    bandwidth: float
    multi_kernel: bool

    def kernel(self, gaps: np.ndarray) -> np.ndarray:
        scales = KERNEL_SCALES if self.multi_kernel else (1.0,)
        square = gaps * gaps
        return np.mean([np.exp(-square / (2.0 * s * self.bandwidth**2)) for s in scales], axis=0)

    @cached_property
    def _inside(self) -> float:
        """Mean similarity within the reference blocks, the same for every window."""
        return float(np.mean([self._within(y) for y in self.blocks]))

    def _within(self, z: np.ndarray) -> float:
        k = self.kernel(pairwise(z, z))
        return (k.sum() - np.trace(k)) / (len(z) * (len(z) - 1)) if len(z) > 1 else float("nan")

    def statistic(self, block: np.ndarray) -> float:
        """Unbiased squared discrepancy, averaged over the reference blocks: one product of the window and all of them."""
        every = self.blocks.reshape(-1, self.blocks.shape[-1])
        return float(self._within(block) + self._inside - 2.0 * self.kernel(pairwise(block, every)).mean())


def kernel_reference(
    benign: DataFrame, ident: str, seed: int, size: int = BATCH_SIZE, repeats: int = REFERENCE_REPEATS, multi_kernel: bool = False
) -> KernelReference:
    """Draw ``repeats`` reference windows (repeats x size rows, a fixed amount)."""
    rows = null_windows(benign, ident, repeats, size, seed).select("window", "slot", "embedding").toPandas()
    ordered = rows.sort_values(["window", "slot"])
    blocks = np.stack(ordered["embedding"].to_numpy()).astype("float64").reshape(repeats, size, -1)
    # From differences: a row drawn twice is at no distance from itself.
    gaps = np.sqrt(((blocks[0][:, None] - blocks[0][None]) ** 2).sum(axis=2))[np.triu_indices(size, 1)]
    middle = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 1.0
    return KernelReference(blocks, middle, multi_kernel)


def mmd(cut: DataFrame, reference: KernelReference) -> DataFrame:
    return score_windows(cut, reference.statistic)


# Distance-distribution statistic


def shapiro_weights(n: int) -> np.ndarray:
    """Royston's 1992 weights of n ordered values, for n of at least 3."""
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    # Royston's polynomial weights for the two largest order statistics.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], 1.0 / np.sqrt(n))
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], 1.0 / np.sqrt(n))
    norm = float((m * m).sum())
    weights = np.empty(n)
    if n == 3:
        weights[:] = [-np.sqrt(0.5), 0.0, np.sqrt(0.5)]
        return weights
    top = last + m[-1] / np.sqrt(norm)
    if n <= 5:
        phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * top**2)
        weights[1:-1] = m[1:-1] / np.sqrt(phi)
    else:
        next_top = second + m[-2] / np.sqrt(norm)
        phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * top**2 - 2 * next_top**2)
        weights[2:-2] = m[2:-2] / np.sqrt(phi)
        weights[[1, -2]] = [-next_top, next_top]
    weights[[0, -1]] = [-top, top]
    return weights


def shapiro_w(values: np.ndarray) -> float:
    """Shapiro-Wilk W with Royston's 1992 weights."""
    x = np.sort(np.asarray(values, dtype="float64"))
    spread = x - x.mean()
    total = float((spread * spread).sum())
    if len(x) < 3 or total == 0.0:
        return 1.0
    return float(min(1.0, (shapiro_weights(len(x)) @ x) ** 2 / total))


def prada(cut: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Normality of the distances to the nearest earlier query, per window."""
    return score_windows(cut, lambda block: shapiro_w(nearest_earlier(block, metric)) if len(block) > 3 else 1.0)


# Pair-similarity statistic


def similar_pairs(block: np.ndarray, threshold: float, mode: str) -> float:
    similarity = 1.0 - pairwise(block, block, "cosine")
    upper = similarity[np.triu_indices(len(block), 1)]
    hits = float((upper >= threshold).sum())
    return hits if mode == "count" else (hits / len(upper) if len(upper) else 0.0)


def seat(cut: DataFrame, threshold: float, mode: str = "share") -> DataFrame:
    """Share or count of query pairs of a window at or above a similarity."""
    if mode not in ("share", "count"):
        raise ValueError("mode must be 'share' or 'count'")
    return score_windows(cut, lambda block: similar_pairs(block, threshold, mode))


def pair_threshold(
    benign: DataFrame, ident: str, seed: int, pairs: int = PAIR_SAMPLE_SIZE, percentile: float = PAIR_PERCENTILE
) -> float:
    """Similarity percentile over a fixed number of random benign pairs."""
    sampled = null_windows(benign, ident, pairs, 2, seed)
    left = sampled.filter("slot = 0").select("window", F.col("embedding").alias("a"))
    right = sampled.filter("slot = 1").select("window", F.col("embedding").alias("b"))
    similarity = left.join(right, "window").select(cosine(to_double("a"), to_double("b")).alias("s"))
    return similarity.agg(F.percentile("s", percentile / 100.0).alias("t")).first()["t"]  # over ``pairs`` rows


def held_out_split(benign: DataFrame, ident: str, seed: int, ratio: float = NORMAL_TRAIN_RATIO) -> tuple[DataFrame, DataFrame]:
    """Benign rows that references and nulls are drawn from, and those that detectors are rated on."""
    inside = hash_fraction(ident, seed) < ratio
    return benign.filter(inside), benign.filter(~inside)


def evaluation_windows(cut: DataFrame, batches: int = 0, seed: int = 0) -> DataFrame:
    """All windows, or ``batches`` of them by seeded order."""
    if not batches:
        return cut
    chosen = cut.select("window").distinct().orderBy(seeded_hash("window", seed), "window").limit(batches)
    return cut.join(chosen, "window")


# Decision


TAILS = ("upper", "lower", "two-sided")


def exact_percentile(scores: DataFrame, value: str, percentile: float) -> float | None:
    """Percentile with linear interpolation, from counts per distinct value and their running totals, at any number of rows."""
    known = scores.filter(F.col(value).isNotNull()).select(value)
    counts = materialise(known.groupBy(value).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("n")).first().n
    if not total:
        return None
    place = (total - 1) * percentile / 100.0
    low = int(place)
    upto = running_totals(counts, value, {"_n": "_upto"})
    wanted = [F.min(F.when(F.col("_upto") > rank, F.col(value))) for rank in (low, min(low + 1, total - 1))]
    a, b = upto.agg(*wanted).first()
    return a + (b - a) * (place - low)


def null_bounds(scores: DataFrame, percentile: float = THRESHOLD_PERCENTILE, tail: str = "upper") -> tuple[float | None, float | None]:
    """Bounds of the null scores (``samples`` rows): below the first or above the second a window is flagged.

    A two-sided test leaves half of the level on each side.
    """
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}")
    level = 1.0 - percentile / 100.0
    shares = {"upper": (None, 1.0 - level), "lower": (level, None), "two-sided": (level / 2, 1.0 - level / 2)}[tail]
    wanted = [s for s in shares if s is not None]
    found = scores.agg(F.percentile("score", F.lit(wanted)).alias("t")).first()["t"] or [None] * len(wanted)
    low = found[0] if shares[0] is not None else None
    return low, found[-1] if shares[1] is not None else None


def null_threshold(scores: DataFrame, percentile: float = THRESHOLD_PERCENTILE, tail: str = "upper") -> float:
    """The bound of a one-sided test."""
    if tail == "two-sided":
        raise ValueError("a two-sided test has two bounds: use null_bounds")
    low, high = null_bounds(scores, percentile, tail)
    return high if tail == "upper" else low


def flag_outside(scores: DataFrame, bounds: tuple[float | None, float | None]) -> DataFrame:
    """``detected``: the score lies strictly outside the bounds."""
    low, high = bounds
    hit = F.lit(False)
    if low is not None:
        hit = hit | (F.col("score") < low)
    if high is not None:
        hit = hit | (F.col("score") > high)
    return scores.withColumn("detected", F.coalesce(hit, F.lit(False)))


def flag_windows(scores: DataFrame, threshold: float, tail: str = "upper") -> DataFrame:
    return flag_outside(scores, (None, threshold) if tail == "upper" else (threshold, None))


def detection_rate(flagged: DataFrame, *by: str) -> DataFrame:
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("detected").alias("detected_windows"),
        F.avg(F.col("detected").cast("double")).alias("detection_rate"),
    )


def traffic_headline(summary: DataFrame) -> DataFrame:
    """Attacker detection rate, else true-positive rate, else NaN."""
    return summary.withColumn("score", F.coalesce("attacker_detection_rate", "tpr", F.lit(float("nan"))))


def mixed_batches(
    benign: DataFrame, observed: DataFrame, ident: str, ratios: Sequence[float], size: int, seed: int
) -> DataFrame:
    """Windows with a given share of observed queries: ``(ratio, window, ident, role)``.

    Each side is put in seeded order once and cut into per-window shares, so a
    window is a range of positions on both sides and no rows are paired.
    """
    sides = {
        "benign": seeded_positions(benign.select(ident), ident, seed),
        "observed": seeded_positions(observed.select(ident), ident, seed),
    }
    sizes = {role: df.count() for role, df in sides.items()}
    specs = []
    for ratio in ratios:
        take = {"observed": round(size * ratio)}
        take["benign"] = size - take["observed"]
        count = min(sizes[role] // n for role, n in take.items() if n)
        specs += [(float(ratio), role, n, count) for role, n in take.items() if n and count]
    parts = []
    for role, df in sides.items():
        plans = [F.struct(F.lit(r).alias("ratio"), F.lit(n).alias("take"), F.lit(c).alias("windows")) for r, who, n, c in specs if who == role]
        if not plans:
            continue
        spread = df.withColumn("plan", F.explode(F.array(*plans)))
        parts.append(
            spread.select(
                "plan.ratio",
                F.floor((F.col("position") - 1) / F.col("plan.take")).alias("window"),
                ident,
                F.lit(role).alias("role"),
                "plan.windows",
            ).filter("window < windows").drop("windows")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
