"""Watermark evidence in token sequences.

Green membership comes either from a table supplied by the key holder or from a
keyed hash of (context, token). The hash mode is a scheme of its own: it does
not reproduce the green lists of generators based on random permutations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from traceaudit.functions.ngrams import gram_counts
from traceaudit.functions.stats import green_p_exact, green_p_normal, green_z, hoeffding, ratio
from traceaudit.functions.text import aligned_slices, as_column
from traceaudit.operators.combine import beside
from traceaudit.operators.ordering import HASH_SPACE, hash_point

DEDUP_MODES = ("none", "v1", "v2")
# The noise grid around a frequency and the smallest usable sample.
GRID_POINTS = 64
GRID_GUARD = 0.5
FALLBACK_GRID = (1.0, 40.0)
MIN_PAIRS = 8
NOISE_FLOOR = 1e-12


def ngram_counts(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """Frequency of every n-gram; tasks count n-grams by number and write each distinct one once before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from gram_counts(batch.column(0), n)

    counted = df.select(F.col(tokens).cast("array<string>")).mapInArrow(count, "ngram string, n bigint")
    return counted.groupBy("ngram").agg(F.sum("n").alias("n"))


def top_ngrams(df: DataFrame, tokens: str, n: int, k: int) -> DataFrame:
    return ngram_counts(df, tokens, n).orderBy(F.col("n").desc(), "ngram").limit(k)


def scored_positions(df: DataFrame, ident: str, tokens: str, ngram: int) -> DataFrame:
    """One row per scored token with its context; scoring starts one token after the first n-gram."""
    entries = aligned_slices(as_column(tokens).cast("array<string>"), ngram + 1)
    later = F.slice(entries, 2, F.greatest(F.size(entries) - 1, F.lit(0)))
    exploded = df.select(F.col(ident).alias("sequence"), F.posexplode(later).alias("place", "e"))
    context = F.concat_ws(" ", *[F.col("e")[f"g{i}"] for i in range(ngram)])
    return exploded.select("sequence", "place", context.alias("context"), F.col("e")[f"g{ngram}"].alias("token"))


#: Bytes of pairs, and pairs, that a task gathers before it drops repeats; as many bytes of all pairs come to a bucket.
PAIR_BYTES = 1 << 25
PAIR_ROWS = 1 << 20
_CODEC = "zstd"
_PAIR = ["context", "token"]


def _packed(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Length of each text in bytes, -1 for null, and all texts one after the other."""
    lengths = pc.fill_null(pc.binary_length(column), -1).to_numpy(zero_copy_only=False).astype("<i4")
    known = pc.fill_null(column, "")
    _, ends, texts = known.buffers()
    ends = np.frombuffer(ends, "<i4")[known.offset : known.offset + len(known) + 1]
    return lengths, bytes(texts[int(ends[0]) : int(ends[-1])]) if texts else b""


def _unpacked(lengths: np.ndarray, texts: memoryview) -> pa.Array:
    ends = np.append(0, np.cumsum(np.maximum(lengths, 0))).astype("<i4")
    column = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(texts))
    return pc.if_else(pa.array(lengths >= 0), column, pa.scalar(None, pa.string()))


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, compressed blocks of the distinct pairs of each bucket, of bounded parts of the rows."""
    codec = pa.Codec(_CODEC)

    def blocks(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(rows).group_by(["bucket", *_PAIR], use_threads=False).aggregate([])
        found = found.sort_by([(c, "ascending") for c in ("bucket", *_PAIR)]).combine_chunks()
        buckets = found["bucket"].to_numpy()
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        out = {"bucket": buckets[starts], "pairs": np.diff(starts, append=len(buckets)), "lengths": [], "texts": []}
        for start, count in zip(starts, out["pairs"]):
            part = found.slice(start, count)
            lengths, texts = zip(*[_packed(part[c].combine_chunks()) for c in _PAIR])
            out["lengths"].append(codec.compress(np.concatenate(lengths).tobytes(), asbytes=True))
            out["texts"].append(codec.compress(b"".join(texts), asbytes=True))
        return pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("pairs", pa.int64()), ("lengths", pa.binary()), ("texts", pa.binary())]))

    rows, count, volume = [], 0, 0
    for batch in batches:
        rows, count, volume = [*rows, batch], count + batch.num_rows, volume + batch.nbytes
        if count >= PAIR_ROWS or volume >= PAIR_BYTES:
            yield blocks(rows)
            rows, count, volume = [], 0, 0
    if count:
        yield blocks(rows)


def _distinct_pairs(blocks: pa.Table) -> pa.Table:
    """Distinct pairs of the blocks of one bucket."""
    codec = pa.Codec(_CODEC)
    parts = []
    for pairs, packed, texts in zip(*[blocks[c].to_pylist() for c in ("pairs", "lengths", "texts")]):
        lengths = np.frombuffer(codec.decompress(packed, 2 * pairs * 4), "<i4").reshape(2, pairs)
        size = [int(np.maximum(x, 0).sum()) for x in lengths]
        plain = memoryview(codec.decompress(texts, sum(size), asbytes=True))
        parts.append(pa.table([_unpacked(lengths[0], plain[: size[0]]), _unpacked(lengths[1], plain[size[0] :])], _PAIR))
    return pa.concat_tables(parts).group_by(_PAIR, use_threads=False).aggregate([])


def pair_volume(df: DataFrame, tokens: str, ngram: int, size: str | None = None) -> Column:
    """About how many bytes the contexts and tokens of all scored positions have, as a scalar subquery."""
    words = F.octet_length(F.array_join(as_column(tokens).cast("array<string>"), " ", "")) if size is None else F.col(size)
    return df.agg(F.sum(words.cast("bigint")) * (ngram + 1)).scalar()


def distinct_pairs(scored: DataFrame, volume: Column) -> DataFrame:
    """Each (context, token) pair once.

    Pairs are dealt to buckets by their hash, as many as their ``volume`` asks for. A task drops repeats in parts of its
    rows and shuffles the rest of a bucket as one sorted, compressed block. Pairs are compared as they are, not by hashes.
    """
    count = F.greatest(F.ceil(F.coalesce(volume, F.lit(0)) / F.lit(PAIR_BYTES)), F.lit(1))
    bucket = F.pmod(F.xxhash64(*_PAIR), count).cast("int").alias("bucket")
    blocks = scored.select(*_PAIR, bucket).mapInArrow(_pack_pairs, "bucket int, pairs bigint, lengths binary, texts binary")
    return blocks.groupBy("bucket").applyInArrow(_distinct_pairs, "context string, token string")


def deduplicate(scored: DataFrame, mode: str, volume: Column | None = None) -> DataFrame:
    """Drop repeated evidence: per context (v1) or per context and token (v2), first one kept.

    ``volume`` is about the bytes of all pairs, where the caller knows them without another pass over ``scored``.
    """
    if mode not in DEDUP_MODES:
        raise ValueError(f"mode must be one of {DEDUP_MODES}")
    if mode == "none":
        return scored.select("context", "token")
    if mode == "v2":
        if volume is None:
            volume = scored.agg(F.sum(F.octet_length(F.concat_ws(" ", *_PAIR)).cast("bigint"))).scalar()
        return distinct_pairs(scored, volume)
    return scored.groupBy("context").agg(F.min_by("token", F.struct("sequence", "place")).alias("token"))


def hashed_green(key: str, gamma: float) -> Column:
    """Keyed-hash membership of (context, token)."""
    digest = F.md5(F.concat_ws("|", F.lit(key), F.col("context"), F.col("token")))
    return hash_point(digest) < F.lit(gamma * HASH_SPACE)


def green_test(
    df: DataFrame,
    ident: str,
    tokens: str,
    ngram: int,
    gamma: float,
    key: str | None = None,
    membership: DataFrame | None = None,
    contexts: DataFrame | None = None,
    mode: str = "none",
    size: str | None = None,
) -> DataFrame:
    """Green-token test over all sequences together.

    ``membership`` is a table (context, token) of green pairs; without it the
    keyed hash decides. ``contexts`` restricts scoring to known contexts.
    ``size`` is a column with about the bytes of a sequence; without it mode
    v2 adds them up from the tokens, which makes the tokens once more.
    """
    scored = scored_positions(df, ident, tokens, ngram)
    if contexts is not None:
        scored = scored.join(contexts.select("context").distinct(), "context", "left_semi")
    unique = deduplicate(scored, mode, pair_volume(df, tokens, ngram, size) if mode == "v2" else None)
    if membership is None:
        if key is None:
            raise ValueError("give a key or a membership table")
        # Membership depends on the row alone: no pair has to meet its likes.
        marked = unique.select(F.lit(1).alias("n"), hashed_green(key, gamma).alias("green"))
    else:
        pairs = unique.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"))
        green = membership.select("context", "token").distinct().withColumn("green", F.lit(True))
        marked = pairs.join(green, ["context", "token"], "left")
    counts = marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("scored_tokens"),
        F.coalesce(F.sum(F.when(F.col("green"), F.col("n"))), F.lit(0)).alias("green_score"),
    )
    totals = df.agg(F.count(F.lit(1)).alias("num_samples"), F.sum(F.size(tokens)).alias("total_tokens"))
    return beside(counts, totals).withColumns(
        {
            "green_rate": F.col("green_score") / F.greatest(F.col("scored_tokens"), F.lit(1)),
            "z_score": green_z("green_score", "scored_tokens", gamma),
            "p_value_z": green_p_normal("green_score", "scored_tokens", gamma),
            "p_value_binomial": green_p_exact("green_score", "scored_tokens", gamma),
        }
    )


def mask_test(df: DataFrame, tokens: str, mask: DataFrame, fraction: float) -> DataFrame:
    """Vocabulary-mask test; tokens outside the mask table are not scored.

    Token counts combine first, so a very frequent token reaches the join as
    one row.
    """
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.join(mask.select("token", "green"), "token")
    sums = scored.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_tokens"),
        F.coalesce(F.sum(F.when(F.col("green"), F.col("n"))), F.lit(0)).alias("green_hits"),
    )
    rate = ratio(F.col("green_hits"), F.col("num_tokens"))
    z = (rate - fraction) / F.sqrt(F.lit(fraction * (1 - fraction)) / F.col("num_tokens"))
    return sums.withColumns({"green_rate": rate, "z_score": F.when(F.col("num_tokens") > 0, z)})


def noise_grid(frequency: float) -> list[float]:
    grid = np.linspace(max(0.5, frequency / 4), frequency * 4, GRID_POINTS)
    grid = grid[np.abs(grid - frequency) > GRID_GUARD]
    return [float(w) for w in (grid if len(grid) else np.linspace(*FALLBACK_GRID, GRID_POINTS))]


#: Points whose angles are taken at all frequencies at once.
_POINTS = 4096


def wave_sums(points: DataFrame, frequencies: Sequence[float]) -> DataFrame:
    """Sums over ``(t, y)`` per angular frequency: ``w, n, yy, s2, c2, yc, ys``; null values add nothing but to ``n``.

    A task takes blocks of points times frequencies and returns one row, with its sums for all frequencies.
    """
    waves = np.array(frequencies, dtype=float)
    names = ("s2", "c2", "yc", "ys")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, yy, sums = 0, 0.0, np.zeros((len(names), len(waves)))
        for batch in batches:
            n += batch.num_rows
            known = [batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("t", "y")]
            t, y = (np.where(k, batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) for k, c in zip(known, ("t", "y")))
            yy += float(y @ y)
            for at in range(0, batch.num_rows, _POINTS):
                place = slice(at, at + _POINTS)
                angle = np.outer(t[place], waves)
                sine, cosine = np.sin(angle), np.cos(angle)
                timed, both = known[0][place].astype(float), y[place] * known[0][place]
                sums += [2 * (timed @ (sine * cosine)), timed @ (cosine * cosine - sine * sine), both @ cosine, both @ sine]
        columns = [[n], [yy], *[[row.tolist()] for row in sums]]
        kinds = [pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * len(names)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "yy", *names])

    partial = points.mapInArrow(fold, "n bigint, yy double, " + ", ".join(f"{c} array<double>" for c in names))
    wave = F.array(*[F.lit(float(w)) for w in frequencies]).alias("w")
    rows = partial.select("n", "yy", F.explode(F.arrays_zip(wave, *names)).alias("e"))
    return rows.groupBy(F.col("e.w").alias("w")).agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), *[F.sum(f"e.{c}").alias(c) for c in names])


def periodogram(df: DataFrame, t: str, y: str, frequencies: Sequence[float]) -> DataFrame:
    """Normalised Lomb-Scargle power per angular frequency.

    Power needs only sums of sines and cosines, so each task folds its rows into one row and nothing else is shuffled.
    """
    centre = df.agg(F.avg(y).alias("m")).scalar()
    points = df.select(F.col(t).cast("double").alias("t"), (F.col(y) - centre).cast("double").alias("y"))
    sums = wave_sums(points, frequencies).filter("n > 0")
    shifted = sums.withColumn("phase", F.atan2("s2", "c2") / 2)
    c, s, phase = F.cos("phase"), F.sin("phase"), F.col("phase")
    cc = 0.5 * (F.col("n") + F.col("c2") * F.cos(2 * phase) + F.col("s2") * F.sin(2 * phase))
    ss = F.col("n") - cc
    in_phase = F.col("yc") * c + F.col("ys") * s
    out_phase = F.col("ys") * c - F.col("yc") * s
    power = 0.5 * (in_phase * in_phase / cc + out_phase * out_phase / ss) * 2.0 / F.col("yy")
    return shifted.select("w", "n", power.alias("power"))


def periodic_snr(df: DataFrame, t: str, y: str, frequency: float) -> DataFrame:
    """Power at one frequency over the mean power of the noise grid; 0 for tiny samples."""
    grid = noise_grid(frequency)
    spectrum = periodogram(df, t, y, [frequency, *grid])
    target = F.max(F.when(F.col("w") == frequency, F.col("power")))
    noise = F.avg(F.when(F.col("w") != frequency, F.col("power"))) + NOISE_FLOOR
    found = spectrum.agg(F.coalesce(F.max("n"), F.lit(0)).alias("num_pairs"), (target / noise).alias("snr"))
    return found.withColumn("snr", F.when(F.col("num_pairs") >= MIN_PAIRS, F.col("snr")).otherwise(0.0))


def context_mass(df: DataFrame, suffix: Sequence[str], order: Sequence[str], mass: str, gamma: float) -> DataFrame:
    """Mean green mass over unique contexts (first occurrence kept) with its tail bound."""
    firsts = df.groupBy(*suffix).agg(F.min_by(mass, F.struct(*order)).alias("mass"))
    sums = firsts.agg(F.avg("mass").alias("gtp"), F.count(F.lit(1)).alias("num_contexts"))
    return sums.withColumn("h", hoeffding("gtp", gamma, "num_contexts")).select("gtp", "num_contexts", "h.*")


def phase_table(vocabulary: DataFrame, token: str, vector: str, key: Sequence[float]) -> DataFrame:
    """Phase in [0, 1] per token: normal CDF of the scaled projection on a secret vector."""
    weights = [float(k) for k in key]
    scale = (len(weights) / 3.0) ** 0.5
    cdf = NormalDist().cdf

    @pandas_udf(T.DoubleType())
    def phase(projection: pd.Series) -> pd.Series:
        return projection.map(lambda v: cdf(v / scale), na_action="ignore")

    terms = F.zip_with(vector, F.array(*[F.lit(w) for w in weights]), lambda a, b: a.cast("double") * b)
    projection = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    return vocabulary.select(token, phase(projection).alias("phase"))
