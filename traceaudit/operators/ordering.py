"""Global and per-group order without collecting a group into one task.

``row_number() over (order by ...)`` sends every row to one task, and the same
window with a PARTITION BY sends a hot group to one task. The helpers here cut
the order into slices first, count each slice, and add the counts of the
earlier slices to the position inside the slice. Work and memory per task are
then bounded by rows / slices even if a single key owns a third of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SPACE = float(1 << 32)
EXACT_DOUBLES = float(1 << 53)


def slice_count(df: DataFrame) -> int:
    """One slice per shuffle partition of the session."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with equal keys in one partition, for Python that works along runs of keys.

    By a hash of the keys: a shuffle by the keys themselves is left out after a join by them, and when the join then
    turns out small enough to broadcast, its shuffle is read where it lies and equal keys are apart again.
    """
    return df.repartition(F.xxhash64(*keys))


def seeded_hash(key: Column | str, seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly, the same in every engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_point(digest: Column) -> Column:
    """First 32 bits of a hex digest as a number in [0, 2**32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_draw(key: Column | str, seed: int, below: Column) -> Column:
    """Deterministic draw in [0, below) for a key, from 60 bits of its digest."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 15), 16, 10).cast("bigint") % below


def hash_fraction(key: Column | str, seed: int) -> Column:
    """Deterministic draw in [0, 1) for a key."""
    return hash_point(seeded_hash(key, seed)).cast("double") / F.lit(HASH_SPACE)


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"cannot slice on {name}: {kind.simpleString()} has no numeric order")


def _quantiles(df: DataFrame, order_col: str, wanted: int) -> list[float]:
    """Approximate quantiles of a numeric or time column: one pruned pass."""
    probes = [i / wanted for i in range(1, wanted)]
    return df.select(_as_number(df, order_col).alias("v")).approxQuantile("v", probes, 0.25 / wanted)


def _bucketize(df: DataFrame, order_col: str, cuts: Iterable[float], name: str) -> DataFrame:
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0.0))
    marked = df.withColumn("_order_value", _as_number(df, order_col))
    bucketizer = Bucketizer(splits=splits, inputCol="_order_value", outputCol=name, handleInvalid="keep")
    return bucketizer.transform(marked).drop("_order_value")


def _beyond_double(df: DataFrame, name: str) -> Column | None:
    """What the double of a 64-bit integer leaves out: orders keys above 2**53 that share a double."""
    if not isinstance(df.schema[name].dataType, T.LongType):
        return None
    return F.col(name) - F.col(name).cast("double").cast("bigint")


def add_slices(
    df: DataFrame, order: Sequence[str], name: str = "_slice", sample_of: DataFrame | None = None
) -> DataFrame:
    """Label rows with the slice of their order value.

    Slices follow approximate quantiles of the first order column, so they hold
    similar numbers of rows whatever the distribution. A value so frequent that
    it covers several quantiles gets slices of its own, cut by the next order
    column; for 64-bit integers the rest of the value comes before that.
    ``sample_of`` names a cheaper table with the same distribution.
    """
    base = df if sample_of is None else sample_of
    wanted = slice_count(df)
    cuts = _quantiles(base, order[0], wanted)
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    rest = _beyond_double(df, order[0])
    if rest is not None and any(abs(h) >= EXACT_DOUBLES for h in heavy):
        order = [order[0], "_rest", *order[1:]]
        df, base = df.withColumn("_rest", rest), base.withColumn("_rest", _beyond_double(base, order[0]))
    heavy = heavy if len(order) > 1 else []
    sliced = _bucketize(df, order[0], [*cuts, *[math.nextafter(h, math.inf) for h in heavy]], name)
    if not heavy:
        return sliced
    tied = _as_number(df, order[0]).isin(*heavy)
    # Only rows of the frequent values have a place in the inner slices; width is above any of these.
    inner = add_slices(sliced, order[1:], f"{name}_inner", base.filter(tied))
    width = (8 * (wanted + 2)) ** (len(order) - 1)
    combined = F.col(name) * width + F.when(tied, F.col(f"{name}_inner")).otherwise(0.0)
    return inner.withColumn(name, combined).drop(f"{name}_inner", "_rest")


def add_hash_slices(df: DataFrame, digest_col: str, name: str = "_slice") -> DataFrame:
    """Slices of a uniform digest; no pass over the data is needed."""
    wanted = slice_count(df)
    return df.withColumn(name, F.floor(hash_point(F.col(digest_col)) * F.lit(wanted / HASH_SPACE)).cast("double"))


def _sorted(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def number_slices(
    sliced: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "position",
    descending: bool = False,
    slice_col: str = "_slice",
) -> DataFrame:
    """Positions 1..n per group over a table that already carries slices."""
    keys = [*by, slice_col]
    slice_order = F.col(slice_col).desc() if descending else F.col(slice_col)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys).orderBy(*_sorted(order))
    return (
        sliced.join(offsets, keys, "left")
        .withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .drop("_offset", slice_col)
    )


def positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "position",
    sample_of: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in ascending ``order``, whole table or per group.

    The first order column is numeric or a time and cuts the slices; the rest
    break ties, and the second one splits very frequent values of the first.
    """
    return number_slices(add_slices(df, order, sample_of=sample_of), order, by, name)


def seeded_positions(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """1-based position in a seeded pseudo-random order of ``key``."""
    hashed = df.withColumn("_digest", seeded_hash(key, seed))
    return number_slices(add_hash_slices(hashed, "_digest"), ["_digest", key], by, name).drop("_digest")


def running_totals(
    counts: DataFrame,
    order_col: str,
    totals: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    sample_of: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums over distinct order values.

    ``totals`` maps an input column to the name of its running sum. ``counts``
    has one row per (group, order value), so ties are already one row.
    """
    sliced = add_slices(counts, [order_col], sample_of=sample_of)
    keys = [*by, "_slice"]
    slice_order = F.col("_slice").desc() if descending else F.col("_slice")
    value_order = F.col(order_col).desc() if descending else F.col(order_col)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = sliced.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    offsets = per_slice.select(
        *keys, *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in totals]
    )
    inside = Window.partitionBy(*keys).orderBy(value_order).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.join(offsets, keys, "left")
    for column, out in totals.items():
        joined = joined.withColumn(out, F.sum(column).over(inside) + F.col(f"_o_{column}"))
    return joined.drop("_slice", *[f"_o_{c}" for c in totals])


def exact_medians(df: DataFrame, value: str, by: Sequence[str], name: str = "median") -> DataFrame:
    """Median per group from counts per distinct value and their running totals.

    ``median()`` keeps all values of a group in one task; here a hot group is
    spread over the value slices.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(counts, value, {"_n": "_upto"}, by=by, sample_of=df.select(value))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    joined = upto.join(totals, list(by)) if by else upto.withColumn("_total", totals.scalar())
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = [F.min(F.when(F.col("_upto") >= rank, F.col(value))) for rank in (low, high)]
    return joined.groupBy(*by).agg(((middle[0] + middle[1]) / 2.0).alias(name))
