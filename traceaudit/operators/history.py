"""Nearest earlier query over a whole history, by a metric index.

A few pivots cut the space into cells (the rows nearest to a pivot) and each cell into rings of distance to its pivot.
Every row first meets the rows of its own ring, which bounds its distance. It then visits only those rings that the
triangle inequality cannot put beyond that bound: by the ring's range of distances to its pivot, and by the plane half
way between the row's pivot and the ring's. So the search ends exactly, whatever the data; how much it leaves out depends
on the data (repeated and similar queries end early, vectors without structure visit most rings).

Pivots and ring bounds are a fixed number of small arrays. Of equal vectors only the first is looked at: the others are
at no distance from it. A ring with many rows is dealt to blocks, inside which rows find their bound. For the visits a
history is cut into eras of bounded size, and the rings of an era lie in a few bundles: a row goes once to each bundle of
its own and earlier eras that has a ring in its reach, whatever the number of rings and blocks. A task holds one bundle
and streams the visitors of one era, so neither a hot ring nor a hot account fills a task. Accounts that fit one block
are compared inside it and need no rings. Vectors without structure meet all earlier ones: that is quadratic work, in
tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.operators.ordering import hash_fraction, positions, together
from traceaudit.session import materialise

PIVOTS, RINGS = 32, 16
#: Rows of a block, and of the sample that pivots and ring bounds are taken from.
BLOCK_ROWS, SAMPLE_ROWS = 4096, 4096
_METRICS = ("euclidean", "cosine")
#: Bytes of vectors (in doubles) of an era, and the bundles that its rings lie in.
ERA_BYTES, BUNDLES = 32 << 20, 4
#: Rows compared with a block at once, and distances held at once.
_TOGETHER, _DISTANCES = 512, 1 << 21
#: Slack of a bound for the rounding of distances, in shares of their scale.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, from the differences: 0 for equal vectors."""
    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample far from each other: each next one is farthest from those before it."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        farthest = int(np.argmax(near))
        if near[farthest] <= _SLACK * (1.0 + np.abs(sample[farthest]).max()):
            break
        chosen.append(farthest)
        near = np.minimum(near, _distances(sample, sample[farthest : farthest + 1])[:, 0])
    return sample[chosen]


class Rings:
    """Pivots and, for each, the inner bounds of its rings; the last ring is open."""

    def __init__(self, sample: np.ndarray, pivots: int, rings: int) -> None:
        self.pivots = spread_pivots(sample, pivots)
        self.between = _distances(self.pivots, self.pivots)
        cell, radius = self.place(sample)[:2]
        cuts = [np.quantile(radius[cell == c], np.arange(rings) / rings) if (cell == c).any() else np.zeros(rings) for c in range(len(self.pivots))]
        self.inner = np.array(cuts).reshape(-1, rings)
        self.inner[:, 0] = 0.0
        self.outer = np.append(self.inner[:, 1:], np.full((len(self.inner), 1), np.inf), axis=1)
        # Neighbouring rings with a like share of the sample make a bundle.
        rows = np.bincount(cell * rings + self.ring(cell, radius), minlength=self.inner.size)
        self.bundle = ((np.cumsum(rows) - rows) * BUNDLES // len(sample)).clip(max=BUNDLES - 1).reshape(self.inner.shape)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, its distance to the pivot, and the distances to all pivots."""
        far = _distances(x, self.pivots)
        cell = far.argmin(axis=1)
        return cell, far[np.arange(len(x)), cell], far

    def ring(self, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return (radius[:, None] >= self.inner[cell]).sum(axis=1) - 1

    def reachable(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which rings may hold rows nearer than ``bound``: (row, cell, ring)."""
        cell, radius, far = self.place(x)
        slack = bound + _SLACK * (1.0 + far.max(axis=1) + np.sqrt((x * x).sum(axis=1)))
        # Rows of another cell lie behind the plane half way between the pivots.
        apart = self.between[cell]
        plane = np.where(apart > 0, (far**2 - radius[:, None] ** 2) / np.where(apart > 0, 2 * apart, 1.0), 0.0)
        near = plane <= slack[:, None]
        inside = (far - slack[:, None])[:, :, None] <= self.outer
        return near[:, :, None] & inside & ((far + slack[:, None])[:, :, None] >= self.inner)


def _usable(df: DataFrame, vector: str, metric: str) -> DataFrame:
    """``df`` with ``_v`` in place of the vector (of length 1 for the cosine), without the rows that can't be compared."""
    # Floats stay as short as they are; ``_matrix`` makes doubles of them.
    short = metric == "euclidean" and df.schema[vector].dataType == T.ArrayType(T.FloatType())
    df = df if short else df.withColumn(vector, F.col(vector).cast("array<double>"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = column.flatten().to_numpy(zero_copy_only=False).astype("float64")  # nulls are not finite
            row = np.repeat(np.arange(len(counts)), counts)
            good = (counts > 0) & (np.bincount(row, ~np.isfinite(x), len(counts)) == 0)
            if metric == "cosine":
                with np.errstate(all="ignore"):
                    norm = np.sqrt(np.bincount(row, x * x, len(counts)))
                    good &= norm > 0
                    x = x / norm[row]
            ends = np.cumsum(np.append(0, counts[good])).astype(np.int32)
            values = pa.array(x[good[row]].astype("float32" if short else "float64"))
            others = [batch.column(c).filter(pa.array(good)) for c in names]
            yield pa.RecordBatch.from_arrays([*others, pa.ListArray.from_arrays(pa.array(ends), values)], [*names, "_v"])

    names = [c for c in df.columns if c != vector]
    kind = T.StructField("_v", T.ArrayType(T.FloatType() if short else T.DoubleType()))
    return df.mapInArrow(checked, T.StructType([*[df.schema[c] for c in names], kind]))


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Parts of batches with equal keys, and whether a part begins a new key."""
    last = None
    for batch in batches:
        ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            for at in range(a, b, _TOGETHER):
                yield batch.slice(at, min(_TOGETHER, b - at)), ids[a] != last
                last = ids[a]


def _nearest_before(y: np.ndarray, pos: np.ndarray, x: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``y`` with an earlier row in ``x`` (whose places ascend), and the nearest such row of each."""
    earlier = np.searchsorted(order, pos)
    some = np.flatnonzero(earlier)
    best = np.zeros(len(some), dtype=np.int64)
    square = (x * x).sum(axis=1)
    step = max(1, _DISTANCES // len(x))
    for at in range(0, len(some), step):
        rows = some[at : at + step]
        upto = earlier[rows]
        far = y[rows] @ x[: upto.max()].T
        far *= -2.0
        far += square[: upto.max()]
        if upto.min() < upto.max():
            far[np.arange(upto.max()) >= upto[:, None]] = np.inf
        best[at : at + step] = far.argmin(axis=1)
    return some, best


def _visits(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each visiting row to the nearest earlier row of the bundle: ``_id, distance``.

    ``bundles`` holds rows of bundles (``_bound`` null) and visitors with the bound they came with; a visitor that finds
    nothing nearer is not returned.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = [], []
        x = order = None
        for part, new in _runs(batches, keys):
            if new:
                held, places, x = [], [], None
            visitor = part.column("_bound").is_valid().to_numpy(zero_copy_only=False)
            if not visitor.all():
                rows = part.filter(pa.array(~visitor))
                held.append(_matrix(rows.column("_v")))
                places.append(rows.column("_pos").to_numpy())
            if visitor.any() and (held or x is not None):
                if x is None:
                    x, order = np.concatenate(held), np.concatenate(places)  # rows come in their order
                    held, places = [], []
                rows = part.filter(pa.array(visitor))
                y, pos, bound = _matrix(rows.column("_v")), rows.column("_pos").to_numpy(), rows.column("_bound").to_numpy()
                some, best = _nearest_before(y, pos, x, order)
                exact = _exact(y[some], x[best])
                nearer = exact < bound[some]
                yield pa.RecordBatch.from_arrays([rows.column("_id").take(pa.array(some[nearer])), pa.array(exact[nearer])], ["_id", "distance"])

    ordered = together(bundles, keys).sortWithinPartitions(*keys, F.col("_bound").isNotNull(), "_pos")
    return ordered.mapInArrow(meet, "_id bigint, distance double")


def _own_blocks(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each row to the nearest earlier one of its own block, infinite if there is none: ``_id, distance``."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part, new in _runs(batches, keys):
            y = _matrix(part.column("_v"))
            held = [y] if new else [*held, y]
            x = np.concatenate(held)  # rows come in their order
            far = _distances(y, x)
            far[np.arange(len(x))[None, :] >= (len(x) - len(y) + np.arange(len(y)))[:, None]] = np.inf
            best = far.argmin(axis=1)
            found = np.where(np.isfinite(far[np.arange(len(y)), best]), _exact(y, x[best]), np.inf)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found)], ["_id", "distance"])
            held = [x]

    ordered = together(placed, keys).sortWithinPartitions(*keys, "_pos")
    return ordered.mapInArrow(nearest, "_id bigint, distance double")


def nearest_earlier_distance(
    df: DataFrame, order: Sequence[str], vector: str = "embedding", by: Sequence[str] = (), metric: str = "euclidean",
    pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with ``min_distance``: how far the nearest earlier row is, of the same account if ``by`` names one.

    ``order`` columns put rows in sequence (the first is numeric or a time); rows that tie in all of them follow each
    other in any order. The first row of a series, and rows whose vector is null, empty, or holds null or non-finite
    components (or is zero, for the cosine), have no distance, and are no neighbours. All other vectors have one length.
    Null accounts are one account. Cosine distance is 1 - cosine.
    """
    if metric not in _METRICS:
        raise ValueError(f"metric must be one of {_METRICS}")
    spark, names = df.sparkSession, list(by)
    account = F.coalesce(F.to_json(F.struct(*names)), F.lit("")) if names else F.lit("")
    rows = materialise(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_account", account))
    narrow = materialise(_usable(rows.select(*dict.fromkeys(["_id", "_account", *order]), vector), vector, metric))
    numbered = positions(narrow, list(order), by=["_account"], name="_pos")
    placed_at = materialise(numbered.select("_id", "_account", "_pos", "_v"))
    # Equal vectors are at no distance: only the first of them is a neighbour and has one to look for.
    firsts = materialise(placed_at.groupBy("_account", "_v").agg(F.min_by("_id", "_pos").alias("_id"), F.min("_pos").alias("_pos")))
    copies = placed_at.join(firsts, "_id", "left_anti").select("_id", F.lit(0.0).alias("distance"))
    sizes = firsts.groupBy("_account").agg(F.count("*").alias("_rows"), F.max("_pos").alias("_last"))
    large = sizes.filter(F.col("_rows") > block_rows)

    # Small accounts are one block each; rows of the others get cells and rings.
    small = firsts.join(sizes.filter(F.col("_rows") <= block_rows), "_account", "left_semi")
    kept = copies.unionByName(_own_blocks(small, ["_account"]))
    many = firsts.join(large.select("_account", "_last"), "_account")
    total = many.count()
    if total:
        share = min(1.0, 2.0 * SAMPLE_ROWS / total)
        sample = many.filter(hash_fraction("_id", 13) < share).orderBy("_id").limit(SAMPLE_ROWS).select("_v").toArrow()
        if not sample.num_rows:
            sample = many.orderBy("_id").limit(SAMPLE_ROWS).select("_v").toArrow()
        index = Rings(_matrix(sample.column("_v").combine_chunks()), pivots, rings)
        kept = kept.unionByName(_over_rings(many, index, block_rows))
    best = kept.groupBy("_id").agg(F.min("distance").alias("_d"))
    found = F.when(F.col("_d") < float("inf"), F.col("_d"))
    if metric == "cosine":
        found = found * found / 2.0
    return rows.join(best, "_id", "left").withColumn("min_distance", found).drop("_id", "_account", "_d")


def _over_rings(rows: DataFrame, index: Rings, block_rows: int) -> DataFrame:
    """``_id, distance`` of rows of large accounts: one row per place where something nearer was found."""
    fields = [*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_ring", T.IntegerType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, radius, _ = index.place(_matrix(batch.column("_v")))
                ring = index.ring(cell, radius)
                columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(ring, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_cell", "_ring"])

    keys = ["_account", "_cell", "_ring"]
    in_rings = materialise(rows.mapInArrow(place, T.StructType(fields)))
    blocks = F.ceil(F.count("*") / block_rows).cast("int")
    counted = in_rings.groupBy(*keys).agg(blocks.alias("_blocks"))
    own = F.pmod(F.xxhash64("_pos"), F.col("_blocks")).cast("int")
    dealt = in_rings.join(counted, keys).withColumn("_block", own).drop("_blocks")
    bounds = materialise(_own_blocks(dealt, [*keys, "_block"]))

    bundle_of = index.bundle.ravel()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                reach = index.reachable(_matrix(part.column("_v")), part.column("_bound").to_numpy()).reshape(part.num_rows, -1)
                row, bundle = np.nonzero(np.stack([reach[:, bundle_of == b].any(axis=1) for b in range(BUNDLES)], axis=1))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bundle, pa.int32())], [*part.schema.names, "_bundle"])

    def era(position: str) -> Column:
        return F.floor((F.col(position) - 1) / F.lit(max(block_rows, ERA_BYTES // (8 * index.pivots.shape[1])))).cast("int")

    # A bundle meets the visitors of each era by themselves, those of its own era and later ones.
    bundled = F.get(F.lit(bundle_of.tolist()), F.col("_cell") * index.inner.shape[1] + F.col("_ring")).cast("int")
    held = in_rings.select(
        "_account", "_id", "_pos", "_v", F.lit(None).cast("double").alias("_bound"), bundled.alias("_bundle"),
        era("_pos").alias("_era"), F.explode(F.sequence(era("_pos"), era("_last"))).alias("_visiting"),
    )
    wanted = in_rings.select("_account", "_id", "_pos", "_v").join(bounds.withColumnRenamed("distance", "_bound"), "_id")
    going = wanted.mapInArrow(visit, T.StructType([*wanted.schema.fields, T.StructField("_bundle", T.IntegerType())]))
    visitors = going.select("*", F.explode(F.sequence(F.lit(0), era("_pos"))).alias("_era"), era("_pos").alias("_visiting"))
    return bounds.unionByName(_visits(held.unionByName(visitors), ["_account", "_era", "_bundle", "_visiting"]))
