"""Approximate nearest neighbours by cosine: balanced posting lists with boundary replicas and distance-ratio pruning.

Centroids are fitted on a sample of at most ``MAX_SAMPLE`` distinct vectors (those of the smallest hashes of their id)
and moved until no list of the sample is more than twice the mean. A graph that links each centroid to its nearest
ones finds, in memory, the centroids near a vector. Every vector enters its nearest list and, as a boundary vector, up
to ``REPLICAS`` lists whose centroids are nearly as near; a query searches all lists whose centroid is within a ratio of
its nearest one's distance, and on to the next ones until they hold ``LEAST_HELD * k`` vectors. Lists and their queries
are dealt to tasks in blocks of bounded size. A query that still has fewer than k neighbours is compared with all rows.

Of equal vectors only the ``k + 1`` smallest ids are indexed, each once: no others can be among the k nearest, ties
going to the smaller id. So a vector that a third of all rows share fills no list, and no result changes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another length than most, nor rows without id; rows that repeat an id are candidates of their own, but none of their
own id's queries. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.store import bounded_sample, materialise

#: Vectors that centroids are fitted on, lists at most, and vectors per list aimed at.
MAX_SAMPLE, MAX_LISTS, PER_LIST = 20_000, 2048, 200
#: Replicas of a boundary vector, and how much farther their centroids may be.
REPLICAS, BOUNDARY_RATIO = 2, 0.06
#: How much farther than the nearest a searched list's centroid may be.
SEARCH_RATIO = 0.30
#: Vectors, as a multiple of k, that the searched lists hold at least.
LEAST_HELD = 10
LINKS, BEAM = 16, 8
#: Vectors and queries that a task compares at once.
BLOCK = 4096
_ROUNDING = 1e-9


# Centroids and their graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of a balanced clustering of unit vectors."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), lists, replace=False)].copy()
    for step in range(rounds):
        owner = np.argmax(sample @ centroids.T, axis=1)
        sizes = np.bincount(owner, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
        if step + 2 < rounds:  # the smallest lists begin anew inside the overfull ones
            order = np.argsort(sizes, kind="stable")
            full = [c for c in order[::-1] if sizes[c] > 2 * len(sample) / lists][: lists // 2]
            for small, large in zip(order, full):
                centroids[small] = sample[draw.choice(np.flatnonzero(owner == large))]
    return centroids


def link_centroids(centroids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones and those it is nearest to, padded with itself."""
    count = len(centroids)
    near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1 : links + 1]
    sides: list[set[int]] = [set(row.tolist()) for row in near]
    for a, row in enumerate(near):
        for b in row.tolist():
            sides[b].add(a)
    width = max(1, max(map(len, sides)))
    return np.array([sorted(s) + [k] * (width - len(s)) for k, s in enumerate(sides)]).reshape(count, width)


def graph_search(vectors: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float) -> np.ndarray:
    """Distances to the centroids that the search meets (the others are infinite), for unit vectors.

    It walks from one entry, always on from the ``BEAM`` nearest centroids and all within the ratio of the nearest.
    """
    count, lists = len(vectors), len(centroids)
    far = np.full((count, lists), np.inf)
    done = np.zeros((count, lists), dtype=bool)
    flat = np.arange(count) * lists
    while len(flat):
        row, col = np.divmod(flat, lists)
        dots = np.einsum("ij,ij->i", vectors[row], centroids[col])
        far[row, col] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))
        beam = min(BEAM, lists) - 1
        limit = np.maximum(far.min(axis=1) * (1 + ratio), np.partition(far, beam, axis=1)[:, beam])
        row, col = np.nonzero((far <= limit[:, None]) & np.isfinite(far) & ~done)
        done[row, col] = True
        flat = np.unique(np.repeat(row * lists, graph.shape[1]) + graph[col].ravel())
        flat = flat[np.isinf(far.ravel()[flat])]
    return far


# Tables


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id``, ``vector`` (doubles) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0").filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.agg(F.max(F.struct("rows", "n"))["n"]).first()[0] or 0
    return rows.filter(F.size("v") == usual).select("vec_id", F.col("v").alias("vector"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _with_lists(
    rows: DataFrame, centroids: np.ndarray, graph: np.ndarray, ratio: float, most: int | None,
    sizes: np.ndarray | None = None, least: int = 0,
) -> DataFrame:
    """A row for each vector and list within the ratio of its nearest one, at most ``most`` of them.

    With ``sizes`` of the lists, the next ones follow until those taken hold ``least`` vectors, if the search met as many.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                far = graph_search(_unit(_matrix(part.column("vector"), part.num_rows)), centroids, graph, ratio)
                near = far <= far.min(axis=1, keepdims=True) * (1 + ratio) + _ROUNDING
                if most is not None:
                    rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
                    near &= rank < most
                if sizes is not None:
                    order = np.argsort(far, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1) - sizes[order]
                    wanted = np.zeros_like(near)
                    np.put_along_axis(wanted, order, held < least, axis=1)
                    near |= wanted & np.isfinite(far)
                row, col = np.nonzero(near)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("vec_id"), taken.column("vector"), pa.array(col, pa.int32())], ["vec_id", "vector", "list"]
                )

    return rows.mapInArrow(assign, "vec_id bigint, vector array<double>, list int")


def _blocks(rows: DataFrame, mine: str, other: str, counts: DataFrame) -> DataFrame:
    """Each row in its own block of its list, beside every block of the other side."""
    own = F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int").alias(mine[2:])
    return rows.join(counts, "list").select(
        "list", "vec_id", "vector", own, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[2:])
    )


def nearest_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> tuple:
    """Rows (query, vector, cosine) of the k best ids per query: by a matrix product, then exactly on what is near its bar."""
    product = _unit(queries) @ _unit(vectors).T
    product[own[:, None] == ids[None, :]] = -np.inf
    by_id = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[0]] - 1))
    best = product if len(firsts) == len(ids) else np.maximum.reduceat(product[:, by_id], firsts, axis=1)
    bar = np.partition(best, -min(k, len(firsts)), axis=1)[:, -min(k, len(firsts))]
    row, col = np.nonzero((product >= bar[:, None] - _ROUNDING) & np.isfinite(product))
    length = lambda m: np.sqrt((m * m).sum(axis=1))
    score = (queries[row] * vectors[col]).sum(axis=1) / (length(queries)[row] * length(vectors)[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    if len(firsts) < len(ids):  # the best row of each id
        again = np.unique(np.stack([row, ids[col]]), axis=1, return_index=True)[1]
        row, col, score = (x[np.sort(again)] for x in (row, col, score))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], score[place < k]


def search(
    table: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    search_ratio: float = SEARCH_RATIO, boundary_ratio: float = BOUNDARY_RATIO, replicas: int = REPLICAS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``table`` found for each row of ``queries``."""
    rows = valid_vectors(table, key, vector)
    asked = valid_vectors(queries, key, vector)
    least = Window.partitionBy("vector").orderBy("vec_id")
    distinct = rows.dropDuplicates(["vec_id", "vector"])
    indexed = materialise(distinct.withColumn("_rank", F.dense_rank().over(least)).filter(F.col("_rank") <= k + 1))
    first = indexed.filter("_rank = 1")
    count = first.count()
    sample = bounded_sample(first, "vec_id", MAX_SAMPLE, count).select("vector").toPandas()["vector"]
    lists = max(1, min(MAX_LISTS, count // PER_LIST, len(sample) // 8))
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    centroids = fit_centroids(_unit(np.array(sample.tolist(), dtype=np.float64)), lists)
    graph = link_centroids(centroids)
    postings = materialise(_with_lists(indexed, centroids, graph, boundary_ratio, replicas))
    sizes = np.zeros(lists, dtype=np.int64)
    for row in postings.groupBy("list").agg(F.count_distinct("vec_id").alias("n")).collect():
        sizes[row["list"]] = row.n
    wanted = materialise(_with_lists(asked, centroids, graph, search_ratio, None, sizes, LEAST_HELD * k + 1))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    counts = postings.groupBy("list").agg(blocks.alias("n_vb")).join(wanted.groupBy("list").agg(blocks.alias("n_qb")), "list")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        own, ids = asked.column("vec_id").to_numpy(), held.column("vec_id").to_numpy()
        against = _matrix(held.column("vector").combine_chunks(), held.num_rows)
        vectors = _matrix(asked.column("vector").combine_chunks(), asked.num_rows)
        found = []
        for at in range(0, len(own), 256):
            row, col, score = nearest_of(vectors[at : at + 256], ids, against, own[at : at + 256], k)
            found.append((own[at : at + 256][row], ids[col], score))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    def nearest(asked: DataFrame, held: DataFrame, counts: DataFrame) -> DataFrame:
        keys = ["list", "vb", "qb"]
        near = (
            _blocks(asked, "n_qb", "n_vb", counts).groupBy(*keys)
            .cogroup(_blocks(held, "n_vb", "n_qb", counts).groupBy(*keys))
            .applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
        )
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = materialise(nearest(wanted, postings, counts))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialise(asked.join(enough, "vec_id", "left_anti").withColumn("list", F.lit(0)))
    if n_short := short.count():
        every = indexed.select("vec_id", "vector", F.lit(0).alias("list"))
        n_every = indexed.count()
        one = rows.sparkSession.range(1).select(
            F.lit(0).alias("list"), F.lit(-(-n_every // BLOCK)).alias("n_vb"), F.lit(-(-n_short // BLOCK)).alias("n_qb")
        )
        short_ids = short.select(F.col("vec_id").alias("query_id")).distinct()
        found = found.join(short_ids, "query_id", "left_anti").unionByName(nearest(short, every, one))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
