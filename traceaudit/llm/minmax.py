"""Near-duplicate documents by min-max hashing: each permutation gives a set its smallest and its largest hash.

1. One pass over the texts signs each document's set of word n-grams: ``PERMUTATIONS`` hash evaluations give twice as
   many values. Two sets agree in a value with the probability of their Jaccard similarity, and the two values of a
   permutation err in opposite directions rather than together. Smallest and largest values are banded apart.
2. Sets that share a band value meet in its group. Their signatures, a byte per value, estimate the similarity without
   bias; pairs far below the threshold are no candidates. A group returns a spanning forest, not pairs.
3. The sets of each connected group of candidates meet once more and are compared n-gram by n-gram.

With 32 bands of four values a pair at 0.8 shares none of them once in 2 * 10**7 pairs, and its estimate falls below
``FLOOR`` once in 10**8; every link that is reported is exact. Nothing is sampled or capped.

A large group is dealt to tiles, and its first member, the hub, to all of them. Members that a tile connects with the
hub are done; only the others meet all other tiles. So a group of copies of one text costs its size, not its square.

Defined results: null, empty or blank texts have no n-grams and link with nothing; a text of fewer words than an n-gram
has is one. Rows without ``doc_id`` take no part, get a null component and are kept. Rows of one ``doc_id`` are sets of
their own: each gets the smallest id in reach of its text. Equal rows get equal results; texts of any length are
compared whole; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.components import connected_components
from traceaudit.llm.store import materialise
from traceaudit.llm.texts import hashed_words, mixed, packed_texts, run_starts, slices, unpacked, window_hashes

WIDTH, PERCENT = 2, 80
PERMUTATIONS, BAND_ROWS = 64, 4
#: Sets whose estimate is this far below the threshold are no candidates.
FLOOR = 0.2
#: Members of a tile at most: signatures, sets, and bytes of sets.
TILE_SIGNATURES, TILE_SETS, TILE_BYTES = 1024, 512, 16 << 20
_CHUNK_BYTES = 2 << 20


# Sets and signatures


def shingles(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending in each, and how many each text has."""
    words, counts = hashed_words(batch, lower=True)
    starts = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    grams = window_hashes(words, width)[run_starts(counts, width)]
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        if len(short):  # the whole sequence is one n-gram, told from longer ones by its length
            doc = np.append(doc, short)
            grams = np.append(grams, mixed(window_hashes(words, few)[starts[short]] + np.uint64(few)))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(doc[new], minlength=len(counts))


def digests(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    ends = np.cumsum(counts)
    found = []
    for salt in (0, 0x2545F4914F6CDD1D):
        total = np.zeros(len(grams) + 1, dtype=np.uint64)
        np.cumsum(mixed(grams ^ np.uint64(salt)), out=total[1:])
        found.append((total[ends] - total[ends - counts]).view(np.int64))
    return found[0], found[1]


def signatures(grams: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest hash of each set, which must not be empty, under each permutation: (permutation, set)."""
    draw = np.random.default_rng(11)
    factors = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 64, permutations, dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    low, high = (np.empty((permutations, len(counts)), dtype=np.uint64) for _ in range(2))
    for k, (factor, shift) in enumerate(zip(factors, shifts)):
        value = grams * factor + shift  # one evaluation for both
        np.minimum.reduceat(value, starts, out=low[k])
        np.maximum.reduceat(value, starts, out=high[k])
    return low, high


def band_values(low: np.ndarray, high: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A hash of each band's values, (set, band); bands hold either smallest or largest values."""
    values = np.concatenate([low, high])
    bands = np.zeros((values.shape[1], len(values) // rows), dtype=np.uint64)
    for band in range(bands.shape[1]):
        key = np.full(values.shape[1], band + 1, dtype=np.uint64)
        for value in values[band * rows : (band + 1) * rows]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value)
        bands[:, band] = key
    return bands


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, k1, k2, bands, signature`` of each row: size and a byte of each value; without n-grams neither."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=_CHUNK_BYTES):
                grams, counts = shingles(part, width)
                k1, k2 = digests(grams, counts)
                some = np.flatnonzero(counts)
                bands, marks = [None] * part.num_rows, [None] * part.num_rows
                if len(some):
                    low, high = signatures(grams, counts[some])
                    sizes = counts[some].astype("<i8").view(np.uint8).reshape(-1, 8)
                    short = np.hstack([sizes, mixed(np.concatenate([low, high])).astype(np.uint8).T])
                    for k, band, mark in zip(some.tolist(), band_values(low, high).view(np.int64), short):
                        bands[k], marks[k] = band, mark.tobytes()
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(k1), pa.array(k2)]
                columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "bands", "signature"])

    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(sign, schema)


# Groups


def walk(likes: Callable[[int, np.ndarray], np.ndarray], count: int, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest, from the first member on; ``likes(a, others)`` tells which of the others ``a`` links with.

    With ``fresh``, pairs of two members that are not fresh are not compared.
    """
    links, front, open_ = [], [], np.arange(count)
    while len(open_):
        if not front:
            starts = open_ if fresh is None else open_[fresh[open_]]
            if not len(starts):
                break
            front, open_ = [int(starts[0])], open_[open_ != starts[0]]
        at = front.pop()
        others = open_ if fresh is None or fresh[at] else open_[fresh[open_]]
        if len(others):
            found = others[likes(at, others)]
            if len(found):
                links += [(at, int(x)) for x in found]
                front += found.tolist()
                open_ = open_[~np.isin(open_, found, assume_unique=True)]
    return links


def forest(
    members: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    alike: Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]],
) -> DataFrame:
    """Links ``a, b`` that connect what is connected in each group of ``members`` (``grp, hub, tiles, node``).

    ``tiles`` is the number of tiles of a row's group, ``hub`` one of its nodes; ``fetch`` adds each node's ``data``
    where ``members`` leave it out.
    Groups of a tile are done at once; of larger ones each tile first connects its own members and the hub, and members
    that it leaves apart from the hub then meet all other tiles.
    """
    buckets = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    schema = "a bigint, b bigint, grp bigint, apart bigint"

    def connect(table: pa.Table) -> pa.Table:
        grp, tile, node, hub, tiles, fresh = (table.column(c).to_numpy() for c in ("grp", "tile", "node", "hub", "tiles", "fresh"))
        data = table.column("data").combine_chunks()
        order = np.lexsort((node, node != hub, tile, grp))
        new = np.flatnonzero((np.diff(grp[order]) != 0) | (np.diff(tile[order]) != 0)) + 1
        a, b, groups, apart = [], [], [], []
        for run in np.split(order, new):
            run = run[np.append(True, np.diff(node[run]) != 0)]  # a node counts once
            second = bool(fresh[run].any())
            links = walk(alike([data[int(r)].as_py() for r in run]), len(run), fresh[run] if second else None)
            a += [node[run[x]] for x, _ in links]
            b += [node[run[y]] for _, y in links]
            if tiles[run[0]] > 1 and not second:  # the hub is the first
                met = {0}
                for x, y in links:
                    if x in met:
                        met.add(y)
                left = [node[run[k]] for k in range(len(run)) if k not in met]
                groups += [grp[run[0]]] * len(left)
                apart += left
        columns = (a + [None] * len(apart), b + [None] * len(apart), [None] * len(a) + groups, [None] * len(a) + apart)
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b", "grp", "apart"])

    def met(narrow: DataFrame, everywhere: Column) -> DataFrame:
        tile = F.when(everywhere, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
        placed = fetch(narrow).withColumn("tile", F.explode(tile)).withColumn("bucket", F.pmod(F.xxhash64("grp", "tile"), F.lit(buckets)))
        columns = ("bucket", "grp", "tile", "node", "hub", "tiles", "fresh", "data")
        return placed.select(*columns).groupBy("bucket").applyInArrow(connect, schema)

    first = materialise(met(rows.withColumn("fresh", F.lit(False)), F.col("node") == F.col("hub")))
    links = first.filter("a is not null").select("a", "b")
    left = first.filter("apart is not null").select("grp", F.col("apart").alias("node")).distinct().withColumn("_apart", F.lit(True))
    if left.isEmpty():
        return links
    large = rows.filter("tiles > 1").join(left.select("grp").distinct(), "grp", "left_semi")
    again = large.join(left, ["grp", "node"], "left").withColumn("fresh", F.col("_apart").isNotNull()).drop("_apart")
    return links.unionByName(met(again, F.col("fresh")).filter("a is not null").select("a", "b"))


def _alike_signatures(percent: int) -> Callable:
    least = percent / 100 - FLOOR

    def over(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)
        sizes, marks = np.ascontiguousarray(flat[:, :8]).view(np.int64).ravel(), flat[:, 8:]

        def likes(at: int, others: np.ndarray) -> np.ndarray:
            n, m = sizes[at], sizes[others]
            agree = (marks[others] == marks[at]).sum(axis=1)
            return (agree >= least * marks.shape[1]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

        return likes

    return over


def _alike_sets(percent: int) -> Callable:
    def over(data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(raw, dtype=np.uint64) for raw in data]
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes

        def likes(at: int, others: np.ndarray) -> np.ndarray:
            n, m = sizes[at], sizes[others]
            fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            out = np.zeros(len(others), dtype=bool)
            for part in np.array_split(np.flatnonzero(fits), -(-int(m[fits].sum()) // (1 << 20)) or 1):
                if len(part):
                    k = m[part]
                    before = np.cumsum(k) - k
                    grams = flat[np.repeat(starts[others[part]] - before, k) + np.arange(k.sum())]
                    place = np.minimum(np.searchsorted(sets[at], grams), n - 1)
                    common = np.add.reduceat((sets[at][place] == grams).astype(np.int64), before)
                    out[part] = 100 * common >= percent * (n + k - common)
            return out

        return likes

    return over


def _grams(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (``node, doc_id`` and others) with the set of each node as ``data``."""
    names = [c for c in wanted.columns if c != "doc_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.set_column(batch.schema.get_field_index("_packed"), "text", unpacked(batch.column("_packed")))
            for part in slices(texts, limit=_CHUNK_BYTES):
                grams, counts = shingles(part, width)
                ends = np.cumsum(counts)
                # Another text of the same id is another set.
                own = np.flatnonzero(digests(grams, counts)[0] == part.column("node").to_numpy())
                data = pa.array([grams[a:b].tobytes() for a, b in zip((ends - counts)[own], ends[own])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(own)) for c in names], data], [*names, "data"])

    narrow = packed_texts(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null"))
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names)
    # A merge join at every size: what is wanted grows with the documents.
    return narrow.join(wanted.hint("merge"), "doc_id").mapInArrow(gather, f"{kinds}, data binary")


# Operator


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, kept``."""
    signed = materialise(_signed(docs, width))
    sets = signed.filter("n > 0 and doc_id is not null")
    # Equal sets are one; its digest names it.
    distinct = materialise(
        sets.groupBy("n", "k1", "k2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        .withColumnRenamed("k1", "node")
    )
    banded = distinct.select("node", F.explode("bands").alias("grp"))
    shared = banded.groupBy("grp").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    # Narrow rows find who shares a band; signatures follow those only.
    tiles = F.ceil(F.col("size") / TILE_SIGNATURES).cast("int")
    meeting = banded.join(shared, "grp").select("grp", "hub", tiles.alias("tiles"), "node")
    marks = distinct.select("node", F.col("signature").alias("data"))
    links = forest(meeting, lambda rows: rows.join(marks, "node"), _alike_signatures(percent))
    groups = connected_components(links).withColumnRenamed("component", "grp")
    named = distinct.select("node", "doc_id", "n").join(groups, "node")
    tiles = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(8 * F.sum("n") / TILE_BYTES)).cast("int")
    sizes = named.groupBy("grp").agg(tiles.alias("tiles"), F.min("node").alias("hub"))
    wanted = materialise(named.drop("n").join(sizes, "grp"))
    # Texts are shuffled once; what a large group's second meeting needs is read again.
    linked = connected_components(forest(materialise(_grams(docs, wanted, width)), lambda rows: rows, _alike_sets(percent)))
    classed = distinct.select("n", "node", "k2", "doc_id").join(linked, "node", "left").withColumn("_class", F.coalesce("component", "node"))
    least = classed.groupBy("_class").agg(F.min("doc_id").alias("component_id"))
    found = classed.join(least, "_class").select("n", F.col("node").alias("k1"), "k2", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.select("doc_id", "n", "k1", "k2").join(found, ["n", "k1", "k2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
