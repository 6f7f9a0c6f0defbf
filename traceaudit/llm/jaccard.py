"""Exact n-gram Jaccard join: documents whose sets of word n-grams overlap by a share of their union are linked.

1. One pass over the texts makes each document's set digest and a count of all n-grams over a fixed number of slots.
2. A second pass orders each set rare-first by these counts and ships its prefix, the n-grams of which a linked pair
   must share one, packed by bucket. Any order that all documents share keeps the join exact; the slots only decide how
   well frequent n-grams go last. Equal sets are one set: each task ships one of them, each bucket keeps one.
   A large set is parted by its n-grams' hashes into segments. Two linked sets have a segment in which they differ by no
   more than their difference over the number of segments, so each segment ships the prefix that this bound leaves.
   Sizes are classed, a class has four times the segments of the one before; sets near the end of a class are in both.
3. A bucket's task pairs the sets of an n-gram after the length filter, the positional filter (what can still follow
   the shared n-gram) and a bitmap filter (n-grams are dealt to parity bits; every bit that differs is an n-gram that
   only one of the two has). Segments are so small that bits of unrelated ones differ by more than the bound: else all
   long texts that share one rare n-gram would be candidates, and more documents connect them all to a single group.
   It returns no pairs but a spanning forest of them.
4. The sets of each group so connected are brought together once, a large group as pairs of tiles. Pairs that no earlier
   link of the tile connects go through the suffix filter (both sets are parted at a probe n-gram, again and again, and
   the sizes of the parts bound how much the sets differ); what it leaves is compared n-gram by n-gram, each pair once.

Nothing is sampled or capped. An n-gram in very many prefixes is dealt to pairs of tiles as well.

Defined results: null, empty or blank texts have no n-grams and link with nothing; rows without ``doc_id`` take no part
and get a null component; rows that share a ``doc_id`` are one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.components import connected_components
from traceaudit.llm.store import materialise
from traceaudit.llm.texts import (
    hashed_words, mixed, packed_texts, planes, run_starts, slices, unpacked, unplaned, utf8, window_hashes,
)

WIDTH, PERCENT = 3, 90
#: Slots that count n-grams (2 MB when sent to tasks, whatever the corpus), and parts they are summed in.
SLOT_BITS, PARTS = 21, 64
CHUNK_BYTES = 4 << 20
#: Parity bits of a set.
PARITY = 192
#: Sets of which linked ones may differ by more n-grams are parted; bits of unrelated sets differ by half of ``PARITY``.
SEGMENT_DIFFER = 3 * PARITY // 10
#: Below this percentage segments would have to share next to nothing, and no set is parted.
SEGMENT_PERCENT = 70
#: Prefixes of one n-gram, and sets and n-grams of one group, that a task pairs with each other.
TILE_PREFIXES, TILE_SETS, TILE_GRAMS = 4096, 512, 2 << 20
#: Prefix entries that a task ships at once, and that a bucket has on average at most.
SHIPPED, BUCKET_ENTRIES = 1 << 18, 1 << 18
_PAIRS_AT_ONCE = 1 << 20
#: How often the suffix filter parts two sets.
SUFFIX_DEPTH = 3


# Sets of a batch


def shingle_sets(batch: pa.RecordBatch, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, document after document and ascending in each, and how many each document has."""
    words, counts = hashed_words(batch, lower=True)
    before = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    grams = window_hashes(words, width)[run_starts(counts, width)]
    for few in range(1, width):  # a text of fewer words is one n-gram
        short = np.flatnonzero(counts == few)
        if len(short):
            doc = np.append(doc, short)
            grams = np.append(grams, mixed(window_hashes(words, few)[before[short]] + np.uint64(few)))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(doc[new], minlength=len(counts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def set_keys(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    return _sums(mixed(grams), counts), _sums(mixed(grams ^ np.uint64(0x5DEECE66D1234567)), counts)


def parity(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity bits of each set, as rows of 64-bit numbers."""
    bit = ((grams >> np.uint64(40)) % np.uint64(PARITY)).astype(np.int64)
    cells = np.repeat(np.arange(len(counts)), counts) * PARITY + bit
    odd = (np.bincount(cells, minlength=len(counts) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(len(counts), PARITY // 64)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


# Filters


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of n and m entries: percent of the union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def segment_limits(percent: int) -> np.ndarray:
    """Size of the largest set of each class; a pair is compared in ``4**class`` segments, by the class of its larger set."""
    if percent < SEGMENT_PERCENT:
        return np.array([np.iinfo(np.int64).max])
    return SEGMENT_DIFFER * (100 + percent) // (2 * max(100 - percent, 1)) * 4 ** np.arange(16)


def segment_prefix_lengths(n: np.ndarray, kind: int, limits: np.ndarray, percent: int) -> np.ndarray:
    """N-grams of each segment of which a linked set of class ``kind`` at most has one, in some segment."""
    if not kind:
        return prefix_lengths(n, percent)
    largest = np.minimum(100 * n // percent, limits[kind])
    return (100 - percent) * (n + largest) // (100 + percent) // 4**kind + 1


def prefix_entries(grams, counts, level, shown, percent: int) -> tuple[np.ndarray, ...]:
    """Prefixes of the sets that are ``shown``: per entry ``doc, key, level, class, place, cell``; per cell ``size, bits``.

    A cell is a segment of a set, ``size`` its n-grams, ``bits`` their parity. Keys tell classes apart. A segment that
    is no larger than what it may differ by has another entry, at place -1, where it meets all such segments.
    """
    limits = segment_limits(percent)
    low, high = np.searchsorted(limits, counts), np.searchsorted(limits, 100 * counts // percent)
    doc = np.repeat(np.arange(len(counts)), counts)
    found: list[list[np.ndarray]] = [[] for _ in range(8)]
    cells = 0
    for kind in range(int(high[shown].max()) + 1 if shown.any() else 0):
        parts = 4**kind
        own = np.flatnonzero(shown & (low <= kind) & (kind <= high))
        number = np.full(len(counts), -1)
        number[own] = np.arange(len(own))
        rows = np.flatnonzero(number[doc] >= 0)
        cell = number[doc[rows]] * parts + (grams[rows] & np.uint64(parts - 1)).astype(np.int64)
        order = np.lexsort((grams[rows], level[rows], cell))
        rows, cell = rows[order], cell[order]
        size = np.bincount(cell, minlength=len(own) * parts)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
        length = np.repeat(segment_prefix_lengths(counts[own], kind, limits, percent), parts)
        use = place < length[cell]
        few = np.flatnonzero(size < length)
        key = grams[rows[use]] if not kind else mixed(grams[rows[use]] + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))
        alone = mixed((few % parts).astype(np.uint64) ^ np.uint64(kind * 0xD6E8FEB86659FD93 % (1 << 64)))
        at = np.append(cell[use], few)
        new = (
            own[at // parts], np.append(key, alone), np.append(level[rows[use]], np.zeros(len(few), dtype=level.dtype)),
            np.full(len(at), kind), np.append(place[use], np.full(len(few), -1)), cells + at, size, parity(grams[rows], size),
        )
        for column, x in zip(found, new):
            column.append(x)
        cells += len(size)
    if not cells:
        empty = np.zeros(0, dtype=np.int64)
        return empty, np.zeros(0, dtype=np.uint64), level[:0], empty, empty, empty, empty, np.zeros((0, PARITY // 64), dtype=np.uint64)
    return tuple(map(np.concatenate, found))


class Forest:
    """Least node of each tree, while edges come in by the million."""

    def __init__(self, nodes: int) -> None:
        self.root = np.arange(nodes)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def candidate_pairs(run, n, size, place, bits, parts, percent: int, tile=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within runs of equal ``run``, sorted by run and ``n``, that pass the filters.

    ``n`` is the size of a set, ``size`` that of the segment at hand, one of ``parts``, and ``place`` is in its prefix.
    """
    alive, step = np.arange(len(run)), 0
    left = size - place - 1
    while True:
        step += 1
        alive = alive[alive + step < len(run)]
        alive = alive[(run[alive] == run[alive + step]) & (100 * n[alive] >= percent * n[alive + step])]
        if not len(alive):
            return
        for at in range(0, len(alive), _PAIRS_AT_ONCE):
            i = alive[at : at + _PAIRS_AT_ONCE]
            j = i + step
            if tile is not None:  # other tile, or the pair belongs to another task
                i, j = i[tile[i] != tile[j]], j[tile[i] != tile[j]]
            most = (n[i] + n[j] - 2 * needed(n[i], n[j], percent)) // parts[i]
            ok = 2 + 2 * np.minimum(left[i], left[j]) >= size[i] + size[j] - most
            i, j, most = i[ok], j[ok], most[ok]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = differ <= most
            yield i[ok], j[ok]


# Steps


def _base(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (``n``, ``k1``, ``k2``) and of slot counts (``part``, ``counts``), from one pass."""
    schema = "doc_id bigint, n int, k1 bigint, k2 bigint, part int, counts binary"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                grams, counts = shingle_sets(part, width)
                slots += np.bincount(_slot(grams), minlength=len(slots)).astype(np.uint32)
                k1, k2 = set_keys(grams, counts)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names,
                )
        tool = zstandard.ZstdCompressor(level=1)
        out = [tool.compress(p.tobytes()) for p in np.split(slots, PARTS)]
        nulls = [pa.nulls(PARTS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(PARTS), pa.int32()), pa.array(out, pa.binary())], names)

    return materialise(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(digest, schema))


def _levels(base: DataFrame) -> tuple[np.ndarray, float, float]:
    """Count of each slot as eighths of its logarithm; what a slot counts beside a frequent n-gram; all counts."""

    def add(table: pa.Table) -> pa.Table:
        tool = zstandard.ZstdDecompressor()
        total = np.zeros((1 << SLOT_BITS) // PARTS, dtype=np.uint64)
        for raw in table.column("counts"):
            total += np.frombuffer(tool.decompress(raw.as_py()), dtype=np.uint32)
        level = np.minimum(np.floor(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "level": pa.array([level.tobytes()]), "n": pa.array([float(total.sum())])})

    found = base.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, level binary, n double").collect()
    levels = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    size = len(levels) // PARTS
    for row in found:  # as many rows as there are parts
        levels[row.part * size : (row.part + 1) * size] = np.frombuffer(row.level, dtype=np.uint8)
    total = sum(row.n for row in found)
    mean = total / len(levels)
    return levels, mean + 6 * mean**0.5, total


def _candidates(docs: DataFrame, levels: np.ndarray, noise: float, total: float, width: int, percent: int) -> DataFrame:
    """Forest over the pairs that pass the filters: ``a``, ``b``; ``total``: n-grams of all sets."""
    # By partitions, so that all have some, and by entries, so that a bucket stays small.
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - percent) / 100 / BUCKET_ENTRIES))
    tiles_of_level = np.maximum(1, np.ceil((2.0 ** ((np.arange(256) + 1) / 8) - noise) / TILE_PREFIXES)).astype(np.int64)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                grams, counts = shingle_sets(part, width)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                k1, k2 = set_keys(grams, counts)
                order = np.lexsort((ids, k2, k1, counts))
                own = np.ones(len(order), dtype=bool)
                own[1:] = (np.diff(counts[order]) != 0) | (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
                shown = np.zeros(len(order), dtype=bool)
                shown[order[own]] = True
                shown &= counts > 0
                owner, keys, level, kinds, places, cells, sizes, bits = prefix_entries(grams, counts, levels[_slot(grams)], shown, percent)
                every = tiles_of_level[level]
                ends = np.cumsum(every)
                cuts = np.searchsorted(ends, np.arange(SHIPPED, int(ends[-1]) if len(ends) else 0, SHIPPED))
                for rows in np.split(np.arange(len(owner)), np.unique(cuts)):
                    # A frequent n-gram: its prefixes are dealt to tiles, and each meets all tiles.
                    tiles = every[rows]
                    again = np.repeat(np.arange(len(rows)), tiles)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                    rows, tiles = rows[again], tiles[again]
                    doc, key = owner[rows], keys[rows]
                    tile = (k1[doc] % tiles.astype(np.uint64)).astype(np.int64)
                    low, high = np.minimum(tile, other), np.maximum(tile, other)
                    key = np.where(tiles > 1, mixed(key + (low * 65521 + high).astype(np.uint64)), key)
                    tile = np.where(low == high, -1, tile)  # -1: pairs within a tile
                    key = mixed(key)
                    bucket = (key % np.uint64(buckets)).astype(np.int64)
                    # Half of a key tells those of a bucket apart; where it fails, more pairs go through the filters.
                    key = (key >> np.uint64(32)).astype(np.uint32)
                    order = np.argsort(bucket, kind="stable")
                    out = []
                    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                        d, c = doc[at], cells[rows[at]]
                        numbers = (counts[d], sizes[c], places[rows[at]], tile[at])
                        out.append((
                            int(bucket[at[0]]), len(at), k1[d].tobytes() + bits[c].tobytes() + key[at].tobytes(),
                            planes(np.diff(ids[d], prepend=np.int64(0)), *(x.astype(np.int32) for x in numbers), kinds[rows[at]].astype(np.int8)),
                        ))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["bucket", "n", "wide", "narrow"],
                    )

    def pair(table: pa.Table) -> pa.Table:
        cells: list[list[np.ndarray]] = [[] for _ in range(9)]
        for n, wide, narrow in zip(*(table.column(c).to_pylist() for c in ("n", "wide", "narrow"))):
            raw = np.frombuffer(wide, dtype=np.uint64, count=n * (1 + PARITY // 64))
            key = np.frombuffer(wide, dtype=np.uint32, offset=raw.nbytes)
            ids, counts, size, place, tile, kind = unplaned(narrow, n, "i8", "i4", "i4", "i4", "i4", "i1")
            new = (key, raw[:n], raw[n:].reshape(n, PARITY // 64), np.cumsum(ids), counts, size, place, tile, kind)
            for cell, x in zip(cells, new):
                cell.append(x)
        key, k1, bits, ids, counts, size, place, tile, kind = map(np.concatenate, cells)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        crowded = np.zeros(len(key), dtype=bool)
        crowded[:-1] |= same
        crowded[1:] |= same
        rows = order[crowded]  # n-grams of more than one prefix
        rows = rows[np.lexsort((ids[rows], place[rows], *bits[rows].T, k1[rows], counts[rows], key[rows]))]
        if len(rows):  # equal sets: the smallest document stands for all
            first = np.ones(len(rows), dtype=bool)
            a, b = rows[1:], rows[:-1]
            first[1:] = (key[a] != key[b]) | (k1[a] != k1[b]) | (counts[a] != counts[b]) | (place[a] != place[b])
            first[1:] |= (bits[a] != bits[b]).any(axis=1)
            rows = rows[first]
        key, bits, ids, tile = (x[rows] for x in (key, bits, ids, tile))
        counts, size, place, parts = (x[rows].astype(np.int64) for x in (counts, size, place, kind))
        parts = 4**parts
        nodes, node = np.unique(ids, return_inverse=True)
        forest = Forest(len(nodes))
        inner = tile < 0
        for met in (inner, ~inner):
            at = np.flatnonzero(met)
            pairs = candidate_pairs(*(x[at] for x in (key, counts, size, place, bits, parts)), percent, None if met is inner else tile[at])
            for i, j in pairs:
                forest.join(node[at[i]], node[at[j]])
        moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return pa.table({"a": nodes[forest.root[moved]], "b": nodes[moved]})

    known = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null")
    shipped = known.mapInArrow(ship, "bucket int, n int, wide binary, narrow binary")
    return shipped.groupBy("bucket").applyInArrow(pair, "a bigint, b bigint")


def tiled_sets(part: pa.RecordBatch, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sets of texts (``doc_id, text, component, tiles``), each once for every tile that it meets, in batches of bounded size."""
    names = ["bucket", "group", "low", "high", "tile", "doc_id", "grams"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    grams, counts = shingle_sets(part, width)
    ends = np.cumsum(counts)
    out, held = [], 0
    for doc, group, tiles, a, b in zip(*(part.column(c).to_pylist() for c in ("doc_id", "component", "tiles")), ends - counts, ends):
        own = int(mixed(np.array([doc], dtype=np.int64).view(np.uint64))[0]) % tiles
        raw = grams[a:b].tobytes()
        for other in range(tiles):
            task = (group, min(own, other), max(own, other))
            code = int(mixed(np.array([group * 1_000_003 + task[1] * 65_521 + task[2]], dtype=np.int64).view(np.uint64))[0])
            out.append((code % buckets, *task, own, doc, raw))
            held += len(raw)
            if held >= CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)


def _verified(docs: DataFrame, base: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Forest over the linked pairs of each group (``node``, ``component``): ``a``, ``b``; ``base`` has the sizes of sets."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, "_packed", CHUNK_BYTES // 4):
                texts = few.set_column(few.schema.get_field_index("_packed"), "text", unpacked(few.column("_packed")))
                for part in slices(texts, limit=CHUNK_BYTES):
                    yield from tiled_sets(part, width, buckets)

    def compare(table: pa.Table) -> pa.Table:
        group, low, high, tile, ids = (table.column(c).to_numpy() for c in ("group", "low", "high", "tile", "doc_id"))
        bounds, raw = utf8(table.column("grams").combine_chunks())
        a, b = [], []
        order = np.lexsort((ids, high, low, group))
        new = (np.diff(group[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        for rows in np.split(order, np.flatnonzero(new) + 1):
            sets = [raw[bounds[r] : bounds[r + 1]].view(np.uint64) for r in rows]
            for i, j in linked_forest(sets, ids[rows], None if low[rows[0]] == high[rows[0]] else tile[rows], percent):
                a.append(ids[rows[i]])
                b.append(ids[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = base.filter("part is null and doc_id is not null").select(F.col("doc_id").alias("node"), "n")
    tiles = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_GRAMS)).cast("int")
    sizes = groups.join(sets, "node").groupBy("component").agg(tiles.alias("tiles"))
    members = groups.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "tiles")
    narrow = packed_texts(docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null"))
    schema = "bucket int, group bigint, low int, high int, tile int, doc_id bigint, grams binary"
    # A merge join at every size: members may well be few enough to send around, but grow with the documents.
    return narrow.join(members.hint("merge"), "doc_id").mapInArrow(gather, schema).groupBy("bucket").applyInArrow(compare, "a bigint, b bigint")


def hamming_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = SUFFIX_DEPTH) -> int:
    """At least so many entries of two ascending sets are in one of them only; exact, or above ``most``, or a lower bound.

    The middle entry of one set is the probe: it parts both sets, entries of a left part equal none of a right part, and
    the difference in size of each side is a bound of its own. While a level's bounds leave the pair open, each side is
    parted again with what the other side leaves of ``most``.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    met = at < len(x) and x[at] == y[middle]
    left, right = (x[:at], y[:middle]), (x[at + met :], y[middle + 1 :])
    sides = [abs(len(a) - len(b)) for a, b in (left, right)]
    alone = int(not met)
    if sum(sides) + alone > most:
        return sum(sides) + alone
    first = hamming_bound(*left, most - sides[1] - alone, depth - 1)
    if first + sides[1] + alone > most:
        return first + sides[1] + alone
    return first + hamming_bound(*right, most - first - alone, depth - 1) + alone


def linked_forest(sets: list[np.ndarray], ids: np.ndarray, tile: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sorted sets that connect all that are connected; with ``tile``, links between tiles."""
    n = np.array([len(s) for s in sets])
    bits = np.concatenate([parity(s, n[k : k + 1]) for k, s in enumerate(sets)])
    order = np.argsort(n, kind="stable")
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = None if tile is None else tile[order]
    same, whole = np.zeros(len(sets), dtype=np.int64), np.ones(len(sets), dtype=np.int64)
    # Each set against all larger ones, the most alike first; those that are connected by then need no comparison.
    for i, j in candidate_pairs(same, n[order], n[order], np.zeros_like(n), bits[order], whole, percent, kept):
        for x, y in zip(order[i].tolist(), order[j].tolist()):
            if ids[x] != ids[y] and (tx := top(x)) != (ty := top(y)):
                small, large = (sets[x], sets[y]) if n[x] <= n[y] else (sets[y], sets[x])
                most = int(n[x] + n[y] - 2 * needed(n[x], n[y], percent))
                if hamming_bound(small, large, most) > most:
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if int((large[at] == small).sum()) >= needed(n[x], n[y], percent):
                    root[max(tx, ty)] = min(tx, ty)
                    yield x, y


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    base = _base(docs, width)
    levels, noise, total = _levels(base)
    groups = connected_components(_candidates(docs, levels, noise, total, width, percent))
    links = connected_components(_verified(docs, base, groups, width, percent))
    rows = base.filter("part is null").select("doc_id", "n", "k1", "k2")
    # Equal sets link too: the least document of each set stands for it.
    sets = rows.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"))
    named = sets.join(links, "node", "left").select("n", "k1", "k2", F.coalesce("component", "node").alias("_component"))
    return rows.join(named, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest ``doc_id``; rows without one stay.

    Of rows that share a ``doc_id`` one of the smallest text hash stays; hashes are compared in sums, texts are moved once.
    Columns keep their names, whatever these are.
    """
    given = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    tie = F.xxhash64("text")
    rows = docs.select(*given, F.col("doc_id").alias("_id"), tie.alias("_tie"), F.col("text").alias("_text"))
    leaders = near_duplicates(docs, width, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    # A row per id, from sums that combine before they are shuffled.
    ties = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(tie).alias("_tie"), F.count("*").alias("_n"))
    kept = rows.filter("_id is not null").join(leaders.join(ties, "_id"), ["_id", "_tie"])
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    # Rows of one id and text: one of them, chosen before they are moved.
    every = kept.filter("_n = 1").unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_tie"]))
    return every.select(back).unionByName(rows.filter("_id is null").select(back))
