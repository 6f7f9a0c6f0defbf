"""Query pools larger than a task: one JSON document, read by as many tasks as it has splits.

A JSON document has no place where a reader may start, but two facts tell where one is. Counting unescaped quotes from
the start of the file says whether a place is inside a string; counting brackets outside strings says how deep it is.
Both are sums, so each split counts on its own, and sums over the earlier splits give each its start:

1. The file is read as pieces between closing braces, at any split. Each split counts its quotes, and its change of
   depth for either case, starting inside a string or outside.
2. With its start known, each split cuts its text at commas and brackets of the first two levels. Records begin and end
   there, whatever brackets, quotes and commas their texts hold.
3. What the edge of a split cuts in two is put together; all else is a whole record and is parsed where it is.

Nothing is larger than a record, except a ``meta`` object, which is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceaudit.functions.text import strip
from traceaudit.operators import rules
from traceaudit.operators.transcripts import pool_id, pool_text, variant_fields
from traceaudit.session import materialise
from traceaudit.sources.pools import WRAPPERS, pool_violations

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_CHANGE = np.zeros(256, dtype=np.int64)
_CHANGE[[ord("{"), ord("[")]] = 1
_CHANGE[[ord("}"), ord("]")]] = -1
_STRUCTURE = _CHANGE != 0
_STRUCTURE[ord(",")] = True
#: Kinds of pieces: text of the first level, text below it, and the totals of a split.
HEAD, CONTENT, TOTALS = range(3)


def real_quotes(data: np.ndarray) -> np.ndarray:
    """Places of quotes that an even number of backslashes precedes; ``data`` must not start behind a backslash."""
    quotes = np.flatnonzero(data == _QUOTE)
    if not len(quotes) or not (data == _ESCAPE).any():
        return quotes
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != _ESCAPE, place, -1))
    before = quotes - 1
    run = np.where(before >= 0, before - other[np.maximum(before, 0)], 0)
    return quotes[run % 2 == 0]


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets and commas outside strings, the change of depth at each, and whether a string is open at the end."""
    quotes = real_quotes(data)
    places = np.flatnonzero(_STRUCTURE[data])
    outside = (int(inside) + np.searchsorted(quotes, places)) % 2 == 0
    places = places[outside]
    return places, _CHANGE[data[places]], bool((int(inside) + len(quotes)) % 2)


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text between closing braces with file, split and row, which sort like the file."""
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(paths)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that lie in one split of one file."""
    for batch in batches:
        ids = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            yield ids[a], batch.slice(a, b - a)


def _bytes(part: pa.RecordBatch) -> bytes:
    # Behind the last piece of a file there may be no brace: it is read at depth 0, where it means nothing.
    return "}".join([*part.column("piece").to_pylist(), ""]).encode()


def _split_starts(pieces: DataFrame) -> DataFrame:
    """``file, block, inside, depth``: the state in which each split begins. Lists begin one deeper, as if in an object."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), part in _runs(batches):
            raw = _bytes(part)
            data = np.frombuffer(raw, dtype=np.uint8)
            outside, within = (structure(data, inside) for inside in (False, True))
            columns = [[file], [block], [part.column("row")[0].as_py()], [int(outside[2])], [int(outside[1].sum())], [int(within[1].sum())], [raw.lstrip()[:1].decode(errors="replace")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["file", "block", "row", "quotes", "outside", "within", "top"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    counted = materialise(
        pieces.mapInArrow(count, "file string, block bigint, row bigint, quotes bigint, outside bigint, within bigint, top string")
    )
    # A row per batch of pieces, not per piece: few enough for one window per file.
    in_file = Window.partitionBy("file").orderBy("block", "row")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    stated = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    deep = stated.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    is_list = (F.first("top").over(in_file.rowsBetween(Window.unboundedPreceding, 0)) == "[").cast("bigint")
    first = Window.partitionBy("file", "block").orderBy("row")
    return materialise(
        deep.withColumn("depth", F.col("depth") + is_list).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        .select("file", "block", "inside", "depth")
    )


_CUT_SCHEMA = "file string, block bigint, kind int, cut bigint, member bigint, element bigint, whole boolean, opener string, text string"


def _cut(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Texts between commas and brackets of the first two levels, numbered within their split.

    ``cut`` counts the cuts before, ``member`` the commas of the first level, ``element`` those of the second and the
    brackets that open it; ``opener`` is such a bracket behind a text of the first level. ``whole`` is false at the edges
    of a split.
    """
    names = [c.split()[0] for c in _CUT_SCHEMA.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        inside, depth, held, cuts, member, element = False, 0, [], 0, 0, 0

        def close() -> None:
            text = b"".join(held).decode()
            if depth >= 1:
                rows.append((*key, HEAD if depth == 1 else CONTENT, cuts, member, element, False, None, text))
            rows.append((*key, TOTALS, cuts, member, element, True, None, None))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for where, part in _runs(batches):
            if where != key:
                if key is not None:
                    close()
                key, held, cuts, member, element = where, [], 0, 0, 0
                inside, depth = part.column("inside")[0].as_py(), part.column("depth")[0].as_py()
            raw = _bytes(part)
            data = np.frombuffer(raw, dtype=np.uint8)
            places, change, inside_after = structure(data, inside)
            after = depth + np.cumsum(change)
            before = after - change
            # Commas at a level, and brackets into or out of it.
            ends = np.where(change == 0, (after == 1) | (after == 2), ((after <= 2) & (before <= 2) & (after >= 0) & (before >= 0)))
            at = 0
            for k in np.flatnonzero(ends).tolist():
                place, level, level_after = int(places[k]), int(before[k]), int(after[k])
                opens = level == 1 and level_after == 2
                if level >= 1:
                    held.append(raw[at:place])
                    text, first = b"".join(held).decode(), cuts == 0
                    opener = chr(raw[place]) if opens else None
                    # An opener's element is the first below it.
                    rows.append((*key, HEAD if level == 1 else CONTENT, cuts, member, element + opens, not first, opener, text))
                held, at, cuts = [], place + 1, cuts + 1
                member += level == 1 and level_after == 1
                element += opens or (level == 2 and level_after == 2)
            held.append(raw[at:])
            depth, inside = int(after[-1]) if len(after) else depth, inside_after
            if len(rows) >= 2000:
                yield batch_of()
        if key is not None:
            close()
        if rows:
            yield batch_of()

    stated = pieces.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row")
    return stated.mapInArrow(cut, _CUT_SCHEMA)


def _numbered(found: DataFrame) -> DataFrame:
    """Whole texts with numbers that count from the start of the file."""
    counts = ("cut", "member", "element")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.filter(F.col("kind") == TOTALS).select(
        "file", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in counts]
    )
    texts = found.filter(F.col("kind") != TOTALS).join(offsets, ["file", "block"])
    placed = texts.withColumns({c: F.col(c) + F.col(f"_{c}") for c in counts}).drop(*[f"_{c}" for c in counts])
    # Parts of one text lie in splits that follow each other.
    parts = placed.filter(~F.col("whole")).groupBy("file", "cut").agg(
        *[F.max_by(c, "block").alias(c) for c in ("kind", "member", "element", "opener")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    columns = ("file", "kind", "member", "element", "opener", "text")
    return placed.filter("whole").select(*columns).unionByName(parts.select(*columns))


def read_large_pool(spark: SparkSession, paths: str | Sequence[str], unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Like ``pools.read_pool``, for documents of any size: pool rows and one metadata row per file.

    A document is a list of records, or an object with such a list. A record that is no valid JSON raises an error.
    """
    pieces = _pieces(spark, paths)
    texts = _numbered(materialise(_cut(pieces, _split_starts(pieces))))
    heads = texts.filter(F.col("kind") == HEAD).withColumn("key", F.regexp_extract("text", r'^\s*"((?:[^"\\]|\\.)*)"\s*:', 1))
    rank = F.array_position(F.array(F.lit(""), *[F.lit(k) for k in WRAPPERS]), F.col("key"))
    lists = heads.filter((F.col("opener") == "[") & (rank > 0))
    chosen = materialise(
        lists.groupBy("file").agg(F.min_by(F.struct("member", F.col("element").alias("first")), F.struct(rank, "member")).alias("c"))
        .select("file", "c.member", "c.first")
    )
    records = texts.filter((F.col("kind") == CONTENT) & (strip("text") != "")).join(chosen, ["file", "member"])
    rows = records.select(
        F.col("file").alias("path"), (F.col("element") - F.col("first")).cast("int").alias("position"), F.parse_json("text").alias("raw")
    )
    get = variant_fields("raw")
    named = rows.select("path", "position", pool_id(get, "position").alias("prompt_id"), pool_text(get).alias("prompt_text"), "raw")
    if unique:
        rules.enforce(pool_violations(named), "query pool")
    return named, _meta(texts, heads)


def _meta(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """``path, meta`` of each file, null without one."""
    own = heads.filter("key = 'meta'").select("file", "member", "opener", F.regexp_replace("text", r'^\s*"meta"\s*:', "").alias("scalar"))
    inner = texts.filter(F.col("kind") == CONTENT).join(own.select("file", "member"), ["file", "member"], "left_semi")
    joined = inner.groupBy("file", "member").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "text"))), lambda x: x["text"]), ",").alias("inner")
    )
    closer = F.when(F.col("opener") == "{", "}").otherwise("]")
    text = F.when(F.col("opener").isNull(), F.col("scalar")).otherwise(F.concat("opener", F.coalesce("inner", F.lit("")), closer))
    found = own.join(joined, ["file", "member"], "left").select("file", F.parse_json(text).alias("meta"))
    files = heads.select("file").distinct()
    return files.join(found, "file", "left").select(F.col("file").alias("path"), "meta")


def write_large_pool(records: DataFrame, path: str, meta: str = "{}") -> None:
    """One pool document per task: ``records`` has a column ``record``, a JSON text; ``meta`` is a JSON text."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [f'{{"meta": {meta}, "queries": [']})
        first = True
        for batch in batches:
            lines = [r for r in batch.column("record").to_pylist() if r is not None]
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [lines[0] if first else "," + lines[0], *["," + r for r in lines[1:]]]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    records.select("record").mapInArrow(document, "value string").write.text(path)
