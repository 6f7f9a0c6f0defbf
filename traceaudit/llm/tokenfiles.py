"""Token ids of documents in Parquet files, in ascending order of the documents.

Row: ``doc_id``, ``ids`` (a list of ints, the end id last) and ``n_tokens``. Integers are dictionary-encoded, or packed
as deltas where a dictionary grows too large; row groups and pages have set sizes and page indexes, so a reader gets
the lengths without the ids, and a few documents without the others.

Texts of any length are encoded whole; an empty table gives files without rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceaudit.llm.texts import slices, utf8
from traceaudit.llm.tokenizer import encoder

#: Bytes of a row group, of a page, and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 20, 20_000
SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, escape_special: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` with the end id, ``n_tokens``; a null text is empty. Keeps order and partitions.

    The string of a special token in a text is that token, as in a plain call of the library, unless ``escape_special``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path, escape_special)
        for batch in batches:
            for part in slices(batch):
                found, sizes = bpe.encode_texts(*utf8(part.column("text")))
                ids = np.insert(found.view("<i4"), np.cumsum(sizes), end_id)
                bounds = np.append(0, np.cumsum(sizes + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes + 1)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, escape_special: bool = False) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``), one file per range of ``doc_id``.

    Texts, which are smaller than their ids, go through the one shuffle. Ranges also cut by a hash of the text, so a
    repeated doc_id fills no task; rows of one doc_id stand in the order of that hash and the text, null ids first.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = hashed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    (
        encode_documents(ordered, tokenizer_path, end_id, escape_special)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows, with ``file`` and ``row``: the file's place among the files and the row's place in it."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint") * 1_000_000 + F.coalesce(
        F.regexp_extract(name, r"-c(\d+)", 1).try_cast("bigint"), F.lit(0)
    )
    return rows.select("*", number.alias("file"), F.col("_metadata.row_index").alias("row"))


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, all from the files.

    Ids before a file come from the lengths alone, which is a read of one narrow column; ids before a row of the file
    from a running sum in the file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            bounds = ids.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("file"), batch.column("row"),
                    pa.array(np.diff(bounds) // 4), pa.array(crcs, type=pa.int64()),
                ],
                ["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    found = read_token_files(spark, path)
    rows = found.select("doc_id", "ids", "file", "row").mapInArrow(
        digest, "doc_id bigint, file bigint, row bigint, n_tokens bigint, ids_crc32 bigint"
    )
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        found.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
        .select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(files, "file")
        .withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )
