"""JSON-lines sources: strict and tolerant scans with violations as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.functions.text import strip
from traceaudit.operators import rules


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with file, block and row, which sort like the lines of the files.

    Records end at the line feed only: U+0085, U+2028 and U+2029 stay inside
    their line. A block is one split of a file; rows of a split are read in
    order by one task, so (file, block, row) is the file order at any size.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def number_lines(lines: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Add the 1-based line number inside the file; ``every`` has all lines if ``lines`` are some of them.

    Rows of a block are consecutive, so only one small row per block (its first
    row and its length) is shuffled; these go to the lines, which stay where they are.
    """
    blocks = (lines if every is None else every).groupBy("file", "block").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    joined = lines.join(F.broadcast(offsets), ["file", "block"])
    return joined.withColumn("line_no", F.col("_before") + F.col("row") - F.col("_first") + 1).drop("_first", "_before")


def read_jsonl(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType | None = None,
    strict: bool = True,
    allow_nan: bool = True,
    numbered: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines table and the lines that are not valid objects.

    With a schema, fields become typed columns and a value of the wrong type
    (a boolean in a number field, say) breaks its line. Without one, each row
    is a VARIANT column ``raw`` (which never admits NaN). Blank lines are
    skipped. Broken lines carry their number; good rows do if ``numbered``,
    which takes a second look at the file for the lengths of its blocks. ``strict=False`` drops broken lines silently, as a resume scan
    does; the violations are returned either way.
    """
    every = read_lines(spark, paths)
    lines = (number_lines(every) if numbered else every).withColumn("line", strip("line")).filter("line <> ''")
    is_object = F.col("line").startswith("{")
    if schema is None:
        parsed = lines.withColumn("raw", F.try_parse_json("line"))
        good = is_object & F.col("raw").isNotNull()
        fields = ["raw"]
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        with_corrupt = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
        options = {
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_corrupt",
            "allowNonNumericNumbers": str(allow_nan).lower(),
        }
        parsed = lines.withColumn("_r", F.from_json("line", with_corrupt, options))
        good = is_object & F.col("_r._corrupt").isNull()
        fields = [f"_r.{f.name}" for f in wanted.fields]
    place = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    bad = parsed.filter(~F.coalesce(good, F.lit(False)))
    broken = (bad if numbered else number_lines(bad, every)).select(
        F.when(is_object, "not_valid_json").otherwise("not_an_object").alias("rule"),
        place.alias("row_key"),
        F.col("line").alias("detail"),
    )
    rows = parsed.filter(good).select("file", *(["line_no"] if numbered else []), *fields)
    if strict:
        rules.enforce(broken, "invalid JSON lines")
    return rows, broken


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
