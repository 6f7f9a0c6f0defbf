"""Query pools: a JSON document with metadata and records, or a plain list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.functions.text import fold_key
from traceaudit.operators import rules
from traceaudit.operators.transcripts import pool_id, pool_text, variant_fields

WRAPPERS = ("data", "queries", "records", "items")  # fixed values: record list keys, in order


def read_documents(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Whole JSON documents as VARIANT with their path and modification time."""
    reader = spark.read.option("singleVariantColumn", "raw").option("multiLine", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(paths).select(
        "raw",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )


def read_pool(spark: SparkSession, paths: str | list[str], unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pool rows ``(path, position, prompt_id, prompt_text, raw)`` and one metadata row per file.

    A JSON list at the top level is read element by element by Spark's JSON
    source, so its elements arrive as separate documents of the same path.
    ``unique`` refuses repeated ids and prompts that differ only in case or blanks.
    """
    documents = read_documents(spark, paths)
    lists = [F.try_variant_get("raw", f"$.{k}", "array<variant>") for k in WRAPPERS]
    wrapped = F.coalesce(*lists)
    is_list = F.schema_of_variant("raw").startswith("ARRAY")
    records = F.when(is_list, F.try_variant_get("raw", "$", "array<variant>")).otherwise(wrapped)
    rows = documents.select("path", F.posexplode(records).alias("position", "raw"))
    get = variant_fields("raw")
    named = rows.select("path", "position", pool_id(get, "position").alias("prompt_id"), pool_text(get).alias("prompt_text"), "raw")
    if unique:
        rules.enforce(pool_violations(named), "query pool")
    meta = documents.select("path", F.try_variant_get("raw", "$.meta", "variant").alias("meta"))
    return named, meta


def pool_violations(pool: DataFrame) -> DataFrame:
    keyed = pool.withColumn("prompt_key", F.sha2(fold_key("prompt_text"), 256))
    return rules.all_violations(
        [
            rules.row_rules(pool, "prompt_id", [("empty_prompt", F.coalesce(F.length("prompt_text"), F.lit(0)) == 0)]),
            rules.duplicate_rule(keyed, ["path", "prompt_id"], "duplicate_id"),
            rules.duplicate_rule(keyed, ["path", "prompt_key"], "duplicate_prompt"),
        ]
    )
