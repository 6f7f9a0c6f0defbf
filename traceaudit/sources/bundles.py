"""Transcript bundles: partitioned records plus a one-row manifest with their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.functions.hashing import ordered_hash, stable_hash
from traceaudit.operators import rules
from traceaudit.operators.transcripts import ledger

SCHEMA_VERSION = "stage1_transcript_v1"  # fixed value
IDENTITY = ("prompt_pool_id", "prompt_pool_hash", "prompt_ordering_hash", "teacher_model_id", "decode_config", "seed")


def bundle_id(identity: dict) -> str:
    """Content address of a bundle: hash of its identity and schema version."""
    named = {k: identity[k] for k in IDENTITY}
    return stable_hash({**named, "schema_version": SCHEMA_VERSION})[:24]


def record_hash(records: DataFrame) -> DataFrame:
    return ordered_hash(records, "order_index", ["order_index", "prompt_id", "prompt_text", "teacher_response", "query_id", "query_status"])


def save_bundle(records: DataFrame, attempts: DataFrame, root: str, identity: dict, budget: int, created_at: str) -> str:
    """Write records, attempts and manifest of a bundle; returns its id."""
    spark = records.sparkSession
    ident = bundle_id(identity)
    base = f"{root}/bundle_id={ident}"
    records.write.mode("overwrite").parquet(f"{base}/records")
    attempts.write.mode("overwrite").parquet(f"{base}/attempts")
    stored = spark.read.parquet(f"{base}/records")
    counts = ledger(spark.read.parquet(f"{base}/attempts"))
    text = {k: v if isinstance(v, (str, int)) else stable_hash(v) for k, v in identity.items()}
    manifest = record_hash(stored).select(
        F.lit(ident).alias("bundle_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *[F.lit(text[k]).alias(k) for k in IDENTITY],
        F.col("ordering_hash").alias("transcript_hash"),
        F.lit(budget).alias("requested_budget"),
        F.lit(created_at).alias("created_at"),
    )
    counted = manifest.withColumn("c", counts.select(F.struct(*counts.columns)).scalar()).select(*manifest.columns, "c.*")
    counted.write.mode("overwrite").json(f"{base}/manifest")
    return ident


def load_bundle(spark: SparkSession, root: str, ident: str, expected: dict | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (optionally a budget prefix) and manifest, refused when anything differs."""
    base = f"{root}/bundle_id={ident}"
    records, manifest = spark.read.parquet(f"{base}/records"), spark.read.json(f"{base}/manifest")
    rules.enforce(load_violations(records, manifest, expected or {}, budget), f"bundle {ident}")
    return (records if budget is None else records.filter(F.col("order_index") < budget)), manifest


def load_violations(records: DataFrame, manifest: DataFrame, expected: dict, budget: int | None) -> DataFrame:
    """Content hash, expected identity and budget checks."""
    actual = record_hash(records)
    checked = manifest.withColumn("a", actual.select(F.struct(*actual.columns)).scalar())
    wanted = {k: v if isinstance(v, (str, int)) else stable_hash(v) for k, v in expected.items()}
    return rules.row_rules(
        checked,
        "bundle_id",
        [
            ("transcript_hash_differs", F.col("transcript_hash") != F.col("a.ordering_hash")),
            ("budget_exceeds_records", F.lit(budget or 0) > F.col("a.row_count"), F.col("a.row_count")),
        ]
        + [(f"{k}_differs", ~F.col(k).eqNullSafe(F.lit(v)), F.col(k)) for k, v in wanted.items()],
    )
