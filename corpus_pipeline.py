"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the last return the
columns of ``documents``; the last returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceaudit.llm import jaccard, mixing, packing, quality, substrings
from traceaudit.llm.queries import tokenizer_path
from traceaudit.llm.store import fresh_folder
from traceaudit.plans.registry import Catalog
from traceaudit.session import stored_tables

CATALOG = Catalog()
#: Near duplicates: words of an n-gram, and percent of the n-grams of two documents that both have.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: four of five of their 5-word n-grams in common."""
    return jaccard.drop_near_duplicates(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the same one, has already."""
    return substrings.dedup_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents of some are taken repeatedly, of others in part."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]
#: The classifier, the tokenizer and the seeded mix can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with stored_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs


@CATALOG.query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
