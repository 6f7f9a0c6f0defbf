"""The registered queries of the training-data operators, over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.llm import ann, hosts, infill, jaccard, lm, minmax, mixing, packing, quality, substrings, tokenfiles, vectorcodes, warc
from traceaudit.llm.sql import HOST_RULES, INFILL, JACCARD, MIN_MAX, SUBSTRINGS, VECTOR_CODES, WARC
from traceaudit.llm.store import fresh_folder
from traceaudit.plans.registry import Catalog

CATALOG = Catalog()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@CATALOG.query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@CATALOG.query("op2_host_quality_rules", HOST_RULES)
def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(_table(spark, sf_dir, "documents"))
    return judged.withColumns({rate: F.round(rate, 9) for rate in hosts.RULES.values()})


@CATALOG.query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("_takes", F.lit(0).cast("bigint"), lambda total, take: total + take["words"])
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"), F.transform("_takes", lambda t: t["shard"]).alias("shards"),
    )


@CATALOG.query("op4_cost_balanced_packing")
def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@CATALOG.query("op5_substring_dedup", SUBSTRINGS)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(_table(spark, sf_dir, "documents")).drop("spans")


@CATALOG.query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


@CATALOG.query("op7_warc_archives", WARC)
def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


@CATALOG.query("op8_ngram_jaccard_join", JACCARD)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@CATALOG.query("op9_cross_entropy_difference")
def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return lm.score(_table(spark, sf_dir, "documents"), good)


@CATALOG.query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "token-files")
    tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfiles.token_spans(spark, path)


@CATALOG.query("op11_min_max_near_dedup", MIN_MAX)
def op11_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"))


@CATALOG.query("op12_fill_in_middle", INFILL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (infill.restored("output", "form"), "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@CATALOG.query("op13_vector_codes", VECTOR_CODES)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectorcodes.encode(_table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
