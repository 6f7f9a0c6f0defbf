"""Corpus preparation over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.text import fold_key, norm_key, strip
from traceaudit.operators import corpus as C
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.ordering import positions
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

SEED = 42
BUDGETS = C.DEFAULT_BUDGETS

# DuckDB spelling of the comparison key, of the seeded digest and of hash draws.
KEY = r"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
STRIPPED = r"regexp_replace(text, '^[\s\v\x1c-\x1f\x{85}\x{a0}]+|[\s\v\x1c-\x1f\x{85}\x{a0}]+$', '', 'g')"
DIGEST = "md5('{seed}:' || {c})"
DRAW = "(('0x' || substr(md5('{seed}:' || {c}), 1, 8))::BIGINT / 4294967296.0)"


def key_sql(column: str) -> str:
    return KEY.replace("{c}", column)


def digest_sql(column: str, seed: int = SEED) -> str:
    return DIGEST.format(c=column, seed=seed)


def draw_sql(column: str, seed: int = SEED) -> str:
    return DRAW.format(c=column, seed=seed)


# Training candidates are all sources but one; the remaining source is the
# evaluation side, so exact copies across sources give real contamination.
CLEAN = f"""
keyed AS (SELECT doc_id, source, lang, {key_sql('text')} AS k FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id FROM keyed WHERE source <> 'src0' GROUP BY k),
clean AS (
  SELECT doc_id, source, lang FROM keyed
  WHERE source <> 'src0' AND doc_id IN (SELECT doc_id FROM firsts)
    AND k NOT IN (SELECT k FROM keyed WHERE source = 'src0')
),
ordered AS (
  SELECT doc_id, source, lang, row_number() OVER (ORDER BY {digest_sql('doc_id')}, doc_id) AS position FROM clean
)
"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def clean_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    train, evaluation = docs.filter("source <> 'src0'"), docs.filter("source = 'src0'")
    return C.clean_rows(train, evaluation, "text", "doc_id", ["source", "lang"])


def ordered_documents(spark, sf_dir):
    return C.seeded_order(clean_documents(spark, sf_dir), "doc_id", SEED)


@query(
    "corpus_budget_report",
    f"""WITH {CLEAN}
SELECT b.budget::BIGINT AS budget, source, count(*)::BIGINT AS prompts
FROM ordered JOIN (VALUES (100), (1000), (10000)) AS b(budget) ON position <= b.budget
GROUP BY 1, 2""",
)
def corpus_budget_report(spark, sf_dir):
    members = C.budget_members(ordered_documents(spark, sf_dir), BUDGETS)
    return members.groupBy(F.col("budget").cast("bigint").alias("budget"), "source").agg(
        F.count(F.lit(1)).alias("prompts")
    )


@query(
    "corpus_budget_prefixes",
    f"""WITH {CLEAN}
SELECT b.budget::BIGINT AS requested, count(position)::BIGINT AS actual, count(position) < b.budget AS insufficient_data
FROM (VALUES (100), (1000), (10000)) AS b(budget) LEFT JOIN ordered ON position <= b.budget GROUP BY b.budget""",
)
def corpus_budget_prefixes(spark, sf_dir):
    found = C.budget_prefixes(ordered_documents(spark, sf_dir), BUDGETS)
    return found.select(F.col("requested").cast("bigint").alias("requested"), "actual", "insufficient_data")


@query("corpus_seeded_order", f"WITH {CLEAN} SELECT doc_id, position::BIGINT AS position FROM ordered")
def corpus_seeded_order(spark, sf_dir):
    return ordered_documents(spark, sf_dir).select("doc_id", "position")


@query(
    "corpus_seeded_sample",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {digest_sql('doc_id', 7)}, doc_id) AS p FROM documents) WHERE p <= 250",
)
def corpus_seeded_sample(spark, sf_dir):
    return C.seeded_sample(documents(spark, sf_dir).select("doc_id"), "doc_id", 250, 7)


@query(
    "corpus_dedup",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {key_sql('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def corpus_dedup(spark, sf_dir):
    return C.dedup(documents(spark, sf_dir), "text", "doc_id").select("doc_id", "source")


@query(
    "corpus_dedup_deleted",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {key_sql('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1",
)
def corpus_dedup_deleted(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return C.deleted_ids(docs, C.dedup(docs, "text", "doc_id"), "doc_id")


@query(
    "corpus_decontaminated",
    f"""WITH keyed AS (SELECT doc_id, source, {key_sql('text')} AS k FROM documents)
SELECT doc_id FROM keyed WHERE source <> 'src0' AND k NOT IN (SELECT k FROM keyed WHERE source = 'src0')""",
)
def corpus_decontaminated(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return C.decontaminate(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), "text").select("doc_id")


@query(
    "corpus_contamination_report",
    f"""WITH keyed AS (SELECT doc_id, source, {key_sql('text')} AS k FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id, k FROM keyed WHERE source <> 'src0' GROUP BY k)
SELECT count(*)::BIGINT AS input_count, count(*) FILTER (k NOT IN (SELECT k FROM keyed WHERE source = 'src0'))::BIGINT AS output_count,
 (SELECT count(*) FROM keyed WHERE source = 'src0')::BIGINT AS eval_prompt_count FROM firsts""",
)
def corpus_contamination_report(spark, sf_dir):
    docs = documents(spark, sf_dir)
    evaluation = docs.filter("source = 'src0'").select(C.key_digest("text").alias("key"))
    firsts = docs.filter("source <> 'src0'").select(C.key_digest("text").alias("key")).distinct()
    hits = firsts.join(evaluation.distinct().withColumn("hit", F.lit(1)), "key", "left")
    counts = hits.agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("hit").isNull()).alias("output_count"))
    total = evaluation.agg(F.count(F.lit(1)).alias("eval_prompt_count"))
    return beside(counts, total)


@query(
    "corpus_excluded",
    f"SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') AND {STRIPPED} NOT IN (SELECT {STRIPPED} FROM documents WHERE source = 'src1')",
)
def corpus_excluded(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return C.exclude(docs, docs.filter("source = 'src1'"), "doc_id", "text").select("doc_id")


@query(
    "corpus_held_out_overlap",
    f"""WITH keyed AS (SELECT source, {key_sql('text')} AS k FROM documents)
SELECT count(*)::BIGINT AS overlapping_keys FROM (SELECT DISTINCT k FROM keyed WHERE source = 'src0' AND k IN (SELECT k FROM keyed WHERE source <> 'src0'))""",
)
def corpus_held_out_overlap(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = C.held_out_violations(docs.filter("source = 'src0'"), docs.filter("source <> 'src0'"), "text")
    return found.agg(F.count(F.lit(1)).alias("overlapping_keys"))


@query(
    "corpus_holdout_blocks",
    f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM documents)
SELECT doc_id, ((position - 1) // 20)::BIGINT AS block_id FROM o WHERE (position - 1) // 20 IN (5, 6, 7)""",
)
def corpus_holdout_blocks(spark, sf_dir):
    ordered = positions(documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    return C.holdout_blocks(ordered, 100, 20, [5, 6, 7]).select("doc_id", "block_id")


@query(
    "corpus_slice_after_budget",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) WHERE p BETWEEN 101 AND 180",
)
def corpus_slice_after_budget(spark, sf_dir):
    ordered = positions(documents(spark, sf_dir).select("doc_id"), ["doc_id"])
    return C.slice_after(ordered, 100, 80).select("doc_id")


@query(
    "corpus_ratio_mix",
    """WITH c AS (SELECT count(*) FILTER (lang = 'en') AS g, count(*) FILTER (lang <> 'en') AS s FROM documents),
t AS (SELECT g, s, greatest(1, least(floor(g / 0.8), floor(s / (1.0 - 0.8)))) AS total FROM c),
q AS (SELECT least(g, round_even(total * 0.8, 0)) AS qg, total, s FROM t),
r AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'general' ELSE 'special' END AS mix_side,
  row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) AS p FROM documents)
SELECT doc_id, lang, mix_side FROM r, q WHERE (mix_side = 'general' AND p <= qg) OR (mix_side = 'special' AND p <= least(s, total - qg))""",
)
def corpus_ratio_mix(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    return C.mix(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), 0.8, "doc_id")


ALLOCATION = """
w AS (SELECT {by} AS stratum, count(*) AS weight FROM documents WHERE {where} GROUP BY 1),
s AS (SELECT stratum, weight, {total} * weight::DOUBLE / (sum(weight) OVER ())::DOUBLE AS share FROM w),
quotas AS (SELECT stratum, weight, (floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, weight DESC, stratum DESC)
  <= {total} - sum(floor(share)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM s)
"""


@query(
    "corpus_stratum_allocation",
    f"WITH {ALLOCATION.format(by='lang', where='true', total=777)} SELECT stratum, weight::BIGINT AS weight, quota FROM quotas",
)
def corpus_stratum_allocation(spark, sf_dir):
    weights = documents(spark, sf_dir).groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("weight"))
    return C.largest_remainder(weights, 777)


@query(
    "corpus_matched_sample",
    f"""WITH {ALLOCATION.format(by='lang', where="source = 'src1'", total=40)},
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {digest_sql('doc_id', 11)}, doc_id) AS p FROM documents WHERE source <> 'src1')
SELECT doc_id, lang FROM r JOIN quotas ON lang = stratum WHERE p <= quota""",
)
def corpus_matched_sample(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source")
    chosen, _ = C.matched_sample(
        docs.filter("source <> 'src1'"), docs.filter("source = 'src1'"), 40, 11, "lang", "doc_id"
    )
    return chosen.select("doc_id", "lang")


@query(
    "corpus_sample_shortfalls",
    f"""WITH {ALLOCATION.format(by='source', where='true', total=100000)},
h AS (SELECT source, count(*) AS have FROM documents GROUP BY 1)
SELECT stratum, quota, (quota - have)::BIGINT AS shortfall FROM quotas JOIN h ON source = stratum WHERE quota > have""",
)
def corpus_sample_shortfalls(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return C.matched_sample(docs, docs, 100000, 11, "source", "doc_id")[1]


@query(
    "corpus_select_by_order",
    f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {digest_sql('doc_id', 3)}, doc_id) - 1 AS order_index FROM labels)
SELECT doc_id, row_number() OVER (ORDER BY order_index)::BIGINT AS position FROM o JOIN documents USING (doc_id)
QUALIFY position <= 120""",
)
def corpus_select_by_order(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("pool_position"))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    ordering = C.seeded_order(labels, "doc_id", 3).select(
        "doc_id", (F.col("position") - 1).alias("order_index")
    )
    return C.select_by_order(docs, ordering, 120, "doc_id").select("doc_id", "position")


@query("corpus_mix_counts", "SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def corpus_mix_counts(spark, sf_dir):
    return C.source_counts(documents(spark, sf_dir), "source", "lang")


@query(
    "corpus_tier_per_source",
    """SELECT source, count(*)::BIGINT AS budget, CASE WHEN count(*) <= 100 THEN 100 WHEN count(*) <= 1000 THEN 1000
 WHEN count(*) <= 10000 THEN 10000 WHEN count(*) <= 50000 THEN 50000 WHEN count(*) <= 100000 THEN 100000 END::BIGINT AS tier FROM documents GROUP BY 1""",
)
def corpus_tier_per_source(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("budget"))
    return counts.withColumn("tier", C.tier_for("budget").cast("bigint"))


@query("corpus_head_limit", "SELECT doc_id FROM documents WHERE trim(text) <> '' ORDER BY doc_id LIMIT 150")
def corpus_head_limit(spark, sf_dir):
    docs = documents(spark, sf_dir).filter(strip("text") != "").select("doc_id")
    return C.limit_rows(docs, 150, "doc_id")


@query(
    "corpus_concat_limit",
    """SELECT doc_id, stage FROM (SELECT doc_id, 0 AS stage FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'fr')
ORDER BY stage, doc_id LIMIT 90""",
)
def corpus_concat_limit(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    parts = [docs.filter(F.col("lang") == lang).select("doc_id") for lang in ("de", "fr")]
    return C.concat_limit(parts, 90, "doc_id")


@query(
    "corpus_pending",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def corpus_pending(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return C.pending(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "corpus_unique_ids",
    """WITH d AS (SELECT doc_id, source || '-' || n_chars AS ident FROM documents)
SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY ident) > 1 THEN ident || '::row-' || doc_id ELSE ident END AS unique_id FROM d""",
)
def corpus_unique_ids(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", "n_chars").alias("ident"))
    return C.unique_ids(docs, "ident", "doc_id").select("doc_id", "unique_id")


@query(
    "corpus_schedule",
    """SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS schedule_position FROM (
SELECT doc_id, coalesce(quality + 2.0 * toxic, -1.0)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id))""",
)
def corpus_schedule(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("priority"))
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2.0 * F.col("toxic")).alias("score"))
    return C.schedule(docs, scores, "doc_id", "score", "priority").select("doc_id", "score", "schedule_position")


@query(
    "corpus_mode_counts",
    "SELECT source, count(*)::BIGINT AS available, least(count(*), 2)::BIGINT AS smoke, least(count(*), 20)::BIGINT AS pilot, count(*)::BIGINT AS full_run FROM documents GROUP BY 1",
)
def corpus_mode_counts(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    modes = {"smoke": "smoke", "pilot": "pilot", "full_run": "full"}
    return counts.select(
        "source", "available", *[C.mode_count("available", m, 2, 20).cast("bigint").alias(n) for n, m in modes.items()]
    )


@query(
    "corpus_pick_split",
    f"""WITH s AS (SELECT DISTINCT source, CASE WHEN {draw_sql('doc_id', 5)} < 0.02 THEN 'validation' WHEN {draw_sql('doc_id', 5)} < 0.05 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT source, arg_min(split, CASE split WHEN 'validation' THEN 1 WHEN 'train' THEN 2 ELSE 3 END) AS split FROM s GROUP BY 1""",
)
def corpus_pick_split(spark, sf_dir):
    draw = C.hash_fraction("doc_id", 5)
    split = F.when(draw < 0.02, "validation").when(draw < 0.05, "train").otherwise("test")
    splits = documents(spark, sf_dir).select("source", split.alias("split")).distinct()
    return C.pick_split(splits, ["source"])


@query(
    "corpus_split_by_ratio",
    f"SELECT doc_id, CASE WHEN {draw_sql('doc_id', 9)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM documents",
)
def corpus_split_by_ratio(spark, sf_dir):
    return C.split_by_ratio(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.8, 9)


@query(
    "corpus_pool_duplicates",
    f"""WITH k AS (SELECT {key_sql('text')} AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT 'duplicate_prompt' AS rule, n::BIGINT AS copies, count(*)::BIGINT AS prompts FROM k WHERE n > 1 GROUP BY 2""",
)
def corpus_pool_duplicates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.sha2(fold_key("text"), 256).alias("fold"))
    found = rules.all_violations(
        [
            rules.duplicate_rule(docs, ["doc_id"], "duplicate_id"),
            rules.duplicate_rule(docs, ["fold"], "duplicate_prompt"),
        ]
    )
    copies = F.regexp_extract("detail", r"seen (\d+) times", 1).cast("bigint")
    return found.groupBy("rule", copies.alias("copies")).agg(F.count(F.lit(1)).alias("prompts"))


@query(
    "corpus_key_coverage",
    """SELECT count(*) FILTER (l.doc_id IS NULL)::BIGINT AS left_only, count(*) FILTER (d.doc_id IS NULL)::BIGINT AS right_only,
count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL)::BIGINT AS shared FROM documents d FULL JOIN labels l USING (doc_id)""",
)
def corpus_key_coverage(spark, sf_dir):
    return rules.key_coverage(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"])


@query("corpus_distinct_sources", "SELECT count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS languages FROM documents")
def corpus_distinct_sources(spark, sf_dir):
    return C.distinct_counts(documents(spark, sf_dir), ["source", "lang"], ["sources", "languages"])


@query(
    "corpus_bounded_scan",
    f"""WITH u AS (SELECT conv_id, arg_min({STRIPPED}, turn) FILTER (role = 'user' AND {STRIPPED} <> '') AS query FROM conversations GROUP BY 1),
p AS (SELECT query, row_number() OVER (ORDER BY conv_id) AS position FROM u)
SELECT query, position::BIGINT AS position FROM p WHERE position <= 60 AND query <> '' AND query NOT IN (SELECT {STRIPPED} FROM documents) ORDER BY position LIMIT 10""",
)
def corpus_bounded_scan(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = (F.col("role") == "user") & (strip("text") != "")
    firsts = turns.groupBy("conv_id").agg(F.min_by(F.when(asked, strip("text")), F.when(asked, F.col("turn"))).alias("query"))
    stream = positions(firsts, ["conv_id"], sample_of=turns).select("query", "position")
    return C.take_user_traffic(stream, documents(spark, sf_dir).select(F.col("text").alias("query")), 10, 60)


@query(
    "corpus_budget_shares",
    """SELECT source, least(3, n)::BIGINT AS seed, (CASE WHEN n - least(3, n) = 1 THEN 1 ELSE (n - least(3, n)) // 2 END)::BIGINT AS template,
(n - least(3, n) - CASE WHEN n - least(3, n) = 1 THEN 1 ELSE (n - least(3, n)) // 2 END)::BIGINT AS followup FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""",
)
def corpus_budget_shares(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", C.budget_shares("n").alias("b")).select("source", "b.*")


@query(
    "corpus_normalized_key_stats",
    f"SELECT lang, count(DISTINCT {key_sql('text')})::BIGINT AS distinct_keys, count(*)::BIGINT AS n FROM documents GROUP BY 1",
)
def corpus_normalized_key_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", F.sha2(norm_key("text"), 256).alias("k"))
    per_key = docs.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy("lang").agg(F.count(F.lit(1)).alias("distinct_keys"), F.sum("c").alias("n"))
