"""Repetition, degeneration, length and judge reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.text import interval_distance, length_group, ngrams, rep_n, ws_tokens
from traceaudit.operators import quality as Q
from traceaudit.plans.corpus import key_sql
from traceaudit.plans.registry import Catalog, table
from traceaudit.plans.text import WS

CATALOG = Catalog()
query = CATALOG.query

BLANK_SPLIT = f"""
words AS (SELECT doc_id, lang, CASE WHEN {key_sql('text')} = '' THEN [] ELSE string_split({key_sql('text')}, ' ') END AS t FROM documents),"""
UNICODE_SPLIT = rf"""
words AS (SELECT doc_id, lang, [replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(text, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{2fa1f}}]|[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*|[^{WS}]')] AS t FROM documents),"""
GRAMS = """
grams AS (SELECT doc_id, lang, len(t) AS n,
  CASE WHEN len(t) > 1 THEN 1.0 - len(list_distinct([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]))::DOUBLE / (len(t) - 1) END AS r2,
  CASE WHEN len(t) > 2 THEN 1.0 - len(list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]))::DOUBLE / (len(t) - 2) END AS r3,
  CASE WHEN len(t) > 3 THEN 1.0 - len(list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] FOR i IN range(1, len(t) - 2)]))::DOUBLE / (len(t) - 3) END AS r4 FROM words)"""
WORDS = BLANK_SPLIT + GRAMS
REPETITION = """SELECT lang, count(*)::BIGINT AS sample_count, count(*) FILTER (n = 0)::BIGINT AS empty_count, round(avg(n), 6) AS mean_tokens, min(n)::BIGINT AS min_tokens, max(n)::BIGINT AS max_tokens,
round(avg(coalesce(r2, 0)), 9) AS rep_2, round(avg(coalesce(r3, 0)), 9) AS rep_3, round(avg(coalesce(r4, 0)), 9) AS rep_4,
count(*) FILTER (r2 IS NULL)::BIGINT AS short_2, count(*) FILTER (r3 IS NULL)::BIGINT AS short_3, count(*) FILTER (r4 IS NULL)::BIGINT AS short_4,
round(count(*) FILTER (n = 0)::DOUBLE / count(*), 9) AS empty_rate FROM grams GROUP BY 1"""


def rounded(found):
    places = {"rep_2": 9, "rep_3": 9, "rep_4": 9, "empty_rate": 9, "mean_tokens": 6}
    return found.withColumns({c: F.round(c, p) for c, p in places.items()})


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "quality_repetition",
    f"WITH {WORDS} {REPETITION}",
)
def quality_repetition(spark, sf_dir):
    return rounded(Q.repetition(documents(spark, sf_dir), "text", tokenizer="whitespace", by=["lang"]))


@query(
    "quality_repetition_long_texts",
    f"WITH {WORDS} SELECT lang, round(avg(r2), 9) AS rep_2, round(avg(r4), 9) AS rep_4 FROM grams GROUP BY 1",
)
def quality_repetition_long_texts(spark, sf_dir):
    found = Q.repetition(
        documents(spark, sf_dir), "text", ns=(2, 4), tokenizer="whitespace", short_policy="exclude", by=["lang"]
    )
    return found.select("lang", F.round("rep_2", 9).alias("rep_2"), F.round("rep_4", 9).alias("rep_4"))


@query("quality_repetition_unicode", f"WITH {UNICODE_SPLIT}{GRAMS} {REPETITION}")
def quality_repetition_unicode(spark, sf_dir):
    return rounded(Q.repetition(documents(spark, sf_dir), "text", tokenizer="unicode_cjk", by=["lang"]))


@query(
    "quality_degeneration",
    f"""WITH {WORDS} SELECT lang, round(avg(coalesce(r2, 0)), 9) AS rep_2, round(avg(coalesce(r3, 0)), 9) AS rep_3, round(avg(coalesce(r4, 0)), 9) AS rep_4,
round(avg(n), 6) AS average_output_length, round(avg((n = 0)::INT), 9) AS empty_output_ratio,
round(avg((greatest(coalesce(r2, 0), coalesce(r3, 0), coalesce(r4, 0)) > 0.2)::INT), 9) AS repetitive_degeneration_ratio FROM grams GROUP BY 1""",
)
def quality_degeneration(spark, sf_dir):
    found = Q.degeneration(documents(spark, sf_dir), "text", by=["lang"])
    rates = ("rep_2", "rep_3", "rep_4", "empty_output_ratio", "repetitive_degeneration_ratio")
    return found.withColumns({c: F.round(c, 9) for c in rates}).withColumn(
        "average_output_length", F.round("average_output_length", 6)
    )


@query("quality_rep_per_text", f"WITH {WORDS} SELECT doc_id, n::BIGINT AS tokens, round(r2, 9) AS rep_2, round(r3, 9) AS rep_3 FROM grams")
def quality_rep_per_text(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", ws_tokens("text").alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.round(rep_n("t", 2), 9).alias("rep_2"), F.round(rep_n("t", 3), 9).alias("rep_3")
    )


@query(
    "quality_ngram_arrays",
    f"WITH {WORDS} SELECT doc_id, greatest(len(t) - 2, 0)::BIGINT AS grams, CASE WHEN len(t) > 2 THEN array_to_string(t[1:3], ' ') END AS first_gram, CASE WHEN len(t) > 2 THEN array_to_string(t[-3:], ' ') END AS last_gram FROM words",
)
def quality_ngram_arrays(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", ngrams(ws_tokens("text"), 3).alias("g"))
    return rows.select(
        "doc_id",
        F.size("g").cast("bigint").alias("grams"),
        F.array_join(F.try_element_at("g", F.lit(1)), " ").alias("first_gram"),
        F.array_join(F.try_element_at("g", F.lit(-1)), " ").alias("last_gram"),
    )


# Judgments: forward and reverse winners follow from the event; lengths from the
# props number and the user id.
JUDGED = """
j AS (SELECT event_id, event_type, CASE WHEN floor(value)::BIGINT % 5 = 0 THEN 'tie' WHEN floor(value)::BIGINT % 2 = 0 THEN 'candidate' ELSE 'reference' END AS f,
  CASE WHEN floor(value * 10)::BIGINT % 5 = 0 THEN 'tie' WHEN floor(value * 10)::BIGINT % 3 = 0 THEN 'candidate' ELSE 'reference' END AS r,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS cl, user_id AS rl FROM events),
d AS (SELECT event_id, event_type, CASE WHEN f = r THEN f ELSE 'tie' END AS outcome, f = r AS consistent,
  CASE WHEN rl = 0 AND cl = 0 THEN 'similar' WHEN rl = 0 THEN 'longer' WHEN cl::DOUBLE / rl < 0.8 THEN 'shorter' WHEN cl::DOUBLE / rl > 1.25 THEN 'longer' ELSE 'similar' END AS length_group FROM j)"""


def judged(spark, sf_dir):
    value = F.col("value")

    def winner(number, every, position, other):
        return F.when(number % 5 == 0, " Tie").when(number % every == 0, position).otherwise(other)

    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "event_type",
        F.struct(F.lit("A").alias("candidate_position"), winner(F.floor(value), 2, "a", "B").alias("winner")).alias("forward"),
        F.struct(F.lit("B").alias("candidate_position"), winner(F.floor(value * 10), 3, "B", "A").alias("winner")).alias("reverse"),
        F.get_json_object("props", "$.k").cast("bigint").alias("candidate_length"),
        F.col("user_id").alias("reference_length"),
    )
    decided = Q.judgments(rows)
    return decided.withColumn("length_group", length_group(F.col("candidate_length"), F.col("reference_length"), 0.8, 1.25))


@query("quality_judgments", f"WITH {JUDGED} SELECT event_id AS id, outcome, consistent AS position_consistent, length_group FROM d")
def quality_judgments(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "outcome", "position_consistent", "length_group")


@query(
    "quality_judge_report",
    f"""WITH {JUDGED} SELECT event_type, length_group, count(*)::BIGINT AS n, count(*) FILTER (outcome = 'candidate')::BIGINT AS candidate_wins, count(*) FILTER (outcome = 'reference')::BIGINT AS reference_wins,
count(*) FILTER (outcome = 'tie')::BIGINT AS ties, count(*) FILTER (NOT consistent)::BIGINT AS position_disagreement_ties,
round((count(*) FILTER (outcome = 'candidate') + 0.5 * count(*) FILTER (outcome = 'tie'))::DOUBLE / count(*), 9) AS candidate_tie_adjusted_win_rate,
round(CASE WHEN count(*) FILTER (outcome <> 'tie') > 0 THEN count(*) FILTER (outcome = 'candidate')::DOUBLE / count(*) FILTER (outcome <> 'tie') END, 9) AS candidate_non_tie_win_rate,
round(count(*) FILTER (consistent)::DOUBLE / count(*), 9) AS position_consistency_rate
FROM d GROUP BY GROUPING SETS ((event_type, length_group), (event_type))""",
)
def quality_judge_report(spark, sf_dir):
    found = Q.judge_report(judged(spark, sf_dir), by=["event_type"])
    rates = ("candidate_tie_adjusted_win_rate", "candidate_non_tie_win_rate", "position_consistency_rate")
    return found.select(
        "event_type", "length_group", "n", "candidate_wins", "reference_wins", "ties", "position_disagreement_ties",
        *[F.round(c, 9).alias(c) for c in rates],
    )


@query(
    "quality_length_controlled",
    f"""WITH {JUDGED}, g AS (SELECT event_type, length_group, (count(*) FILTER (outcome = 'candidate') + 0.5 * count(*) FILTER (outcome = 'tie'))::DOUBLE / count(*) AS r FROM d GROUP BY 1, 2)
SELECT event_type, round(avg(r), 9) AS length_controlled_candidate_win_rate FROM g GROUP BY 1""",
)
def quality_length_controlled(spark, sf_dir):
    found = Q.length_controlled(Q.judge_report(judged(spark, sf_dir), by=["event_type"]), ["event_type"])
    return found.withColumn("length_controlled_candidate_win_rate", F.round("length_controlled_candidate_win_rate", 9))


@query(
    "quality_judgment_rules",
    "SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'position_not_swapped' AS rule FROM events WHERE event_type = 'view' UNION ALL SELECT 'unreadable_forward' FROM events WHERE event_type = 'error') GROUP BY 1",
)
def quality_judgment_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.struct(F.lit("A").alias("candidate_position"), F.when(F.col("event_type") == "error", "C").otherwise("A").alias("winner")).alias("forward"),
        F.struct(F.when(F.col("event_type") == "view", "A").otherwise("B").alias("candidate_position"), F.lit("tie").alias("winner")).alias("reverse"),
    )
    return Q.judgment_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "quality_length_groups",
    f"""WITH w AS (SELECT doc_id, lang, len(CASE WHEN {key_sql('text')} = '' THEN [] ELSE string_split({key_sql('text')}, ' ') END) AS n FROM documents)
SELECT lang, CASE WHEN n / 300.0 < 0.5 THEN 'shorter' WHEN n / 300.0 > 2 THEN 'longer' ELSE 'similar' END AS length_group, count(*)::BIGINT AS texts FROM w GROUP BY 1, 2""",
)
def quality_length_groups(spark, sf_dir):
    length = Q.output_length(F.lit(None), F.col("text"), "whitespace")
    rows = documents(spark, sf_dir).select("lang", length_group(length, F.lit(300), 0.5, 2.0).alias("length_group"))
    return rows.groupBy("lang", "length_group").agg(F.count(F.lit(1)).alias("texts"))


@query(
    "quality_interval_distance",
    """SELECT event_id, CASE WHEN value < 10 THEN 'below' WHEN value > 50 THEN 'above' ELSE 'inside' END AS position, round(greatest(10 - value, value - 50, 0), 6) AS distance,
round(CASE WHEN value < 10 THEN (10 - value) / 10 WHEN value > 50 THEN (value - 50) / 50 ELSE 0 END, 6) AS relative_distance FROM events""",
)
def quality_interval_distance(spark, sf_dir):
    where = interval_distance(F.col("value"), F.lit(10.0), F.lit(50.0))
    rows = table(spark, sf_dir, "events").select("event_id", where.alias("w"))
    return rows.select(
        "event_id", "w.position", F.round("w.distance", 6).alias("distance"), F.round("w.relative_distance", 6).alias("relative_distance")
    )
