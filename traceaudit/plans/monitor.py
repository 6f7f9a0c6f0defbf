"""Per-account monitoring over the events table, batch side."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import monitor as M
from traceaudit.operators.ordering import hash_fraction, positions
from traceaudit.plans.corpus import draw_sql
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

BUDGET = 40
CHECKPOINTS = (5, 10, 20, 40)

# A user is an account; events in time order are its queries and the value is
# the detector score. Roles are drawn once per account.
SERIES = f"""
series AS (
  SELECT user_id::VARCHAR AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS query_index, value AS score,
    CASE WHEN {draw_sql('user_id', 31)} < 0.4 THEN 'attacker' ELSE 'benign' END AS label,
    CASE WHEN {draw_sql('user_id', 31)} < 0.4 THEN CASE WHEN {draw_sql('user_id', 32)} < 0.5 THEN 'fast' ELSE 'evasive' END END AS attack_type,
    CASE WHEN {draw_sql('user_id', 31)} >= 0.7 THEN 'calibration' ELSE 'evaluation' END AS part
  FROM events
)"""


def series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    role, kind = hash_fraction("user_id", 31), hash_fraction("user_id", 32)
    ordered = positions(events, ["ts", "event_id"], by=["user_id"], name="query_index", sample_of=events)
    return ordered.select(
        F.col("user_id").cast("string").alias("entity_id"),
        "query_index",
        F.col("value").alias("score"),
        F.when(role < 0.4, "attacker").otherwise("benign").alias("label"),
        F.when(role < 0.4, F.when(kind < 0.5, "fast").otherwise("evasive")).alias("attack_type"),
        F.lit("active-v1").alias("detector"),
        F.lit("per-account").alias("monitor_mode"),
        F.when(role >= 0.7, "calibration").otherwise("evaluation").alias("part"),
    )


FOUND = """
found AS (SELECT entity_id, any_value(label) AS label, any_value(attack_type) AS attack_type, max(query_index) AS observed_until, max(score) AS score,
  min(query_index) FILTER (score >= {t}) AS queries_to_detection FROM series WHERE {where} GROUP BY 1)"""


@query(
    "monitor_first_detection",
    f"""WITH {SERIES}, {FOUND.format(t=90, where='query_index <= 40')}
SELECT entity_id, label, attack_type, observed_until::BIGINT AS observed_until, queries_to_detection::BIGINT AS queries_to_detection,
 queries_to_detection IS NULL AS censored, (CASE WHEN queries_to_detection IS NULL THEN observed_until END)::BIGINT AS censor_at FROM found""",
)
def monitor_first_detection(spark, sf_dir):
    return M.first_detection(M.within_budget(series(spark, sf_dir), BUDGET), 90.0, "higher")


@query(
    "monitor_first_detection_lower",
    f"""WITH {SERIES} SELECT entity_id, min(score) AS lowest, (min(query_index) FILTER (score <= 0.5))::BIGINT AS queries_to_detection FROM series GROUP BY 1""",
)
def monitor_first_detection_lower(spark, sf_dir):
    found = M.entities(series(spark, sf_dir), "lower", 0.5)
    return found.select("entity_id", F.col("score").alias("lowest"), "queries_to_detection")


LOCKED = """
benign AS (SELECT entity_id, max(score) AS score FROM series WHERE part = 'calibration' AND query_index <= 40 GROUP BY 1),
locked AS (SELECT coalesce((SELECT min(b.score) FROM benign b WHERE (SELECT count(*) FROM benign x WHERE x.score >= b.score)::DOUBLE / (SELECT count(*) FROM benign) <= 0.1), nextafter(max(score), 'inf'::DOUBLE)) AS threshold FROM benign)"""


@query("monitor_entity_threshold", f"WITH {SERIES}, {LOCKED} SELECT threshold, (SELECT count(*) FROM benign)::BIGINT AS benign_entities FROM locked")
def monitor_entity_threshold(spark, sf_dir):
    calibration = M.within_budget(series(spark, sf_dir).filter("part = 'calibration'"), BUDGET)
    benign = M.entities(calibration, "higher")
    locked = M.entity_threshold(benign, 0.1, "higher")
    return spark.range(1).select(F.lit(locked.value).alias("threshold"), F.lit(locked.entities).cast("bigint").alias("benign_entities"))


@query(
    "monitor_report",
    f"""WITH {SERIES}, {LOCKED}, {FOUND.format(t='(SELECT threshold FROM locked)', where="part = 'evaluation' AND query_index <= 40")}
SELECT (SELECT threshold FROM locked) AS threshold, (SELECT count(*) FROM benign)::BIGINT AS calibration_entities,
 (SELECT count(*) FROM benign WHERE score >= (SELECT threshold FROM locked))::BIGINT AS calibration_false_positives,
 count(*) FILTER (label = 'benign')::BIGINT AS benign_entities, count(*) FILTER (label = 'attacker')::BIGINT AS attacker_entities,
 count(*) FILTER (label = 'benign' AND queries_to_detection IS NOT NULL)::BIGINT AS false_positives,
 count(*) FILTER (label = 'attacker' AND queries_to_detection IS NOT NULL)::BIGINT AS detected,
 round(count(*) FILTER (label = 'attacker' AND queries_to_detection IS NOT NULL)::DOUBLE / count(*) FILTER (label = 'attacker'), 9) AS tpr_at_locked_threshold,
 CASE WHEN min(observed_until) FILTER (label = 'attacker') >= 40 THEN (SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 9)
   FROM found p, found n WHERE p.label = 'attacker' AND n.label = 'benign') END AS roc_auc FROM found""",
)
def monitor_report(spark, sf_dir):
    rows = series(spark, sf_dir)
    found = M.monitor_report(rows.filter("part = 'calibration'"), rows.filter("part = 'evaluation'"), 0.1, BUDGET)
    return found.select(
        "threshold", "calibration_entities", "calibration_false_positives", "benign_entities", "attacker_entities",
        "false_positives", "detected", F.round("tpr_at_locked_threshold", 9).alias("tpr_at_locked_threshold"),
        F.round("roc_auc", 9).alias("roc_auc"),
    )


def attackers(spark, sf_dir):
    rows = M.within_budget(series(spark, sf_dir), BUDGET).filter("label = 'attacker'")
    return M.first_detection(rows, 90.0, "higher")


ATTACKERS = f"WITH {SERIES}, {FOUND.format(t=90, where=chr(39).join(['label = ', 'attacker', '']) + ' AND query_index <= 40')}"


@query(
    "monitor_detection_curve",
    f"""{ATTACKERS} SELECT attack_type, c.q::INTEGER AS queries, count(*) FILTER (queries_to_detection <= c.q)::BIGINT AS detected, count(*)::BIGINT AS n,
round(count(*) FILTER (queries_to_detection <= c.q)::DOUBLE / count(*), 9) AS detection_rate FROM found, (VALUES (5), (10), (20), (40)) AS c(q) GROUP BY 1, 2""",
)
def monitor_detection_curve(spark, sf_dir):
    curve = M.detection_curve(attackers(spark, sf_dir), CHECKPOINTS, by=["attack_type"])
    return curve.withColumn("detection_rate", F.round("detection_rate", 9))


@query(
    "monitor_type_summary",
    f"""{ATTACKERS} SELECT attack_type, count(*)::BIGINT AS n, count(queries_to_detection)::BIGINT AS detected, (count(*) - count(queries_to_detection))::BIGINT AS censored,
round(count(queries_to_detection)::DOUBLE / count(*), 9) AS detection_rate, round(avg(queries_to_detection), 9) AS mean_queries, median(queries_to_detection)::DOUBLE AS median_queries FROM found GROUP BY 1""",
)
def monitor_type_summary(spark, sf_dir):
    found = M.type_summary(attackers(spark, sf_dir), by=["attack_type"])
    return found.withColumns({c: F.round(c, 9) for c in ("detection_rate", "mean_queries")})


# Raw arrival numbers of one event type as indices: gaps on purpose.
@query(
    "monitor_series_rules",
    """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), p AS (SELECT * FROM s WHERE event_type <> 'error'),
e AS (SELECT user_id, count(DISTINCT i) AS k, min(i) AS lo, max(i) AS hi FROM p GROUP BY 1)
SELECT 'query_index_gap' AS rule, count(*)::BIGINT AS broken FROM e WHERE lo <> 1 OR hi <> k HAVING count(*) > 0""",
)
def monitor_series_rules(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    ordered = positions(events, ["ts", "event_id"], by=["user_id"], name="query_index", sample_of=events)
    rows = ordered.filter("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("entity_id"), "query_index", F.lit("benign").alias("label"),
        F.lit(None).cast("string").alias("attack_type"), F.lit("v1").alias("detector"), F.lit("per-account").alias("monitor_mode"),
    )
    return M.series_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "monitor_event_rules",
    """SELECT rule, count(*)::BIGINT AS broken FROM (
SELECT 'bad_label' AS rule FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL
SELECT 'bad_query_index' FROM events WHERE floor(value) < 1 UNION ALL
SELECT 'attacker_without_type' FROM events WHERE event_type = 'click') GROUP BY 1""",
)
def monitor_event_rules(spark, sf_dir):
    label = F.when(F.col("event_type") == "click", "attacker").when(F.col("event_type") == "view", "benign")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.coalesce(label, F.col("event_type")).alias("label"),
        F.floor("value").alias("query_index"),
        F.col("value").alias("score"),
        F.lit(None).cast("string").alias("attack_type"),
        F.lit("v1").alias("detector"),
        F.lit("per-account").alias("monitor_mode"),
    )
    return M.event_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "monitor_horizon_rules",
    f"""WITH {SERIES}, {FOUND.format(t=90, where='query_index <= 70')} SELECT rule, count(*)::BIGINT AS broken FROM (
SELECT 'benign_not_observed_through_budget' AS rule FROM found WHERE label = 'benign' AND observed_until < 70 UNION ALL
SELECT 'undetected_not_observed_through_budget' FROM found WHERE label = 'attacker' AND queries_to_detection IS NULL AND observed_until < 70) GROUP BY 1""",
)
def monitor_horizon_rules(spark, sf_dir):
    found = M.entities(M.within_budget(series(spark, sf_dir), 70), "higher", 90.0)
    return M.horizon_violations(found, 70).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "monitor_count_windows",
    """SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events""",
)
def monitor_count_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    ordered = positions(events, ["ts", "event_id"], by=["user_id"])
    return M.batches(ordered, 10, by=["user_id"]).select("event_id", "batch")


@query(
    "monitor_full_count_windows",
    """WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events)
SELECT user_id, batch, count(*)::BIGINT AS queries FROM b GROUP BY 1, 2 HAVING count(*) = 10""",
)
def monitor_full_count_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    ordered = positions(events, ["ts", "event_id"], by=["user_id"])
    full = M.batches(ordered, 10, by=["user_id"], keep_last=False)
    return full.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("queries"))


@query(
    "monitor_attack_type_coverage",
    f"WITH {SERIES} SELECT t AS row_key FROM (VALUES ('fast'), ('evasive'), ('sybil')) AS r(t) WHERE t NOT IN (SELECT attack_type FROM series WHERE label = 'attacker')",
)
def monitor_attack_type_coverage(spark, sf_dir):
    rows = series(spark, sf_dir).filter("label = 'attacker'")
    return M.coverage_violations(rows, ["fast", "evasive", "sybil"]).select("row_key")
