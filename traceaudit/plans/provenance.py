"""Detector thresholds, ROC, retention and fingerprints over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.stats import hoeffding
from traceaudit.operators import provenance as P
from traceaudit.operators import retention as R
from traceaudit.operators import rules
from traceaudit.operators.ordering import hash_fraction
from traceaudit.plans.corpus import draw_sql
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

# Low-quality documents are the positives, the text length is the score; half of
# the negatives calibrate and the other half are tested.
SCORES = f"""
scores AS (
  SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'positive' ELSE 'negative' END AS label, n_chars::DOUBLE AS score,
    CASE WHEN quality = 1 AND {draw_sql('doc_id', 21)} < 0.5 THEN 'calibration' ELSE 'test' END AS part
  FROM documents JOIN labels USING (doc_id)
)"""


def scores(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    calibrates = (F.col("quality") == 1) & (hash_fraction("doc_id", 21) < 0.5)
    return joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 0, "positive").otherwise("negative").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        F.lit("higher").alias("direction"),
        F.lit("length-v1").alias("detector"),
        F.when(calibrates, "calibration").otherwise("test").alias("part"),
    )


def threshold_sql(direction: str, fpr: float) -> str:
    beyond = ">" if direction == "higher" else "<"
    best = "min" if direction == "higher" else "max"
    return f"""
neg AS (SELECT score FROM scores WHERE part = 'calibration'),
cand AS (SELECT c.score, (SELECT count(*) FROM neg n WHERE n.score {beyond} c.score) AS fp, (SELECT count(*) FROM neg) AS nn FROM (SELECT DISTINCT score FROM neg) c),
locked AS (SELECT {best}(score) AS threshold FROM cand WHERE fp::DOUBLE / nn <= {fpr})"""


@query(
    "provenance_calibrate_higher",
    f"""WITH {SCORES}, {threshold_sql('higher', 0.05)}
SELECT threshold, fp::BIGINT AS false_positives, nn::BIGINT AS n_negative, round(fp::DOUBLE / nn, 9) AS fpr FROM locked JOIN cand ON score = threshold""",
)
def provenance_calibrate_higher(spark, sf_dir):
    found = P.calibrate(scores(spark, sf_dir).filter("part = 'calibration'"), 0.05, "higher")
    return found.withColumn("fpr", F.round("fpr", 9))


@query(
    "provenance_calibrate_lower",
    f"""WITH {SCORES}, {threshold_sql('lower', 0.1)}
SELECT threshold, fp::BIGINT AS false_positives, nn::BIGINT AS n_negative, round(fp::DOUBLE / nn, 9) AS fpr FROM locked JOIN cand ON score = threshold""",
)
def provenance_calibrate_lower(spark, sf_dir):
    found = P.calibrate(scores(spark, sf_dir).filter("part = 'calibration'"), 0.1, "lower")
    return found.withColumn("fpr", F.round("fpr", 9))


COUNTS = """SELECT count(*)::BIGINT AS n, count(*) FILTER (label = 'positive')::BIGINT AS n_positive, count(*) FILTER (label = 'negative')::BIGINT AS n_negative,
 count(*) FILTER (label = 'positive' AND score > {t})::BIGINT AS true_positives, count(*) FILTER (label = 'negative' AND score > {t})::BIGINT AS false_positives,
 round(count(*) FILTER (label = 'positive' AND score > {t})::DOUBLE / count(*) FILTER (label = 'positive'), 9) AS tpr,
 round(count(*) FILTER (label = 'negative' AND score > {t})::DOUBLE / count(*) FILTER (label = 'negative'), 9) AS fpr"""


@query("provenance_detector_counts", f"WITH {SCORES} {COUNTS.format(t='2000')} FROM scores")
def provenance_detector_counts(spark, sf_dir):
    found = P.detector_counts(scores(spark, sf_dir), 2000.0, "higher")
    return found.withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


AUC = """(SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 9)
 FROM (SELECT score FROM {t} WHERE label = 'positive') p, (SELECT score FROM {t} WHERE label = 'negative') n)"""


@query(
    "provenance_roc_auc",
    f"""WITH {SCORES} SELECT count(*) FILTER (label = 'positive')::BIGINT AS n_positive, count(*) FILTER (label = 'negative')::BIGINT AS n_negative,
{AUC.format(t='scores')} AS roc_auc FROM scores""",
)
def provenance_roc_auc(spark, sf_dir):
    return P.roc_auc(scores(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 9))


@query(
    "provenance_roc_curve",
    f"""WITH {SCORES}, points AS (SELECT DISTINCT score AS threshold FROM scores UNION ALL SELECT 'inf'::DOUBLE UNION ALL SELECT '-inf'::DOUBLE)
SELECT threshold, round(count(*) FILTER (label = 'positive' AND score >= threshold)::DOUBLE / count(*) FILTER (label = 'positive'), 9) AS tpr,
 round(count(*) FILTER (label = 'negative' AND score >= threshold)::DOUBLE / count(*) FILTER (label = 'negative'), 9) AS fpr,
 count(*) FILTER (label = 'positive' AND score >= threshold)::BIGINT AS true_positives,
 count(*) FILTER (label = 'negative' AND score >= threshold)::BIGINT AS false_positives FROM points, scores GROUP BY threshold""",
)
def provenance_roc_curve(spark, sf_dir):
    return P.roc_curve(scores(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


@query(
    "provenance_detector_report",
    f"""WITH {SCORES}, {threshold_sql('higher', 0.05)}, test AS (SELECT * FROM scores WHERE part = 'test')
SELECT (SELECT threshold FROM locked) AS threshold, (SELECT count(*) FROM neg)::BIGINT AS calibration_n,
 (SELECT fp FROM cand, locked WHERE cand.score = locked.threshold)::BIGINT AS calibration_fp, c.* EXCLUDE (tpr, fpr), tpr AS tpr_at_locked_threshold, fpr AS actual_fpr,
 {AUC.format(t='test')} AS roc_auc, 1.0::DOUBLE / (SELECT count(*) FROM neg) < 0.05 AS resolves_target
FROM ({COUNTS.format(t='(SELECT threshold FROM locked)')} FROM test) c""",
)
def provenance_detector_report(spark, sf_dir):
    rows = scores(spark, sf_dir)
    report = P.detector_report(rows.filter("part = 'test'"), rows.filter("part = 'calibration'"), 0.05, "higher")
    return report.select(
        "threshold", "calibration_n", "calibration_fp", "n", "n_positive", "n_negative", "true_positives",
        "false_positives", F.round("tpr", 9).alias("tpr_at_locked_threshold"), F.round("fpr", 9).alias("actual_fpr"),
        F.round("roc_auc", 9).alias("roc_auc"), (F.col("calibration_resolution") < 0.05).alias("resolves_target"),
    )


# The bound is the rate at which so few hits or fewer have a chance of 5 %: bisection over the sum of binomial terms.
TERM = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))"


@query(
    "provenance_detector_bounds",
    f"""WITH RECURSIVE {SCORES}, {threshold_sql('higher', 0.05)}, test AS (SELECT * FROM scores WHERE part = 'test'),
c AS ({COUNTS.format(t='(SELECT threshold FROM locked)')} FROM test),
kn AS (SELECT 'calibration' AS part, (SELECT fp FROM cand, locked WHERE cand.score = locked.threshold)::BIGINT AS k, (SELECT count(*) FROM neg)::BIGINT AS n UNION ALL SELECT 'test', false_positives, n_negative FROM c),
bis AS (SELECT part, k, n, k::DOUBLE / n AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM kn
UNION ALL SELECT part, k, n, CASE WHEN above THEN (lo + hi) / 2 ELSE lo END, CASE WHEN above THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, list_sum([{TERM} FOR j IN range(0, k + 1)]) > 0.05 AS above FROM bis WHERE i < 50)),
b AS (SELECT max(hi) FILTER (part = 'calibration') AS cal, max(hi) FILTER (part = 'test') AS tst FROM bis WHERE i = 50),
w AS (SELECT cal, tst, tpr, [r FOR r IN [CASE WHEN cal > 0.05 THEN '{P.CALIBRATION_BOUND}' END, CASE WHEN tst > 0.05 THEN '{P.TEST_BOUND}' END, CASE WHEN fpr > 0.05 THEN '{P.TEST_FPR}' END] IF r IS NOT NULL] AS reasons FROM b, c)
SELECT round(cal, 7) AS calibration_fpr_upper, round(tst, 7) AS test_fpr_upper, CASE WHEN len(reasons) = 0 THEN tpr END AS tpr_at_target_fpr, array_to_string(reasons, '; ') AS withheld FROM w""",
)
def provenance_detector_bounds(spark, sf_dir):
    rows = scores(spark, sf_dir)
    report = P.detector_report(rows.filter("part = 'test'"), rows.filter("part = 'calibration'"), 0.05, "higher")
    return report.select(
        F.round("calibration_fpr_upper", 7).alias("calibration_fpr_upper"), F.round("test_fpr_upper", 7).alias("test_fpr_upper"),
        "tpr_at_target_fpr", F.concat_ws("; ", "withheld_reasons").alias("withheld"),
    )


@query(
    "provenance_score_violations",
    """WITH s AS (SELECT source AS id, n_chars FROM documents)
SELECT 'duplicate_id' AS rule, count(*)::BIGINT AS broken FROM (SELECT id FROM s GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'bad_label', count(*)::BIGINT FROM s WHERE n_chars < 500 HAVING count(*) > 0""",
)
def provenance_score_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("source").alias("id"),
        F.when(F.col("n_chars") < 500, "unknown").otherwise("negative").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        F.lit("higher").alias("direction"),
        F.lit("length-v1").alias("detector"),
    )
    return P.score_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "provenance_calibration_disjoint",
    f"WITH {SCORES} SELECT count(*)::BIGINT AS shared FROM (SELECT id FROM scores WHERE part = 'test' INTERSECT SELECT id FROM scores WHERE part = 'calibration')",
)
def provenance_calibration_disjoint(spark, sf_dir):
    rows = scores(spark, sf_dir)
    found = P.calibration_violations(rows.filter("part = 'test'"), rows.filter("part = 'calibration'"))
    return found.agg(F.count(F.lit(1)).alias("shared"))


# Each event type is a model and each user a trigger; the answer of a model is
# the parity of its last event, the expected answer that of the user's first event.
ANSWERS = """
answers AS (
  SELECT event_type AS model_id, user_id::VARCHAR AS id,
    (floor(arg_max(value, event_id))::BIGINT % 4)::VARCHAR AS response FROM events GROUP BY 1, 2
),
expected AS (SELECT user_id::VARCHAR AS id, (floor(arg_min(value, event_id))::BIGINT % 4)::VARCHAR AS expected FROM events GROUP BY 1),
triggers AS (SELECT model_id, id, response, expected FROM answers JOIN expected USING (id))"""


def triggers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("string").alias("id"), "event_id", "value"
    )
    def parity(c):
        return (F.floor(c).cast("bigint") % 4).cast("string")

    answers = events.groupBy(F.col("event_type").alias("model_id"), "id").agg(
        parity(F.max_by("value", "event_id")).alias("response")
    )
    expected = events.groupBy("id").agg(parity(F.min_by("value", "event_id")).alias("expected"))
    return answers.join(expected, "id").withColumn("detector", F.lit("trigger-v1"))


@query(
    "provenance_match_rates",
    f"""WITH {ANSWERS} SELECT model_id, count(*)::BIGINT AS n, count(*) FILTER (response = expected)::BIGINT AS matches,
round(count(*) FILTER (response = expected)::DOUBLE / count(*), 9) AS fsr, count(*) FILTER (response = expected)::DOUBLE / count(*) > 0.25 AS flagged FROM triggers GROUP BY 1""",
)
def provenance_match_rates(spark, sf_dir):
    return P.match_rates(triggers(spark, sf_dir), 0.25).withColumn("fsr", F.round("fsr", 9))


@query(
    "provenance_fingerprint_report",
    f"""WITH {ANSWERS}, r AS (SELECT model_id, count(*) AS n, count(*) FILTER (response = expected) AS m FROM triggers GROUP BY 1),
p AS (SELECT count(*) AS negative_models, count(*) FILTER (m::DOUBLE / n > 0.25) AS fp FROM r WHERE model_id <> 'click')
SELECT n::BIGINT AS n, m::BIGINT AS matches, round(m::DOUBLE / n, 9) AS fsr, m::DOUBLE / n > 0.25 AS flagged, negative_models::BIGINT AS negative_models,
 fp::BIGINT AS false_positive_models, fp::DOUBLE / negative_models AS fpr, 1.0 - fp::DOUBLE / negative_models AS uniqueness FROM r, p WHERE model_id = 'click'""",
)
def provenance_fingerprint_report(spark, sf_dir):
    rows = triggers(spark, sf_dir)
    report = P.fingerprint_report(rows.filter("model_id = 'click'"), rows.filter("model_id <> 'click'"), 0.25)
    return report.withColumn("fsr", F.round("fsr", 9)).drop("fpr_upper", "uniqueness_lower")


@query(
    "provenance_trigger_sets",
    f"""WITH {ANSWERS}, s AS (SELECT id, expected FROM triggers WHERE model_id = 'click'),
j AS (SELECT t.model_id, count(*) AS have, count(s.id) AS agree FROM triggers t LEFT JOIN s ON s.id = t.id AND s.expected = t.expected WHERE t.model_id <> 'click' GROUP BY 1)
SELECT count(*)::BIGINT AS models_differing FROM j WHERE have <> (SELECT count(*) FROM s) OR agree <> (SELECT count(*) FROM s)""",
)
def provenance_trigger_sets(spark, sf_dir):
    rows = triggers(spark, sf_dir)
    found = P.trigger_set_violations(rows.filter("model_id = 'click'"), rows.filter("model_id <> 'click'"))
    return found.agg(F.count(F.lit(1)).alias("models_differing"))


@query(
    "provenance_trigger_rules",
    "SELECT 'duplicate_trigger' AS rule, count(*)::BIGINT AS broken FROM (SELECT event_type, user_id FROM events GROUP BY 1, 2 HAVING count(*) > 1)",
)
def provenance_trigger_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_id"),
        F.col("user_id").cast("string").alias("id"),
        F.col("props").alias("response"),
        F.col("props").alias("expected"),
        F.lit("trigger-v1").alias("detector"),
    )
    return P.trigger_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


# Probe answers: option letter from the rounded value, invalid (null) when the
# value is small; the teacher's answer comes from the user's first event.
PROBES = """
letters AS (SELECT event_type AS model, user_id::VARCHAR AS probe_id, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2),
teacher AS (SELECT user_id::VARCHAR AS probe_id, arg_min(value, event_id) AS v FROM events GROUP BY 1),
probes AS (SELECT model, l.probe_id, CASE WHEN l.v >= 2 THEN chr((65 + floor(l.v)::BIGINT % 4)::INTEGER) END AS student_choice,
  CASE WHEN t.v >= 2 THEN chr((65 + floor(t.v)::BIGINT % 4)::INTEGER) END AS teacher_choice FROM letters l JOIN teacher t ON l.probe_id = t.probe_id)"""


def probes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("string").alias("probe_id"), "event_id", "value"
    )

    def letter(c):
        return F.when(c >= 2, F.char(F.floor(c).cast("bigint") % 4 + 65))

    answers = events.groupBy(F.col("event_type").alias("model"), "probe_id").agg(
        letter(F.max_by("value", "event_id")).alias("student_choice")
    )
    teacher = events.groupBy("probe_id").agg(letter(F.min_by("value", "event_id")).alias("teacher_choice"))
    return answers.join(teacher, "probe_id")


@query(
    "provenance_common_probes",
    f"""WITH {PROBES} SELECT probe_id FROM probes GROUP BY 1 HAVING count(*) FILTER (student_choice IS NOT NULL AND teacher_choice IS NOT NULL) = (SELECT count(DISTINCT model) FROM probes)""",
)
def provenance_common_probes(spark, sf_dir):
    return P.common_probes(probes(spark, sf_dir))


@query(
    "provenance_choice_similarity",
    f"""WITH {PROBES}, s AS (SELECT model, count(*) FILTER (student_choice = teacher_choice) AS matches,
 count(*) FILTER (student_choice IS NOT NULL AND teacher_choice IS NOT NULL) AS valid_probes, count(*) AS total_probes FROM probes GROUP BY 1)
SELECT model, matches::BIGINT AS matches, valid_probes::BIGINT AS valid_probes, total_probes::BIGINT AS total_probes,
round(matches::DOUBLE / valid_probes, 9) AS score, round(1.0 - matches::DOUBLE / valid_probes, 9) AS normalized_hamming_distance FROM s""",
)
def provenance_choice_similarity(spark, sf_dir):
    found = P.choice_similarity(probes(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("score", "normalized_hamming_distance")})


@query(
    "provenance_similarity_summary",
    f"""WITH {PROBES}, common AS (SELECT probe_id FROM probes GROUP BY 1 HAVING count(*) FILTER (student_choice IS NOT NULL AND teacher_choice IS NOT NULL) = (SELECT count(DISTINCT model) FROM probes)),
c AS (SELECT model, count(*) AS k, count(*) FILTER (student_choice = teacher_choice)::DOUBLE / count(*) AS score FROM probes JOIN common USING (probe_id) GROUP BY 1),
o AS (SELECT model, count(*) AS total, count(*) FILTER (student_choice IS NOT NULL AND teacher_choice IS NOT NULL) AS v, count(*) FILTER (student_choice = teacher_choice) AS m FROM probes GROUP BY 1)
SELECT model, round(score, 9) AS score, k::BIGINT AS common_valid_probes, round(m::DOUBLE / v, 9) AS individual_score, v::BIGINT AS individual_valid_probes, total::BIGINT AS total_probes,
 round(score - (SELECT score FROM c WHERE model = 'click'), 9) AS difference_from_reference_negative FROM c JOIN o USING (model)""",
)
def provenance_similarity_summary(spark, sf_dir):
    found = P.similarity_summary(probes(spark, sf_dir), "click")
    rounded = ("score", "individual_score", "difference_from_reference_negative")
    return found.withColumns({c: F.round(c, 9) for c in rounded})


@query(
    "provenance_valid_rate_gate",
    f"""WITH {PROBES} SELECT model, round(avg((teacher_choice IS NOT NULL)::INT), 9) AS teacher_valid_rate, round(avg((student_choice IS NOT NULL)::INT), 9) AS student_valid_rate,
least(avg((teacher_choice IS NOT NULL)::INT), avg((student_choice IS NOT NULL)::INT)) >= 0.9 AS passed FROM probes GROUP BY 1""",
)
def provenance_valid_rate_gate(spark, sf_dir):
    found = P.valid_rate_gate(probes(spark, sf_dir), 0.9)
    return found.withColumns({c: F.round(c, 9) for c in ("teacher_valid_rate", "student_valid_rate")})


# Before and after a countermeasure: first and last event of every user, labels
# from whether the user has ever exceeded a high value.
PAIRED = """
pairs AS (SELECT user_id::VARCHAR AS id, CASE WHEN max(value) > 120 THEN 'positive' ELSE 'negative' END AS label,
  arg_min(value, event_id) AS before, arg_max(value, event_id) AS after FROM events GROUP BY 1)"""


def paired(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.when(F.max("value") > 120, "positive").otherwise("negative").alias("label"),
        F.min_by("value", "event_id").alias("before"),
        F.max_by("value", "event_id").alias("after"),
    )
    return [
        per_user.select(
            "id", "label", F.col(side).alias("score"), F.lit("higher").alias("direction"), F.lit("v1").alias("detector")
        )
        for side in ("before", "after")
    ]


@query(
    "retention_detector",
    f"""WITH {PAIRED}, c AS (SELECT count(*) FILTER (label = 'positive') AS np, count(*) FILTER (label = 'negative') AS nn,
 count(*) FILTER (label = 'positive' AND before > 20) AS btp, count(*) FILTER (label = 'positive' AND after > 20) AS atp,
 count(*) FILTER (label = 'negative' AND before > 20) AS bfp, count(*) FILTER (label = 'negative' AND after > 20) AS afp FROM pairs),
a AS (SELECT sum(CASE WHEN p.before > n.before THEN 1.0 WHEN p.before = n.before THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS b,
 sum(CASE WHEN p.after > n.after THEN 1.0 WHEN p.after = n.after THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS f
 FROM pairs p, pairs n WHERE p.label = 'positive' AND n.label = 'negative')
SELECT np::BIGINT AS n_positive, nn::BIGINT AS n_negative, btp::BIGINT AS before_true_positives, atp::BIGINT AS after_true_positives,
 bfp::BIGINT AS before_false_positives, afp::BIGINT AS after_false_positives, round(btp::DOUBLE / np, 9) AS before, round(atp::DOUBLE / np, 9) AS after,
 round((btp - atp)::DOUBLE / np, 9) AS signal_loss, round(CASE WHEN btp > 0 THEN atp::DOUBLE / btp END, 9) AS retention_ratio, round(1.0 - atp::DOUBLE / np, 9) AS evasion_rate,
 round(a.b, 9) AS before_roc_auc, round(a.f, 9) AS after_roc_auc FROM c, a""",
)
def retention_detector(spark, sf_dir):
    before, after = paired(spark, sf_dir)
    found = R.detector_retention(before, after, 20.0, 0.05, "higher", validated=True)
    rates = ("before", "after", "signal_loss", "retention_ratio", "evasion_rate", "before_roc_auc", "after_roc_auc")
    return found.select(
        F.col("before_n_positive").alias("n_positive"), F.col("before_n_negative").alias("n_negative"),
        "before_true_positives", "after_true_positives", "before_false_positives", "after_false_positives",
        *[F.round(c, 9).alias(c) for c in rates],
    )


@query(
    "retention_pair_rules",
    f"""WITH {PAIRED} SELECT rule, count(*)::BIGINT AS broken FROM (
 SELECT 'label_differs' AS rule FROM pairs WHERE (before > 100) AND (label <> 'positive') UNION ALL
 SELECT 'missing_after' FROM pairs WHERE after < 1) GROUP BY 1""",
)
def retention_pair_rules(spark, sf_dir):
    before, after = paired(spark, sf_dir)
    relabelled = before.withColumn("label", F.when(F.col("score") > 100, "positive").otherwise(F.col("label")))
    found = R.pair_violations(relabelled, after.filter("score >= 1"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


# Later half of each model's answers is the side after the countermeasure.
@query(
    "retention_fingerprint",
    f"""WITH {ANSWERS}, later AS (SELECT event_type AS model_id, user_id::VARCHAR AS id, (floor(arg_min(value, event_id))::BIGINT % 4)::VARCHAR AS response FROM events GROUP BY 1, 2),
a AS (SELECT model_id, response, expected FROM later JOIN expected USING (id)),
rb AS (SELECT model_id, count(*) AS n, count(*) FILTER (response = expected) AS m FROM triggers GROUP BY 1),
ra AS (SELECT model_id, count(*) AS n, count(*) FILTER (response = expected) AS m FROM a GROUP BY 1),
pb AS (SELECT 1.0 - count(*) FILTER (m::DOUBLE / n > 0.25)::DOUBLE / count(*) AS u FROM rb WHERE model_id <> 'click'),
pa AS (SELECT 1.0 - count(*) FILTER (m::DOUBLE / n > 0.25)::DOUBLE / count(*) AS u FROM ra WHERE model_id <> 'click')
SELECT rb.n::BIGINT AS n, rb.m::BIGINT AS before_matches, ra.m::BIGINT AS after_matches, round(rb.m::DOUBLE / rb.n, 9) AS before, round(ra.m::DOUBLE / ra.n, 9) AS after,
 round(1.0 - ra.m::DOUBLE / ra.n, 9) AS removal_rate, round(pb.u, 9) AS uniqueness_before, round(pa.u, 9) AS uniqueness_after, round(pa.u - pb.u, 9) AS uniqueness_change
FROM rb, ra, pb, pa WHERE rb.model_id = 'click' AND ra.model_id = 'click'""",
)
def retention_fingerprint(spark, sf_dir):
    before = triggers(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    first = events.groupBy(F.col("event_type").alias("model_id"), F.col("user_id").cast("string").alias("id")).agg(
        (F.floor(F.min_by("value", "event_id")).cast("bigint") % 4).cast("string").alias("response")
    )
    after = before.drop("response").join(first, ["model_id", "id"])
    found = R.fingerprint_retention(
        before.filter("model_id = 'click'"), after.filter("model_id = 'click'"),
        before.filter("model_id <> 'click'"), after.filter("model_id <> 'click'"), 0.25,
    )
    rates = ("before", "after", "removal_rate", "uniqueness_before", "uniqueness_after", "uniqueness_change")
    return found.select("n", "before_matches", "after_matches", *[F.round(c, 9).alias(c) for c in rates])


@query(
    "provenance_finalized_scores",
    f"""WITH {SCORES} SELECT 'radioactivity:m' || part AS id, 'm' || part AS model_id, label, CASE WHEN label = 'positive' THEN 'WM' ELSE 'clean' END AS label_raw,
 round(1.0 / score, 12) AS score, 'lower' AS direction, score AS green_score FROM scores""",
)
def provenance_finalized_scores(spark, sf_dir):
    raw = scores(spark, sf_dir).select(
        F.concat(F.lit("m"), "part").alias("student"),
        F.when(F.col("label") == "positive", "WM").otherwise("clean").alias("label"),
        "score",
        (1.0 / F.col("score")).alias("p_value"),
    )
    done = P.finalize_scores(raw, "radioactivity")
    return done.select(
        "id", "model_id", "label", "label_raw", F.round("score", 12).alias("score"), "direction", "green_score"
    )


@query(
    "provenance_hoeffding",
    """WITH m AS (SELECT event_type, avg(value / 500) AS g, count(*) AS n FROM events GROUP BY 1), e AS (SELECT *, greatest(g - 0.03, 0.0) AS x FROM m)
SELECT event_type, n::BIGINT AS n, round(-2.0 * n * x * x, 6) AS log_p_value, round(CASE WHEN x > 0 THEN 2.0 * n * x * x / ln(10.0) ELSE 0.0 END, 6) AS neg_log10_p FROM e""",
)
def provenance_hoeffding(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg(F.col("value") / 500).alias("g"), F.count(F.lit(1)).alias("n")
    )
    scored = means.withColumn("h", hoeffding("g", 0.03, "n"))
    return scored.select(
        "event_type", "n", F.round("h.log_p_value", 6).alias("log_p_value"), F.round("h.neg_log10_p", 6).alias("neg_log10_p")
    )


@query(
    "provenance_low_evidence",
    "SELECT label AS class, count(*)::BIGINT AS outputs, count(*) < 200 AS low_evidence FROM embeddings GROUP BY 1",
)
def provenance_low_evidence(spark, sf_dir):
    counts = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("outputs"))
    return counts.withColumn("low_evidence", P.low_evidence("outputs"))


@query(
    "provenance_probe_rules",
    f"WITH {PROBES} SELECT count(*)::BIGINT AS broken FROM (SELECT probe_id FROM probes GROUP BY 1 HAVING count(DISTINCT coalesce(teacher_choice, '-')) > 1)",
)
def provenance_probe_rules(spark, sf_dir):
    return P.probe_violations(probes(spark, sf_dir)).agg(F.count(F.lit(1)).alias("broken"))
