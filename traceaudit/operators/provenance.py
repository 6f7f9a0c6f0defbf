"""Ownership evidence: detector thresholds, ROC, fingerprints and probe similarity.

Thresholds here are strict (score beyond threshold). The monitoring family uses
inclusive thresholds and shares no helper with this one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.parsing import probe_choice
from traceaudit.functions.stats import binom_upper, ratio
from traceaudit.functions.text import as_column, strip
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.ordering import running_totals

LABELS = ("positive", "negative")
DIRECTIONS = ("higher", "lower")

# Label spellings, and the score direction each detector implies.
POSITIVE_ALIASES = (
    "positive", "pos", "1", "true", "watermarked", "wm", "radioactive", "defended",
    "ads", "adfp", "duffin", "mmd", "prada", "seat",
)
NEGATIVE_ALIASES = ("negative", "neg", "0", "false", "clean", "baseline", "unwatermarked", "bare_base", "none")
DETECTOR_DIRECTION = {
    "adfp": "higher", "duffin": "higher", "ginsew": "higher", "mmd": "higher",
    "prada": "higher", "radioactivity": "lower", "seat": "higher",
}
# Reasons for withholding a headline rate.
NEEDS_CALIBRATION = "A separate negative calibration set is required"
CALIBRATION_BOUND = "Calibration FPR upper confidence bound exceeds target_fpr"
TEST_BOUND = "Test FPR upper confidence bound exceeds target_fpr"
TEST_FPR = "Test FPR exceeds target_fpr at the locked threshold"
LOW_EVIDENCE_SAMPLES = 200


def check_direction(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError("direction must be 'higher' or 'lower'")


def beyond(score: Column, threshold: Column, direction: str) -> Column:
    return score > threshold if direction == "higher" else score < threshold


def oriented(score: Column | str, direction: str) -> Column:
    score = as_column(score)
    return score if direction == "higher" else -score


def reasons(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in checks]), lambda r: r.isNotNull())


def score_violations(df: DataFrame) -> DataFrame:
    """Rules of detector-score rows ``(id, label, score, direction, detector)``."""
    row = rules.row_rules(
        df,
        "id",
        [
            ("missing_id", F.col("id").isNull()),
            ("bad_label", ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), F.col("label")),
            ("bad_direction", ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), F.col("direction")),
            ("missing_detector", F.coalesce(strip("detector"), F.lit("")) == ""),
            ("score_not_finite", ~finite("score"), F.col("score")),
        ],
    )
    return rules.all_violations(
        [
            row,
            rules.duplicate_rule(df, ["id"], "duplicate_id"),
            rules.single_value_rule(df, "direction", "mixed_direction"),
            rules.single_value_rule(df, "detector", "mixed_detector"),
            rules.non_empty_rule(df, "no_rows"),
        ]
    )


def finite(column: Column | str) -> Column:
    value = as_column(column).cast("double")
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def score_counts(df: DataFrame, direction: str, positive: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct oriented score (combines before the shuffle)."""
    check_direction(direction)
    is_positive = F.col("label") == "positive" if positive is None else positive
    return df.groupBy(oriented("score", direction).alias("value")).agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg")
    )


def calibrate(negatives: DataFrame, target_fpr: float, direction: str) -> DataFrame:
    """Least strict observed threshold whose exceedance rate is within the target.

    Exceedances of every distinct score come from one running total from the
    top, so no candidate is checked against all scores.
    """
    check_direction(direction)
    if not 0.0 <= target_fpr < 1.0:
        raise ValueError("target_fpr must lie in [0, 1)")
    scores = negatives.select(oriented("score", direction).alias("value"))
    counts = scores.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    above = running_totals(counts, "value", {"n": "at_or_above"}, descending=True, sample_of=scores)
    total = scores.agg(F.count(F.lit(1)).alias("n_negative"))
    candidates = above.select("value", (F.col("at_or_above") - F.col("n")).alias("beyond"))
    best = beside(candidates, total).filter(F.col("beyond") / F.col("n_negative") <= target_fpr).agg(
        F.min(F.struct("value", "beyond", "n_negative")).alias("b")
    )
    return best.select(
        oriented(F.col("b.value"), direction).alias("threshold"),
        F.col("b.beyond").alias("false_positives"),
        F.col("b.n_negative").alias("n_negative"),
        (F.col("b.beyond") / F.col("b.n_negative")).alias("fpr"),
    )


def auc_from_counts(counts: DataFrame, by: Sequence[str] = (), sample_of: DataFrame | None = None) -> DataFrame:
    """ROC-AUC by average ranks from per-score counts: ties count one half."""
    ranked = running_totals(
        counts.withColumn("n", F.col("pos") + F.col("neg")), "value", {"n": "upto"}, by=by, sample_of=sample_of
    )
    rank_sum = F.sum(F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2.0))
    sums = ranked.groupBy(*by).agg(rank_sum.alias("rs"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))
    favourable = F.col("rs") - F.col("n_positive") * (F.col("n_positive") + 1) / 2
    pairs = F.col("n_positive") * F.col("n_negative")
    return sums.select(*by, "n_positive", "n_negative", F.when(pairs > 0, favourable / pairs).alias("roc_auc"))


def roc_auc(df: DataFrame, direction: str = "higher", positive: Column | None = None) -> DataFrame:
    scores = df.select(oriented("score", direction).alias("value"))
    return auc_from_counts(score_counts(df, direction, positive), sample_of=scores)


def roc_curve(df: DataFrame) -> DataFrame:
    """TP/FP at +inf, at every distinct score (inclusive) and at -inf."""
    counts = score_counts(df, "higher")
    scores = df.select(F.col("score").alias("value"))
    sums = running_totals(counts, "value", {"pos": "tp", "neg": "fp"}, descending=True, sample_of=scores)
    totals = counts.agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))
    ends = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")),
                F.struct(F.lit(float("-inf")).alias("threshold"), F.col("n_positive").alias("tp"), F.col("n_negative").alias("fp")),
            )
        ).alias("e")
    ).select("e.*")
    points = sums.select(F.col("value").alias("threshold"), "tp", "fp").unionByName(ends)
    return beside(points, totals).select(
        "threshold",
        (F.col("tp") / F.col("n_positive")).alias("tpr"),
        (F.col("fp") / F.col("n_negative")).alias("fpr"),
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
    )


def detector_counts(df: DataFrame, threshold: float | Column, direction: str, by: Sequence[str] = ()) -> DataFrame:
    """Strict true and false positives at a fixed threshold."""
    check_direction(direction)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, positive = beyond(F.col("score"), limit, direction), F.col("label") == "positive"
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(~positive).alias("n_negative"),
        F.count_if(positive & hit).alias("true_positives"),
        F.count_if(~positive & hit).alias("false_positives"),
    )
    return counted.withColumns(
        {
            "tpr": ratio(F.col("true_positives"), F.col("n_positive")),
            "fpr": ratio(F.col("false_positives"), F.col("n_negative")),
        }
    )


def detector_report(
    test: DataFrame, calibration: DataFrame | None, target_fpr: float, direction: str, confidence: float = 0.95
) -> DataFrame:
    """One row: locked threshold, test rates, bounds and the headline or why it is withheld."""
    negatives = test.filter("label = 'negative'") if calibration is None else calibration
    locked = calibrate(negatives, target_fpr, direction).select(
        "threshold",
        F.col("n_negative").alias("calibration_n"),
        F.col("false_positives").alias("calibration_fp"),
        F.col("fpr").alias("calibration_fpr"),
    )
    scored = beside(test.select("label", "score"), locked.select("threshold"))
    counts = detector_counts(scored, F.col("threshold"), direction)
    report = beside(locked, counts, roc_auc(test, direction).select("roc_auc"))
    report = report.withColumns(
        {
            "calibration_fpr_upper": binom_upper("calibration_fp", "calibration_n", confidence),
            "test_fpr_upper": binom_upper("false_positives", "n_negative", confidence),
        }
    )
    withheld = reasons(
        (F.lit(calibration is None), NEEDS_CALIBRATION),
        (F.col("calibration_fpr_upper") > target_fpr, CALIBRATION_BOUND),
        (F.col("test_fpr_upper") > target_fpr, TEST_BOUND),
        (F.col("fpr") > target_fpr, TEST_FPR),
    )
    return report.withColumns(
        {
            "calibration_resolution": 1.0 / F.col("calibration_n"),
            "test_resolution": 1.0 / F.col("n_negative"),
            "withheld_reasons": withheld,
        }
    ).withColumn("tpr_at_target_fpr", F.when(F.size("withheld_reasons") == 0, F.col("tpr")))


def calibration_violations(test: DataFrame, calibration: DataFrame) -> DataFrame:
    """A separate calibration set holds only negatives and shares no id with the test."""
    wrong = rules.row_rules(calibration, "id", [("calibration_not_negative", F.col("label") != "negative")])
    return rules.all_violations([wrong, rules.overlap_rule(test, calibration, ["id"], "calibration_overlap")])


# Fingerprints


def trigger_violations(df: DataFrame) -> DataFrame:
    """Rules of fingerprint rows ``(model_id, id, response, expected, detector)``."""
    row = rules.row_rules(
        df,
        F.concat_ws("/", "model_id", "id"),
        [
            ("missing_id", F.col("id").isNull()),
            ("missing_model", F.coalesce(F.col("model_id"), F.lit("")) == ""),
            ("missing_detector", F.coalesce(strip("detector"), F.lit("")) == ""),
            ("missing_response", F.col("response").isNull()),
            ("missing_expected", F.col("expected").isNull()),
        ],
    )
    return rules.all_violations(
        [
            row,
            rules.duplicate_rule(df, ["model_id", "id"], "duplicate_trigger"),
            rules.single_value_rule(df, "detector", "mixed_detector"),
            rules.non_empty_rule(df, "no_rows"),
        ]
    )


def trigger_set_violations(suspect: DataFrame, negatives: DataFrame) -> DataFrame:
    """Negative models whose triggers or expected answers differ from the suspect's.

    Matching triggers are counted per model and compared with both set sizes;
    the model x trigger grid is never built.
    """
    ours = suspect.select("id", F.col("expected").alias("wanted"))
    matched = negatives.join(ours, "id", "left").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("have"),
        F.count_if(F.col("expected").eqNullSafe(F.col("wanted")) & F.col("wanted").isNotNull()).alias("agree"),
    )
    size = suspect.agg(F.count(F.lit(1)).alias("need"))
    return (
        beside(matched, size)
        .filter("have <> need or agree <> need")
        .select(
            F.lit("trigger_set_differs").alias("rule"),
            F.col("model_id").cast("string").alias("row_key"),
            F.format_string("%d of %d triggers agree, %d rows", "agree", "need", "have").alias("detail"),
        )
    )


def match_rates(df: DataFrame, threshold: float, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Exact-match rate per model and whether it is beyond the threshold."""
    rates = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("response") == F.col("expected")).alias("matches")
    )
    return rates.withColumn("fsr", F.col("matches") / F.col("n")).withColumn("flagged", F.col("fsr") > threshold)


def negative_pool(negatives: DataFrame, threshold: float, confidence: float = 0.95) -> DataFrame:
    """One row: flagged share of the negative models and the uniqueness it implies."""
    pool = match_rates(negatives, threshold).agg(
        F.count(F.lit(1)).alias("negative_models"), F.count_if("flagged").alias("false_positive_models")
    )
    rated = pool.withColumn("fpr", ratio(F.col("false_positive_models"), F.col("negative_models")))
    bounded = rated.withColumn("fpr_upper", binom_upper("false_positive_models", "negative_models", confidence))
    return bounded.withColumns(
        {"uniqueness": 1.0 - F.col("fpr"), "uniqueness_lower": 1.0 - F.col("fpr_upper")}
    )


def fingerprint_report(suspect: DataFrame, negatives: DataFrame, threshold: float, confidence: float = 0.95) -> DataFrame:
    """One row: suspect match rate against the negative pool."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    ours = match_rates(suspect.withColumn("model_id", F.lit("suspect")), threshold)
    return beside(ours.drop("model_id"), negative_pool(negatives, threshold, confidence))


# Choice-similarity probes


def common_probes(answers: DataFrame) -> DataFrame:
    """Probes answered validly by the teacher and by every model.

    ``answers`` has one row per (model, probe). Models are counted once; a
    probe qualifies when all of them answered it.
    """
    models = answers.select("model").distinct().agg(F.count(F.lit(1)).alias("models"))
    valid = F.col("teacher_choice").isNotNull() & F.col("student_choice").isNotNull()
    per_probe = answers.groupBy("probe_id").agg(F.count_if(valid).alias("valid"))
    return beside(per_probe, models).filter("valid = models").select("probe_id")


def probe_violations(answers: DataFrame) -> DataFrame:
    """Teacher answers must agree across models and no (model, probe) may repeat."""
    return rules.all_violations(
        [
            rules.constant_per_group_rule(answers, ["probe_id"], ["teacher_choice"], "teacher_choice_differs"),
            rules.duplicate_rule(answers, ["model", "probe_id"], "duplicate_probe"),
        ]
    )


def choice_similarity(answers: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of equal choices over probes valid for teacher and model."""
    valid = F.col("teacher_choice").isNotNull() & F.col("student_choice").isNotNull()
    counted = answers.groupBy(*by).agg(
        F.count_if(valid & (F.col("teacher_choice") == F.col("student_choice"))).alias("matches"),
        F.count_if(valid).alias("valid_probes"),
        F.count(F.lit(1)).alias("total_probes"),
    )
    return counted.withColumn("score", ratio(F.col("matches"), F.col("valid_probes"))).withColumn(
        "normalized_hamming_distance", 1.0 - F.col("score")
    )


def similarity_summary(answers: DataFrame, reference_negative: str) -> DataFrame:
    """Per model: score on common probes, difference to a reference, own score."""
    shared = choice_similarity(answers.join(common_probes(answers), "probe_id", "left_semi"))
    own = choice_similarity(answers).select(
        "model",
        F.col("score").alias("individual_score"),
        F.col("valid_probes").alias("individual_valid_probes"),
        "total_probes",
    )
    reference = shared.filter(F.col("model") == reference_negative).select(F.col("score").alias("reference_score"))
    scored = shared.select("model", "score", F.col("valid_probes").alias("common_valid_probes"))
    return (
        beside(scored, reference)
        .join(own, "model")
        .withColumn("difference_from_reference_negative", F.col("score") - F.col("reference_score"))
        .drop("reference_score")
    )


def valid_rate_gate(answers: DataFrame, bound: float, by: Sequence[str] = ("model",)) -> DataFrame:
    """Valid-answer rates of teacher and model, and whether the lower one reaches the bound."""
    rates = answers.groupBy(*by).agg(
        F.avg(F.col("teacher_choice").isNotNull().cast("int")).alias("teacher_valid_rate"),
        F.avg(F.col("student_choice").isNotNull().cast("int")).alias("student_valid_rate"),
    )
    return rates.withColumn("passed", F.least("teacher_valid_rate", "student_valid_rate") >= bound)


def cached_answer_violations(cached: DataFrame, response: str, choice: str, ident: str) -> DataFrame:
    """Stored choices that no longer follow from the stored response."""
    return rules.row_rules(
        cached, ident, [("stored_choice_differs", ~F.col(choice).eqNullSafe(probe_choice(response)), F.col(choice))]
    )


# Detector rows


def matrix_label(label: Column | str) -> Column:
    """Map label spellings onto positive / negative; null when unknown."""
    text = F.lower(strip(as_column(label).cast("string")))
    return F.when(text.isin(*POSITIVE_ALIASES), "positive").when(text.isin(*NEGATIVE_ALIASES), "negative")


def resolve_direction(detector: Column, *given: Column) -> Column:
    """First usable direction text, else the detector's own, else higher."""

    def read(c: Column) -> Column:
        text = F.lower(strip(c.cast("string")))
        return F.when(text.contains("lower"), "lower").when(text.contains("higher"), "higher")

    own = F.create_map(*[F.lit(x) for pair in DETECTOR_DIRECTION.items() for x in pair])
    return F.coalesce(*[read(c) for c in given], F.try_element_at(own, detector), F.lit("higher"))


def finalize_scores(df: DataFrame, detector: str, defense_run_id: str | None = None, attack_run_id: str | None = None) -> DataFrame:
    """Stamp ids, label, direction and primary score on raw detector rows.

    Columns read where present: id, model_id, student, student_checkpoint,
    student_outputs, label, score, p_value, green_score, direction,
    score_direction.
    """
    have = set(df.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def text(name: str) -> Column:
        return F.nullif(col(name).cast("string"), F.lit(""))

    model = F.coalesce(*[text(c) for c in ("model_id", "student", "student_checkpoint", "student_outputs")])
    label = matrix_label(col("label"))
    raw = col("label").cast("string")
    changed = raw.isNotNull() & (label.isNull() | (F.lower(strip(raw)) != label))
    score, p_value = col("score", "double").cast("double"), col("p_value", "double").cast("double")
    by_p = F.lit(detector == "radioactivity") & p_value.isNotNull()
    green = F.coalesce(
        col("green_score", "double").cast("double"), F.when(by_p & (F.abs(score - p_value) > 1e-15), score)
    )
    direction = resolve_direction(F.lit(detector), col("direction"), col("score_direction"))
    return df.select(
        *[c for c in df.columns if c not in ("id", "model_id", "label", "label_raw", "score", "p_value", "green_score", "direction", "score_direction", "detector", "defense_run_id", "attack_run_id")],
        F.coalesce(text("id"), F.concat(F.lit(f"{detector}:"), F.coalesce(model, F.lit("None")))).alias("id"),
        model.alias("model_id"),
        F.coalesce(label, raw).alias("label"),
        F.when(changed, raw).alias("label_raw"),
        F.when(by_p, p_value).otherwise(score).alias("score"),
        direction.alias("direction"),
        direction.alias("score_direction"),
        F.lit(detector).alias("detector"),
        F.lit(defense_run_id).cast("string").alias("defense_run_id"),
        F.lit(attack_run_id).cast("string").alias("attack_run_id"),
        p_value.alias("p_value"),
        green.alias("green_score"),
    )


Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a detector: a function from an input table to raw score rows."""

    def add(scorer: Scorer) -> Scorer:
        SCORERS[name] = scorer
        return scorer

    return add


def run_scorer(name: str, df: DataFrame, **identity: str) -> DataFrame:
    """Uniform detector rows of a registered scorer."""
    return finalize_scores(SCORERS[name](df), name, **identity)


def low_evidence(samples: Column | str) -> Column:
    """Warning flag: too few outputs for a stable p-value. The result is kept."""
    return as_column(samples) < LOW_EVIDENCE_SAMPLES
