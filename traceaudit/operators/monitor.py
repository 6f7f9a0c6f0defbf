"""Per-account detection over an ordered query stream (batch side).

Thresholds are inclusive here, unlike in the provenance family.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.stats import binom_upper, ratio
from traceaudit.functions.text import strip
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.ordering import exact_medians, running_totals
from traceaudit.operators.provenance import auc_from_counts, check_direction, finite, oriented, reasons
from traceaudit.session import materialise

LABELS = ("benign", "attacker")
MONITOR_MODES = ("per-account", "global-context")
# Reasons for withholding the fixed-FPR rate.
CALIBRATION_BOUND = "Calibration FPR upper confidence bound exceeds target_fpr"
EVALUATION_BOUND = "Evaluation FPR upper confidence bound exceeds target_fpr"
EVALUATION_FPR = "Evaluation FPR exceeds target_fpr at the locked threshold"
ENTITY_FIELDS = ("label", "attack_type", "detector", "monitor_mode")


def crosses(score: Column, threshold: Column | float, direction: str) -> Column:
    check_direction(direction)
    return score >= threshold if direction == "higher" else score <= threshold


def event_violations(df: DataFrame) -> DataFrame:
    """Row rules of monitoring events; they apply before the budget cut."""
    is_attacker = F.col("label") == "attacker"
    return rules.row_rules(
        df,
        "entity_id",
        [
            ("missing_entity", F.coalesce(F.col("entity_id"), F.lit("")) == ""),
            ("bad_label", ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), F.col("label")),
            ("bad_query_index", F.coalesce(F.col("query_index"), F.lit(0)) < 1, F.col("query_index")),
            ("score_not_finite", ~finite("score"), F.col("score")),
            ("attacker_without_type", is_attacker & (F.coalesce(F.col("attack_type"), F.lit("")) == "")),
            ("missing_detector", F.coalesce(strip("detector"), F.lit("")) == ""),
            ("bad_monitor_mode", ~F.coalesce(F.col("monitor_mode").isin(*MONITOR_MODES), F.lit(False))),
        ],
    )


def within_budget(df: DataFrame, budget: int) -> DataFrame:
    """Events up to the budget; benign events carry no attack type."""
    if budget < 1:
        raise ValueError("budget must be positive")
    typed = F.when(F.col("label") == "attacker", F.col("attack_type"))
    return df.filter(F.col("query_index") <= budget).withColumn("attack_type", typed)


def series_violations(df: DataFrame) -> DataFrame:
    """Indices must be 1..n without repeats and attributes constant per entity.

    Repeats are counted on the (entity, index) pair, whose groups stay small
    even when one entity owns most events; gaps follow from count and maximum.
    """
    per_index = df.groupBy("entity_id", "query_index").agg(F.count(F.lit(1)).alias("n"))
    shape = per_index.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("indices"),
        F.min("query_index").alias("low"),
        F.max("query_index").alias("high"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )
    broken = rules.row_rules(
        shape,
        "entity_id",
        [
            ("duplicate_query_index", F.col("repeated") > 0, F.col("repeated")),
            ("query_index_gap", (F.col("low") != 1) | (F.col("high") != F.col("indices")), F.col("high")),
        ],
    )
    constant = rules.constant_per_group_rule(df, ["entity_id"], ENTITY_FIELDS, "attribute_changes")
    return rules.all_violations(
        [
            broken,
            constant,
            rules.single_value_rule(df, "detector", "mixed_detector"),
            rules.single_value_rule(df, "monitor_mode", "mixed_monitor_mode"),
        ]
    )


def entities(df: DataFrame, direction: str, threshold: float | None = None) -> DataFrame:
    """One row per entity: attributes, horizon, extreme score, first crossing.

    All of it is min/max of numbers in a hash aggregate, so a hot entity
    collapses before the shuffle. The attributes are grouping keys: they are
    constant per entity in a series that passes ``series_violations``.
    """
    check_direction(direction)
    extreme = F.max("score") if direction == "higher" else F.min("score")
    measures = [
        F.max("query_index").alias("observed_until"),
        extreme.alias("score"),
    ]
    if threshold is not None:
        crossed = F.when(crosses(F.col("score"), threshold, direction), F.col("query_index"))
        measures.append(F.min(crossed).alias("queries_to_detection"))
    return df.groupBy("entity_id", "label", "attack_type").agg(*measures)


def first_detection(df: DataFrame, threshold: float, direction: str) -> DataFrame:
    """First inclusive crossing per entity, else censored at its last observation."""
    found = entities(df, direction, threshold)
    missed = F.col("queries_to_detection").isNull()
    return found.withColumns(
        {"censored": missed, "censor_at": F.when(missed, F.col("observed_until"))}
    ).drop("score")


class LockedThreshold(NamedTuple):
    """Threshold with the calibration counts it was chosen from."""

    value: float
    entities: int
    false_positives: int


def entity_threshold(benign: DataFrame, target_fpr: float, direction: str) -> LockedThreshold:
    """Conservative inclusive threshold over benign entity extremes.

    Candidates are the observed extremes and the next float beyond the largest.
    Three numbers come back to the driver; counting stays on the cluster.
    """
    check_direction(direction)
    if not 0.0 <= target_fpr < 1.0:
        raise ValueError("target_fpr must lie in [0, 1)")
    values = benign.select(oriented("score", direction).alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    above = running_totals(counts, "value", {"n": "at_or_above"}, descending=True, sample_of=values)
    total = counts.agg(F.sum("n").alias("total"), F.max("value").alias("top"))
    within = F.col("at_or_above") / F.col("total") <= target_fpr
    best = beside(above, total).agg(
        F.min(F.when(within, F.struct("value", "at_or_above"))).alias("best"),
        F.max("top").alias("top"),
        F.max("total").alias("total"),
    ).first()
    if best["top"] is None:
        raise rules.AuditRuleError("threshold calibration needs benign entities")
    value, hits = best["best"] if best["best"] is not None else (math.nextafter(best["top"], math.inf), 0)
    return LockedThreshold(value if direction == "higher" else -value, best["total"], hits)


def detection_curve(attackers: DataFrame, checkpoints: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Detected share at each checkpoint; one aggregate, then one row per checkpoint."""
    points = sorted(checkpoints)
    if not points or points[0] < 1 or len(set(points)) != len(points):
        raise ValueError("checkpoints must be unique positive integers")
    caught = F.col("queries_to_detection")
    counted = attackers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(caught <= p).alias(f"_p{p}") for p in points]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("queries"), F.col(f"_p{p}").alias("detected")) for p in points]))
    flat = counted.select(*by, "n", rows.alias("r")).select(*by, "r.queries", "r.detected", "n")
    return flat.withColumn("detection_rate", F.col("detected") / F.col("n"))


def type_summary(attackers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detection rate and detected-only mean and median."""
    caught = F.col("queries_to_detection")
    rates = attackers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(caught).alias("detected"),
        F.count_if(caught.isNull()).alias("censored"),
        (F.count(caught) / F.count(F.lit(1))).alias("detection_rate"),
        F.avg(caught).alias("mean_queries"),
    )
    medians = exact_medians(attackers, "queries_to_detection", by, "median_queries")
    return rates.join(medians, list(by), "left") if by else beside(rates, medians)


def horizon_violations(found: DataFrame, budget: int) -> DataFrame:
    """Benign and undetected entities must be observed through the budget."""
    short = F.col("observed_until") < budget
    return rules.row_rules(
        found,
        "entity_id",
        [
            ("benign_not_observed_through_budget", (F.col("label") == "benign") & short, F.col("observed_until")),
            (
                "undetected_not_observed_through_budget",
                (F.col("label") == "attacker") & F.col("queries_to_detection").isNull() & short,
                F.col("observed_until"),
            ),
        ],
    )


def coverage_violations(attackers: DataFrame, required: Sequence[str]) -> DataFrame:
    wanted = attackers.sparkSession.createDataFrame([(t,) for t in required], "attack_type string")
    return rules.missing_keys_rule(wanted, attackers, ["attack_type"], "attack_type_missing")


def monitor_report(
    calibration: DataFrame,
    evaluation: DataFrame,
    target_fpr: float,
    budget: int,
    direction: str = "higher",
    confidence: float = 0.95,
) -> DataFrame:
    """One row: locked threshold, FPR and TPR with bounds, AUC if the horizon is shared.

    The event streams are read once each; everything after that works on the
    stored per-entity tables.
    """
    benign = materialise(entities(within_budget(calibration, budget), direction))
    locked = entity_threshold(benign, target_fpr, direction)
    threshold = locked.value
    found = materialise(entities(within_budget(evaluation, budget), direction, threshold))
    over = crosses(F.col("score"), threshold, direction)
    is_attacker = F.col("label") == "attacker"
    counts = found.agg(
        F.count_if(~is_attacker).alias("benign_entities"),
        F.count_if(is_attacker).alias("attacker_entities"),
        F.count_if(~is_attacker & over).alias("false_positives"),
        F.count_if(is_attacker & F.col("queries_to_detection").isNotNull()).alias("detected"),
        F.count_if(is_attacker & (F.col("observed_until") < budget)).alias("incomplete_attackers"),
    )
    per_score = found.groupBy(oriented("score", direction).alias("value")).agg(
        F.count_if(is_attacker).alias("pos"), F.count_if(~is_attacker).alias("neg")
    )
    known = counts.withColumns(
        {
            "calibration_entities": F.lit(locked.entities).cast("bigint"),
            "calibration_false_positives": F.lit(locked.false_positives).cast("bigint"),
        }
    )
    rows = beside(known, auc_from_counts(per_score).select("roc_auc"))
    rated = rows.withColumns(
        {
            "threshold": F.lit(threshold),
            "calibration_fpr": ratio(F.col("calibration_false_positives"), F.col("calibration_entities")),
            "actual_fpr": ratio(F.col("false_positives"), F.col("benign_entities")),
            "tpr_at_locked_threshold": ratio(F.col("detected"), F.col("attacker_entities")),
            "calibration_fpr_upper": binom_upper("calibration_false_positives", "calibration_entities", confidence),
            "evaluation_fpr_upper": binom_upper("false_positives", "benign_entities", confidence),
            "roc_auc": F.when(F.col("incomplete_attackers") == 0, F.col("roc_auc")),
        }
    )
    withheld = reasons(
        (F.col("calibration_fpr_upper") > target_fpr, CALIBRATION_BOUND),
        (F.col("evaluation_fpr_upper") > target_fpr, EVALUATION_BOUND),
        (F.col("actual_fpr") > target_fpr, EVALUATION_FPR),
    )
    return rated.withColumn("withheld_reasons", withheld).withColumn(
        "tpr_at_fixed_fpr", F.when(F.size("withheld_reasons") == 0, F.col("tpr_at_locked_threshold"))
    )


def batches(positioned: DataFrame, size: int, by: Sequence[str] = (), keep_last: bool = True, position: str = "position") -> DataFrame:
    """Count windows of ``size`` queries in arrival order; optionally only full ones."""
    marked = positioned.withColumn("batch", F.floor((F.col(position) - 1) / F.lit(size)))
    if keep_last:
        return marked
    full = marked.groupBy(*by, "batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).drop("_n")
    return marked.join(full, [*by, "batch"], "left_semi")
