"""What a countermeasure leaves of a detector, at a threshold locked beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.stats import binom_upper
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.provenance import (
    auc_from_counts,
    detector_counts,
    match_rates,
    negative_pool,
    oriented,
    reasons,
)

# Reasons for withholding the fixed-FPR retention.
NOT_VALIDATED = "Frozen M4 report did not validate its fixed-FPR headline"
BOUND_REASON = "{stage} FPR upper confidence bound exceeds target_fpr"
FPR_REASON = "{stage} actual FPR exceeds target_fpr"


def pair_violations(before: DataFrame, after: DataFrame, same: tuple[str, ...] = ("label", "detector", "direction")) -> DataFrame:
    """Ids on one side only, and attributes that differ between the sides."""
    left = before.select("id", *[F.col(c).alias(f"b_{c}") for c in same], F.lit(True).alias("_b"))
    right = after.select("id", *[F.col(c).alias(f"a_{c}") for c in same], F.lit(True).alias("_a"))
    both = left.join(right, "id", "full_outer")
    present = F.col("_b") & F.col("_a")
    return rules.row_rules(
        both,
        "id",
        [("missing_after", F.col("_a").isNull()), ("missing_before", F.col("_b").isNull())]
        + [(f"{c}_differs", present & ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))) for c in same],
    )


def retained(before: Column, after: Column, complement: str) -> list[Column]:
    """Loss, ratio (null when nothing was there before) and the complement of the rate after."""
    return [
        before.alias("before"),
        after.alias("after"),
        (before - after).alias("signal_loss"),
        F.when(before != 0, after / before).alias("retention_ratio"),
        (1.0 - after).alias(complement),
    ]


def detector_retention(
    before: DataFrame,
    after: DataFrame,
    threshold: float,
    target_fpr: float,
    direction: str,
    validated: bool,
    confidence: float = 0.95,
) -> DataFrame:
    """One row comparing the same samples before and after a countermeasure."""
    stages = before.select(F.lit("before").alias("stage"), "label", "score").unionByName(
        after.select(F.lit("after").alias("stage"), "label", "score")
    )
    counts = detector_counts(stages, threshold, direction, by=["stage"])
    bounded = counts.withColumn("fpr_upper", binom_upper("false_positives", "n_negative", confidence))
    per_score = stages.groupBy("stage", oriented("score", direction).alias("value")).agg(
        F.count_if(F.col("label") == "positive").alias("pos"), F.count_if(F.col("label") != "positive").alias("neg")
    )
    scores = stages.select(oriented("score", direction).alias("value"))
    auc = auc_from_counts(per_score, by=["stage"], sample_of=scores).select("stage", "roc_auc")
    fields = ("tpr", "fpr", "fpr_upper", "roc_auc", "n", "n_positive", "n_negative", "true_positives", "false_positives")
    wide = bounded.join(auc, "stage").agg(
        *[F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}") for s in ("before", "after") for c in fields]
    )
    withheld = reasons(
        (F.lit(not validated), NOT_VALIDATED),
        (F.col("before_fpr_upper") > target_fpr, BOUND_REASON.format(stage="Before")),
        (F.col("after_fpr_upper") > target_fpr, BOUND_REASON.format(stage="After")),
        (F.col("before_fpr") > target_fpr, FPR_REASON.format(stage="Before")),
        (F.col("after_fpr") > target_fpr, FPR_REASON.format(stage="After")),
    )
    report = wide.select(
        "*", *retained(F.col("before_tpr"), F.col("after_tpr"), "evasion_rate"), withheld.alias("withheld_reasons")
    )
    available = F.size("withheld_reasons") == 0
    return report.withColumn("fixed_fpr_available", available).withColumn(
        "fixed_fpr_retention_ratio", F.when(available, F.col("retention_ratio"))
    )


def fingerprint_retention(
    before: DataFrame,
    after: DataFrame,
    negatives_before: DataFrame,
    negatives_after: DataFrame,
    threshold: float,
    confidence: float = 0.95,
) -> DataFrame:
    """One row: match rate of the suspect and uniqueness of the pool on both sides."""
    sides = []
    for stage, ours, pool in (("before", before, negatives_before), ("after", after, negatives_after)):
        rate = match_rates(ours.withColumn("model_id", F.lit("suspect")), threshold)
        sides.append(
            rate.select(
                F.col("fsr").alias(f"{stage}_fsr"),
                F.col("matches").alias(f"{stage}_matches"),
                F.col("flagged").alias(f"flagged_{stage}"),
                *([F.col("n")] if stage == "before" else []),
            )
        )
        snapshot = negative_pool(pool, threshold, confidence)
        sides.append(
            snapshot.select(
                F.col("uniqueness").alias(f"uniqueness_{stage}"),
                F.col("uniqueness_lower").alias(f"uniqueness_lower_{stage}"),
                F.col("false_positive_models").alias(f"false_positive_models_{stage}"),
            )
        )
    return beside(*sides).select(
        "*",
        *retained(F.col("before_fsr"), F.col("after_fsr"), "removal_rate"),
        (F.col("uniqueness_after") - F.col("uniqueness_before")).alias("uniqueness_change"),
    )
