"""Output quality: repetition, degeneration, length and pairwise judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.ngrams import repeated_shares
from traceaudit.functions.stats import ratio
from traceaudit.functions.text import TOKENIZERS, norm_key, split_words, strip
from traceaudit.operators import rules

SHORT_POLICIES = ("zero", "exclude")
OUTCOMES = ("candidate", "reference", "tie")


def text_violations(df: DataFrame, text: str = "text") -> DataFrame:
    return rules.all_violations(
        [
            rules.row_rules(df, "id", [("missing_text", F.col(text).isNull())]),
            rules.duplicate_rule(df, ["id"], "duplicate_id"),
            rules.non_empty_rule(df, "no_rows"),
        ]
    )


def repetition(
    df: DataFrame,
    text: str,
    ns: Sequence[int] = (2, 3, 4),
    tokenizer: str = "unicode_cjk",
    short_policy: str = "zero",
    by: Sequence[str] = (),
) -> DataFrame:
    """Macro repetition for several n with length statistics; one pass, one aggregate."""
    if short_policy not in SHORT_POLICIES:
        raise ValueError(f"short_policy must be one of {SHORT_POLICIES}")
    if not ns or any(n <= 0 for n in ns):
        raise ValueError("ns must hold positive integers")
    tokens = df.select(*by, TOKENIZERS[tokenizer](text).alias("_tokens"))
    scored = tokens.select(*by, F.size("_tokens").alias("_len"), repeated_shares(F.col("_tokens"), ns).alias("_r"))
    per_n = []
    for n in ns:
        raw = F.col(f"_r.r{n}")
        included = F.coalesce(raw, F.lit(0.0)) if short_policy == "zero" else raw
        per_n += [F.avg(included).alias(f"rep_{n}"), F.count_if(raw.isNull()).alias(f"short_{n}")]
    found = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("_len") == 0).alias("empty_count"),
        F.avg("_len").alias("mean_tokens"),
        F.min("_len").cast("bigint").alias("min_tokens"),
        F.max("_len").cast("bigint").alias("max_tokens"),
        *per_n,
    )
    return found.withColumn("empty_rate", ratio(F.col("empty_count"), F.col("sample_count")))


def degeneration(df: DataFrame, text: str, threshold: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """Share of texts whose worst repetition exceeds a bound; 0.0 (not null) when empty."""
    words = df.select(*by, split_words(norm_key(text)).alias("_w"))
    shares = words.select(*by, F.size("_w").alias("_len"), repeated_shares(F.col("_w"), (2, 3, 4)).alias("_r"))
    scored = shares.select(*by, "_len", *[F.coalesce(f"_r.r{n}", F.lit(0.0)).alias(f"r{n}") for n in (2, 3, 4)])
    worst = F.greatest("r2", "r3", "r4")

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return scored.groupBy(*by).agg(
        mean(F.col("r2")).alias("rep_2"),
        mean(F.col("r3")).alias("rep_3"),
        mean(F.col("r4")).alias("rep_4"),
        mean(F.col("_len")).alias("average_output_length"),
        mean((F.col("_len") == 0).cast("double")).alias("empty_output_ratio"),
        mean((worst > threshold).cast("double")).alias("repetitive_degeneration_ratio"),
    )


def judge_outcome(position: Column, winner: Column) -> Column:
    """Meaning of one judgment: candidate, reference or tie; null when unreadable."""
    position, winner = F.upper(strip(position)), F.upper(strip(winner))
    return (
        F.when(~position.isin("A", "B"), F.lit(None).cast("string"))
        .when(winner == "TIE", "tie")
        .when(winner == position, "candidate")
        .when(winner.isin("A", "B"), "reference")
    )


def reconcile(forward: Column, reverse: Column) -> Column:
    """Outcome of a swapped pair of judgments: disagreement is a tie."""
    return F.when(forward == reverse, forward).otherwise("tie")


def judgments(df: DataFrame) -> DataFrame:
    """Decided pairs from ``forward`` / ``reverse`` structs of (candidate_position, winner)."""
    forward = judge_outcome(F.col("forward.candidate_position"), F.col("forward.winner"))
    reverse = judge_outcome(F.col("reverse.candidate_position"), F.col("reverse.winner"))
    return df.withColumns(
        {"forward_outcome": forward, "reverse_outcome": reverse}
    ).withColumns(
        {
            "outcome": reconcile(F.col("forward_outcome"), F.col("reverse_outcome")),
            "position_consistent": F.col("forward_outcome") == F.col("reverse_outcome"),
        }
    )


def judgment_violations(df: DataFrame) -> DataFrame:
    decided = judgments(df)
    same_side = F.upper(strip("forward.candidate_position")) == F.upper(strip("reverse.candidate_position"))
    return rules.all_violations(
        [
            rules.row_rules(
                decided,
                "id",
                [
                    ("unreadable_forward", F.col("forward_outcome").isNull()),
                    ("unreadable_reverse", F.col("reverse_outcome").isNull()),
                    ("position_not_swapped", same_side),
                ],
            ),
            rules.duplicate_rule(df, ["id"], "duplicate_id"),
            rules.non_empty_rule(df, "no_rows"),
        ]
    )


def output_length(explicit: Column, text: Column, tokenizer: str) -> Column:
    """Explicit length if given, else the token count of the text."""
    return F.coalesce(explicit.cast("bigint"), F.size(TOKENIZERS[tokenizer](text)).cast("bigint"))


def judge_report(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outcome rates per length group and overall (length_group null).

    ``decided`` has outcome, position_consistent and length_group. The overall
    row also carries the length-controlled rate: the unweighted mean of the
    tie-adjusted rates of the non-empty groups.
    """

    def wins(which: str) -> Column:
        return F.count_if(F.col("outcome") == which)

    sets = [[*by, "length_group"], [*by]]
    rolled = decided.groupingSets([[F.col(c) for c in s] for s in sets], *by, "length_group").agg(
        F.grouping("length_group").alias("_overall"),
        F.count(F.lit(1)).alias("n"),
        wins("candidate").alias("candidate_wins"),
        wins("reference").alias("reference_wins"),
        wins("tie").alias("ties"),
        F.count_if("position_consistent").alias("position_consistent_count"),
        F.count_if(~F.col("position_consistent")).alias("position_disagreement_ties"),
    )
    n = F.col("n")
    rated = rolled.withColumns(
        {
            "candidate_win_rate": F.col("candidate_wins") / n,
            "candidate_tie_adjusted_win_rate": (F.col("candidate_wins") + 0.5 * F.col("ties")) / n,
            "reference_win_rate": F.col("reference_wins") / n,
            "tie_rate": F.col("ties") / n,
            "candidate_non_tie_win_rate": ratio(F.col("candidate_wins"), F.col("candidate_wins") + F.col("reference_wins")),
            "position_consistency_rate": F.col("position_consistent_count") / n,
        }
    )
    return rated


def length_controlled(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the tie-adjusted win rates over the non-empty length groups."""
    return report.filter("_overall = 0").groupBy(*by).agg(
        F.avg("candidate_tie_adjusted_win_rate").alias("length_controlled_candidate_win_rate")
    )
