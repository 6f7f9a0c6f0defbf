"""Teacher and student agreement: choices, texts and perplexities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.hashing import prompt_signature
from traceaudit.functions.stats import safe_exp
from traceaudit.functions.text import norm_key, rouge_l, rouge_l_keys, strip
from traceaudit.operators import rules
from traceaudit.operators.capability import rate_rollup
from traceaudit.operators.combine import beside

# Tasks scored per continuation byte, and tasks without choices.
LENGTH_NORMALIZED_TASKS = ("arc_challenge", "hellaswag")
GENERATION_TASKS = ("gsm8k",)
SAMPLE_KEY = ("task", "doc_id", "filter", "signature")
NO_SIGNAL = {
    "overflow": "At least one perplexity overflowed the finite JSON range.",
    "tokenizer": "The two PPL directions use different tokenizer vocabularies.",
}


def choose(scores: Column, continuations: Column | None = None) -> Column:
    """Index of the best candidate, the first maximum winning.

    With continuations, scores are divided by their UTF-8 byte lengths (at
    least one byte).
    """
    if continuations is not None:
        scores = F.zip_with(scores, continuations, lambda s, c: s / F.greatest(F.lit(1), F.octet_length(c)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")


def is_length_normalized(task: Column) -> Column:
    return F.coalesce(*[F.when(task.startswith(t), True) for t in LENGTH_NORMALIZED_TASKS], F.lit(False))


def sample_predictions(samples: DataFrame) -> DataFrame:
    """Choice per evaluation sample ``(task, doc_id, filter, prompt_hash, arguments, scores, continuations)``."""
    chosen = F.when(
        is_length_normalized(F.col("task")), choose(F.col("scores"), F.col("continuations"))
    ).otherwise(choose(F.col("scores")))
    generative = F.coalesce(*[F.when(F.col("task").startswith(t), True) for t in GENERATION_TASKS], F.lit(False))
    return samples.filter(~generative).select(
        "task",
        F.col("doc_id").cast("string").alias("doc_id"),
        F.coalesce("filter", F.lit("none")).alias("filter"),
        prompt_signature("prompt_hash", "arguments").alias("signature"),
        chosen.alias("prediction"),
    )


def agreement(
    teacher: DataFrame, student: DataFrame, keys: Sequence[str] = SAMPLE_KEY, task: str = "task", allow_partial: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Agreement overall (task null) and per task, and the coverage counts of the two sides.

    Strict mode refuses sides with different keys; partial mode rates the
    intersection. Both readings come from one full outer join.
    """
    keys = list(keys)
    left = teacher.select(*keys, F.col("prediction").alias("_t"), F.lit(True).alias("_has_t"))
    right = student.select(*keys, F.col("prediction").alias("_s"), F.lit(True).alias("_has_s"))
    both = left.join(right, keys, "full_outer")
    coverage = both.agg(
        F.count_if(F.col("_has_s").isNull()).alias("teacher_only"),
        F.count_if(F.col("_has_t").isNull()).alias("student_only"),
        F.count_if(F.col("_has_t") & F.col("_has_s")).alias("n"),
    )
    if not allow_partial:
        rules.enforce(
            rules.row_rules(
                coverage,
                F.lit("samples"),
                [
                    ("sample_sets_differ", (F.col("teacher_only") > 0) | (F.col("student_only") > 0),
                     F.format_string("teacher_only=%d, student_only=%d", "teacher_only", "student_only")),
                    ("no_matching_samples", F.col("n") == 0),
                ],
            ),
            "agreement",
        )
    matched = both.filter(F.col("_has_t") & F.col("_has_s")).select(
        F.col(task).alias("task"), F.col("_t").eqNullSafe(F.col("_s")).alias("ok")
    )
    return rate_rollup(matched, "task", "ok", "agreement_rate", "matched"), coverage


def sample_violations(predictions: DataFrame, keys: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    return rules.duplicate_rule(predictions, list(keys), "duplicate_sample")


def text_pair_violations(pairs: DataFrame, require_prompt: bool = False) -> DataFrame:
    """Rules of text pairs ``(id, prompt, teacher_text, student_text)``."""
    checks = [
        ("missing_teacher_text", F.col("teacher_text").isNull()),
        ("missing_student_text", F.col("student_text").isNull()),
    ]
    if require_prompt:
        checks.append(("blank_prompt", F.coalesce(strip("prompt"), F.lit("")) == ""))
    return rules.all_violations(
        [
            rules.row_rules(pairs, "id", checks),
            rules.duplicate_rule(pairs, ["id"], "duplicate_id"),
            rules.non_empty_rule(pairs, "no_rows"),
        ]
    )


def aligned_violations(pairs: DataFrame, other: DataFrame, fields: Sequence[str] = ("prompt", "teacher_text")) -> DataFrame:
    """Two pair tables must hold the same ids with the same prompt and reference text."""
    left = pairs.select("id", *[F.col(c).alias(f"_l_{c}") for c in fields], F.lit(True).alias("_l"))
    right = other.select("id", *[F.col(c).alias(f"_r_{c}") for c in fields], F.lit(True).alias("_r"))
    both = left.join(right, "id", "full_outer")
    present = F.col("_l") & F.col("_r")
    return rules.row_rules(
        both,
        "id",
        [("only_first", F.col("_r").isNull()), ("only_second", F.col("_l").isNull())]
        + [(f"{c}_differs", present & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))) for c in fields],
    )


def reference_violations(prompts: DataFrame, teacher: DataFrame) -> DataFrame:
    """Every prompt needs a teacher row with the same prompt and a non-blank answer."""
    right = teacher.select("id", F.col("prompt").alias("_p"), F.col("response").alias("_a"), F.lit(True).alias("_has"))
    joined = prompts.select("id", "prompt").join(right, "id", "left")
    has = F.col("_has").isNotNull()
    return rules.row_rules(
        joined,
        "id",
        [
            ("missing_teacher", ~has),
            ("prompt_differs", has & ~F.col("prompt").eqNullSafe(F.col("_p"))),
            ("blank_answer", has & (F.coalesce(strip("_a"), F.lit("")) == "")),
        ],
    )


def rouge_report(pairs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Mean ROUGE-L of student texts, with the floor of a base model if given."""
    score = F.avg(rouge_l("student_text", "teacher_text"))
    report = pairs.agg(score.alias("rouge_l_f1"), F.count(F.lit(1)).alias("n"))
    if base is None:
        return report
    floor = base.agg(score.alias("base_rouge_l_f1"))
    return beside(report, floor).withColumn("gain_over_base", F.col("rouge_l_f1") - F.col("base_rouge_l_f1"))


def heldout_fidelity(pairs: DataFrame) -> DataFrame:
    """Normalised equality rate and mean ROUGE-L on comparison-key words; zeros when empty."""
    equal = norm_key("teacher_text") == norm_key("student_text")
    report = pairs.select(equal.alias("eq"), rouge_l_keys("student_text", "teacher_text").alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("eq").cast("double")).alias("a"), F.avg("r").alias("r")
    )
    return report.select("n", F.coalesce("a", F.lit(0.0)).alias("agreement_rate"), F.coalesce("r", F.lit(0.0)).alias("rouge_l"))


def normalised_agreement(pairs: DataFrame) -> DataFrame:
    marked = pairs.select((norm_key("teacher_text") == norm_key("student_text")).alias("same"))
    return marked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("equal"), F.avg(F.col("same").cast("double")).alias("agreement_rate")
    )


def perplexity_report(df: DataFrame, by: Sequence[str] = (), nll: str = "mean_nll", tokens: str = "scored_tokens") -> DataFrame:
    """Token-weighted corpus perplexity and the macro mean of finite per-text values."""
    sums = df.groupBy(*by).agg(
        F.sum(F.col(nll) * F.col(tokens)).alias("_nll"),
        F.sum(tokens).alias("scored_token_count"),
        F.count(F.lit(1)).alias("scored_text_count"),
        F.avg(safe_exp(nll)).alias("macro_mean_perplexity"),
    )
    mean = F.when(F.col("scored_token_count") > 0, F.col("_nll") / F.col("scored_token_count"))
    return sums.withColumns({"corpus_mean_nll": mean, "corpus_perplexity": safe_exp(mean)}).drop("_nll")


def cross_perplexity(left: Column, right: Column, left_tokenizer: Column, right_tokenizer: Column) -> Column:
    """Geometric mean of the two directions, or why there is none."""
    overflow, same = left.isNull() | right.isNull(), left_tokenizer.eqNullSafe(right_tokenizer)
    return F.struct(
        F.when(~overflow & same, F.sqrt(left * right)).alias("value"),
        F.when(overflow, NO_SIGNAL["overflow"]).when(~same, NO_SIGNAL["tokenizer"]).alias("reason"),
    )


def score_mask(offsets: Column, boundary: Column) -> Column:
    """Which tokens are scored: those that start at or after the boundary and are not empty."""
    return F.transform(offsets, lambda o: (o["start"] >= boundary) & (o["end"] > o["start"]))


def boundary_violations(df: DataFrame, key: str, offsets: str, boundary: str) -> DataFrame:
    """Splits that cut a token in two, and texts with nothing to score."""
    cut = F.exists(offsets, lambda o: (o["start"] < F.col(boundary)) & (F.col(boundary) < o["end"]))
    nothing = ~F.exists(score_mask(F.col(offsets), F.col(boundary)), lambda m: m)
    return rules.row_rules(df, key, [("boundary_splits_token", cut), ("nothing_to_score", nothing)])


def score_pairs(pairs: DataFrame, scorer, schema: str) -> DataFrame:
    """Hook for external text scorers: ``scorer`` maps Arrow batches to Arrow batches."""
    return pairs.mapInArrow(scorer, schema)


def with_empty_rules(score: Column, candidate: Column, reference: Column) -> Column:
    """External scores with the fixed rules for blank texts: both blank 1, one blank 0."""
    blank_c, blank_r = strip(candidate) == "", strip(reference) == ""
    return F.when(blank_c & blank_r, 1.0).when(blank_c | blank_r, 0.0).otherwise(score)
