"""Accuracy roll-ups, failure rates and matrices over prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.hashing import is_scalar, typed_eq
from traceaudit.functions.stats import ratio
from traceaudit.functions.text import strip, word_choice
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.ordering import exact_medians
from traceaudit.operators.provenance import finite
from traceaudit.session import materialise

# Dataset order, task contracts and status words.
DATASET_ORDER = (
    "arc_challenge", "hellaswag", "mmlu", "truthfulqa", "winogrande", "gsm8k",
    "medqa", "pubmedqa", "chemprot", "fomc", "headline", "fpb", "humaneval",
)
DOMAIN_TASKS = ("medqa", "pubmedqa", "chemprot", "fomc", "headline", "fpb")
SUITE_CONTRACT = (
    ("arc_challenge", "acc_norm,none", 25),
    ("hellaswag", "acc_norm,none", 10),
    ("mmlu", "acc,none", 5),
    ("truthfulqa_mc2", "acc,none", 0),
    ("winogrande", "acc,none", 5),
    ("gsm8k", "exact_match,strict-match", 5),
)
CODE_DATASET = "humaneval"
REQUEST_STATUSES = ("completed", "failed", "dry_run")
PARSE_STATUSES = ("success", "failed", "not_applicable", "not_attempted")
RECORD_FIELDS = (
    "run_id", "timestamp_utc", "model_key", "model_id", "model_role", "model_revision",
    "tokenizer_name", "tokenizer_revision", "backend", "endpoint_base_url", "dataset",
    "dataset_source", "dataset_config", "dataset_revision", "split", "example_id",
    "example_index", "prompt_template_id", "prompt_template_version",
    "prompt_rendering_mode", "logical_prompt", "rendered_prompt", "generation_config",
    "raw_response", "parsed_prediction", "normalized_prediction", "gold_answer",
    "normalized_gold_answer", "parse_status", "parser_name", "correct", "request_status",
    "retry_count", "error_type", "error_message", "latency_seconds", "input_tokens",
    "output_tokens", "total_tokens", "split_fallback_used", "requested_split",
)
GENERATION_FIELDS = ("temperature", "top_p", "top_k", "max_tokens", "seed", "repetition_penalty", "stop_sequences")
CODE_FIELDS = (
    "task_id", "canonical_prompt", "generated_completion", "execution_enabled",
    "execution_status", "test_result", "error_trace_if_any",
)
IDENTITY = ("model_key", "dataset", "split", "example_id")


def prediction_violations(df: DataFrame, raw: str = "raw", key: str = "row_key") -> DataFrame:
    """Rules of prediction records held as VARIANT: a field counts as present even when null."""
    record = F.col(raw)

    def has(path: str, fields: Sequence[str]) -> Column:
        keys = F.json_object_keys(F.to_json(record) if not path else F.try_variant_get(record, path, "string"))
        return F.array_except(F.array(*map(F.lit, fields)), F.coalesce(keys, F.array().cast("array<string>")))

    def text(name: str) -> Column:
        return F.try_variant_get(record, f"$.{name}", "string")

    missing, generation = has("", RECORD_FIELDS), has("$.generation_config", GENERATION_FIELDS)
    code = has("", CODE_FIELDS)
    is_object = F.schema_of_variant(F.try_variant_get(record, "$.generation_config", "variant")).startswith("OBJECT")
    return rules.row_rules(
        df,
        key,
        [
            ("missing_fields", F.size(missing) > 0, F.array_join(F.array_sort(missing), ",")),
            ("generation_config_not_object", ~F.coalesce(is_object, F.lit(False))),
            (
                "generation_config_missing_fields",
                F.coalesce(is_object, F.lit(False)) & (F.size(generation) > 0),
                F.array_join(F.array_sort(generation), ","),
            ),
            ("bad_request_status", ~F.coalesce(text("request_status").isin(*REQUEST_STATUSES), F.lit(False))),
            ("bad_parse_status", ~F.coalesce(text("parse_status").isin(*PARSE_STATUSES), F.lit(False))),
            ("failed_parse_with_prediction", (text("parse_status") == "failed") & text("parsed_prediction").isNotNull()),
            (
                "code_record_missing_fields",
                (text("dataset") == CODE_DATASET) & (F.size(code) > 0),
                F.array_join(F.array_sort(code), ","),
            ),
        ],
    )


def score_predictions(df: DataFrame, parse: str = "parse") -> DataFrame:
    """Outcome of a response.

    A failed request is not attempted, a failed parse is wrong, a success is
    compared with the gold answer; code is scored only by execution.
    """
    is_code, done = F.col("dataset") == CODE_DATASET, F.col("request_status") == "completed"
    status = F.when(done, F.col(f"{parse}.status")).otherwise("not_attempted")
    correct = (
        F.when(is_code, F.lit(None).cast("boolean"))
        .when(~done, False)
        .when(status == "success", F.col(f"{parse}.normalized").eqNullSafe(F.col("normalized_gold_answer")))
        .otherwise(False)
    )
    return df.withColumns(
        {
            "parse_status": status,
            "parsed_prediction": F.when(done, F.col(f"{parse}.parsed")),
            "normalized_prediction": F.when(done, F.col(f"{parse}.normalized")),
            "correct": correct,
        }
    )


def latest(df: DataFrame, sequence: str, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Newest record per example: later timestamp text wins, ties go to the later row.

    ``max_by`` combines before the shuffle, so a record that was rewritten very
    often does not pile up in one task.
    """
    order = F.struct(F.coalesce("timestamp_utc", F.lit("")), F.col(sequence))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, "r.*")


def summary(records: DataFrame, by: Sequence[str] = ("model_key", "dataset", "split")) -> DataFrame:
    """Counts, rates and latencies per group; null rates for empty groups.

    The records are read by several branches (counts, medians): pass a stored
    table such as ``materialise(latest(...))``, so each branch scans the two or
    three columns it needs.
    """
    is_code = F.col("dataset") == CODE_DATASET
    latency = F.coalesce("latency_seconds", F.lit(0.0))
    with_latency = records.withColumn("_latency", latency)
    counted = with_latency.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluated_count"),
        F.count_if(F.col("request_status") == "completed").alias("completed_request_count"),
        F.count_if(F.coalesce("correct", F.lit(False))).alias("correct_count"),
        F.count_if(F.col("parse_status") == "failed").alias("parse_failure_count"),
        F.count_if(F.col("request_status") == "failed").alias("failed_request_count"),
        F.count_if(F.col("parse_status") == "success").alias("_extracted"),
        F.bool_or(F.coalesce("execution_enabled", F.lit(False))).alias("_execution"),
        F.bool_or(is_code).alias("_code"),
        F.avg("_latency").alias("mean_latency_seconds"),
    )
    medians = exact_medians(with_latency, "_latency", by, "median_latency_seconds")
    total, code, executed = F.col("evaluated_count"), F.col("_code"), F.col("_execution")
    scored = F.when(code & ~executed, F.col("_extracted")).otherwise(F.col("correct_count"))
    return counted.join(medians, list(by), "left").select(
        *by,
        F.when(code & executed, "pass@1")
        .when(code, "completion_extraction_rate")
        .otherwise("M1 rollout accuracy")
        .alias("metric_name"),
        ratio(scored, total).alias("score"),
        "evaluated_count",
        "completed_request_count",
        "correct_count",
        "parse_failure_count",
        ratio(F.col("parse_failure_count"), total).alias("parse_failure_rate"),
        "failed_request_count",
        ratio(F.col("failed_request_count"), total).alias("failed_request_rate"),
        "mean_latency_seconds",
        "median_latency_seconds",
        F.when(code, F.col("completed_request_count")).alias("generated_completion_count"),
        F.when(code, F.col("_extracted")).alias("completion_extraction_success_count"),
        F.when(code, executed).alias("code_execution_enabled"),
    )


def per_model(records: DataFrame) -> DataFrame:
    """Attempt counts per model; no score is averaged over datasets."""
    return records.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("attempted_count"),
        F.count_if(F.col("request_status") == "completed").alias("completed_request_count"),
        F.count_if(F.col("request_status") == "failed").alias("request_failure_count"),
        F.count_if(F.col("parse_status") == "failed").alias("parse_failure_count"),
        F.avg(F.coalesce("latency_seconds", F.lit(0.0))).alias("mean_latency_seconds"),
    )


def dense_grid(cells: DataFrame, models: DataFrame, tasks: Sequence[str] = DATASET_ORDER) -> DataFrame:
    """Every model with every task; absent cells have null rates and zero counts.

    Tasks are a fixed list, so each model row is expanded in place.
    """
    grid = models.select("model_key").distinct().withColumn("dataset", F.explode(F.array(*map(F.lit, tasks))))
    zero = {c: 0 for c in cells.columns if c.endswith("_count") and c not in ("generated_completion_count", "completion_extraction_success_count")}
    filled = grid.join(cells, ["model_key", "dataset"], "left").fillna(zero)
    default = F.when(F.col("dataset") == CODE_DATASET, "pass@1").otherwise("M1 rollout accuracy")
    return filled.withColumn("metric_name", F.coalesce("metric_name", default))


def matrix(cells: DataFrame, tasks: Sequence[str] = DATASET_ORDER) -> DataFrame:
    """Model x dataset scores in the fixed dataset order."""
    return cells.groupBy("model_key").pivot("dataset", list(tasks)).agg(F.first("score"))


def tables(records: DataFrame, sequence: str, models: DataFrame) -> dict[str, DataFrame]:
    """All summary tables of a run over its newest records."""
    newest = materialise(latest(records, sequence))
    cells = summary(newest, ("model_key", "dataset"))
    grid = dense_grid(cells, models)
    return {
        "per_dataset": summary(newest),
        "per_model": models.select("model_key").distinct().join(per_model(newest), "model_key", "left").fillna(0, ["attempted_count", "completed_request_count", "request_failure_count", "parse_failure_count"]),
        "matrix_long": grid,
        "overall_matrix": matrix(grid),
        "parse_failures": newest.filter("parse_status = 'failed'"),
        "request_failures": newest.filter("request_status = 'failed'"),
        "latency": newest.select(*IDENTITY, "latency_seconds", "input_tokens", "output_tokens", "total_tokens"),
    }


def run_counts(records: DataFrame, sequence: str) -> DataFrame:
    """The counts of a run summary, as one row."""
    return latest(records, sequence).agg(
        F.count(F.lit(1)).alias("prediction_records"),
        F.count_if(F.col("request_status") == "failed").alias("request_failures"),
        F.count_if(F.col("parse_status") == "failed").alias("parse_failures"),
    )


def run_markdown(counts: DataFrame, run_id: str, mode: str, status: str, unavailable: int) -> DataFrame:
    """Markdown of a run summary as a one-row text table."""
    title = {"pilot": "M1 Pilot Report", "dry-run": "M1 Dry Run Report"}.get(mode, "M1 Preflight Smoke Report")
    fields = [
        ("Run ID", F.lit(f"`{run_id}`")),
        ("Status", F.lit(f"`{status}`")),
        ("Prediction records", F.col("prediction_records").cast("string")),
        ("Request failures", F.col("request_failures").cast("string")),
        ("Parse failures", F.col("parse_failures").cast("string")),
        ("Datasets with unavailable requested splits", F.lit(str(unavailable))),
    ]
    bullets = [F.concat(F.lit(f"- {name}: "), value) for name, value in fields]
    note = F.lit("These are pipeline-validation artifacts, not final benchmark results.")
    return counts.select(F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *bullets, F.lit(""), note, F.lit("")).alias("value"))


# Accuracy reports


def accuracy_violations(df: DataFrame, prediction: str, target: str, task: str, key: Column | str) -> DataFrame:
    return rules.row_rules(
        df,
        key,
        [
            ("blank_task", F.coalesce(strip(task), F.lit("")) == ""),
            ("prediction_not_scalar", ~F.coalesce(is_scalar(prediction), F.lit(False))),
            ("target_not_scalar", ~F.coalesce(is_scalar(target), F.lit(False))),
        ],
    )


def accuracy(df: DataFrame, prediction: str = "prediction", target: str = "target", task: str = "task") -> DataFrame:
    """Micro accuracy overall (task null) and per task, with typed equality of VARIANT labels."""
    matched = df.select(F.col(task).alias("task"), typed_eq(prediction, target).alias("ok"))
    return rate_rollup(matched, "task", "ok", "accuracy", "correct")


def rate_rollup(df: DataFrame, by: str, flag: str, rate: str, hits: str) -> DataFrame:
    """Share of true flags per group plus the overall row (group null)."""
    rolled = df.rollup(by).agg(
        F.grouping(by).alias("_g"),
        F.count_if(F.coalesce(flag, F.lit(False))).alias(hits),
        F.count(F.lit(1)).alias("n"),
    )
    return rolled.select(
        F.when(F.col("_g") == 0, F.col(by)).alias(by), (F.col(hits) / F.col("n")).alias(rate), hits, "n"
    )


def macro_rate(per_task: DataFrame, rate: str, tasks: Sequence[str] | None = None) -> DataFrame:
    """Unweighted mean of the task rates of a rollup."""
    rows = per_task.filter(F.col("task").isNotNull())
    if tasks is not None:
        rows = rows.filter(F.col("task").isin(*tasks))
    return rows.agg(F.avg(rate).alias("macro"), F.count(F.lit(1)).alias("n_tasks"))


def coverage_violations(df: DataFrame, tasks: Sequence[str], column: str = "task") -> DataFrame:
    """Required tasks that are missing, and tasks that were not asked for."""
    observed = df.select(F.col(column).alias("task")).distinct()
    required = df.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    return rules.all_violations(
        [
            rules.missing_keys_rule(required, observed, ["task"], "missing_task"),
            rules.missing_keys_rule(observed, required, ["task"], "extra_task"),
        ]
    )


def domain_report(df: DataFrame, tasks: Sequence[str] = DOMAIN_TASKS) -> DataFrame:
    """One row: micro and macro accuracy over the domain tasks."""
    rates = accuracy(df)
    overall = F.col("task").isNull()
    return rates.agg(
        F.max(F.when(overall, F.col("accuracy"))).alias("domain_micro_accuracy"),
        F.avg(F.when(F.col("task").isin(*tasks), F.col("accuracy"))).alias("domain_macro_accuracy"),
        F.max(F.when(overall, F.col("n"))).alias("n"),
    )


def suite_scores(results: DataFrame, raw: str = "raw") -> DataFrame:
    """Contracted metric and few-shot count per task of nested result documents (VARIANT)."""
    contract = F.explode(
        F.array(*[F.struct(F.lit(t).alias("task"), F.lit(m).alias("metric"), F.lit(k).alias("wanted_shots")) for t, m, k in SUITE_CONTRACT])
    )

    def pick(kind: str, *branches: tuple[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("c.task") == task, path) for task, path in branches])

    record = F.col(raw)
    score = pick("score", *[(t, F.try_variant_get(record, f"$.results.{t}['{m}']", "double")) for t, m, _ in SUITE_CONTRACT])
    shots = pick(
        "shots",
        *[
            (
                t,
                F.coalesce(
                    F.try_variant_get(record, f"$['n-shot'].{t}", "int"),
                    F.try_variant_get(record, f"$.configs.{t}.num_fewshot", "int"),
                ),
            )
            for t, _, _ in SUITE_CONTRACT
        ],
    )
    return results.withColumn("c", contract).select(
        *[c for c in results.columns if c != raw], "c.task", "c.metric", "c.wanted_shots", score.alias("score"), shots.alias("shots")
    )


def suite_violations(scores: DataFrame) -> DataFrame:
    return rules.row_rules(
        scores,
        "task",
        [
            ("missing_metric", F.col("score").isNull(), F.col("metric")),
            ("score_outside_unit_interval", ~F.col("score").between(0.0, 1.0), F.col("score")),
            ("few_shot_differs", ~F.col("shots").eqNullSafe(F.col("wanted_shots")), F.col("shots")),
        ],
    )


def suite_average(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("average"), F.count("score").alias("n_tasks"))


def unit_violations(df: DataFrame, key: Column | str, score: str) -> DataFrame:
    ok = finite(score) & F.col(score).between(0.0, 1.0)
    return rules.row_rules(df, key, [("score_outside_unit_interval", ~F.coalesce(ok, F.lit(False)), F.col(score))])


def macro_accuracy(df: DataFrame, by: Sequence[str], generative_task: str) -> DataFrame:
    """Mean of the task accuracies per group; parse failures count for the generative task only."""
    per_task = df.groupBy(*by, "task").agg(
        F.avg(F.coalesce("correct", F.lit(False)).cast("double")).alias("accuracy"),
        F.count_if((F.col("task") == generative_task) & (F.col("parse_status") == "failed")).alias("failures"),
        F.count(F.lit(1)).alias("examples"),
    )
    return per_task.groupBy(*by).agg(
        F.avg("accuracy").alias("macro_accuracy"),
        F.sum("failures").alias("generative_parse_failures"),
        F.sum("examples").alias("examples"),
    )


def deltas(df: DataFrame, name: str, value: str, base: str, clean: str) -> DataFrame:
    """Gain over the base row and drop from the clean row."""
    anchors = df.agg(
        F.max(F.when(F.col(name) == base, F.col(value))).alias("_base"),
        F.max(F.when(F.col(name) == clean, F.col(value))).alias("_clean"),
    )
    return beside(df, anchors).withColumns(
        {"gain_over_base": F.col(value) - F.col("_base"), "drop_from_clean": F.col("_clean") - F.col(value)}
    ).drop("_base", "_clean")


def heldout_classification(outputs: DataFrame, teacher: str = "teacher") -> DataFrame:
    """Accuracy per system and agreement with the teacher on whole-word choices.

    ``outputs`` has (system, prompt_id, output, choices, label).
    """
    parsed = outputs.select("system", "prompt_id", "label", word_choice("output", F.col("choices")).alias("prediction"))
    reference = parsed.filter(F.col("system") == teacher).select("prompt_id", F.col("prediction").alias("teacher_prediction"))
    joined = parsed.join(reference, "prompt_id", "left")
    counted = joined.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("prediction").eqNullSafe(F.col("label"))).alias("correct"),
        F.count_if(F.col("prediction") == F.col("teacher_prediction")).alias("agreeing"),
    )
    return counted.withColumns(
        {"accuracy": F.col("correct") / F.col("n"), "teacher_agreement": F.col("agreeing") / F.col("n")}
    )


def split_rows(selections: DataFrame) -> DataFrame:
    """One row per dataset from its split selections.

    ``selections`` has (dataset, available_splits, requested_split, status,
    fallback_used, note, selection_order).
    """

    def status(which: str) -> Column:
        found = F.max(F.when(F.col("requested_split") == which, F.col("status")))
        return F.coalesce(found, F.lit("not_requested")).alias(f"{which}_status")

    notes = F.array_sort(F.collect_list(F.struct("selection_order", "note")))["note"]
    return selections.groupBy("dataset").agg(
        F.first(F.array_join("available_splits", "|")).alias("available_splits"),
        status("train"),
        status("validation"),
        F.bool_or("fallback_used").alias("fallback_used"),
        F.array_join(notes, "; ").alias("notes"),
    )
