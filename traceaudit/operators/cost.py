"""Itemised costs. Null is unknown and stays unknown; zero is a measured zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.stats import mul_known
from traceaudit.functions.text import strip
from traceaudit.operators import rules
from traceaudit.operators.provenance import finite, reasons

# Billing modes, stages, and the fields of a cost record.
BILLING_MODES = ("none", "unknown", "per_query", "tokens")
STAGES = ("attack", "defense_install", "countermeasure")
COUNT_FIELDS = ("query_count", "input_tokens", "output_tokens", "sample_count", "budget_cap")
AMOUNT_FIELDS = (
    "price_per_query", "input_price_per_million_tokens", "output_price_per_million_tokens", "gpu_hours",
    "gpu_price_per_hour", "wall_clock_hours", "data_cost", "human_cost", "other_cost",
)
PRICE_FIELDS = ("price_per_query", "input_price_per_million_tokens", "output_price_per_million_tokens")
TOKEN_FIELDS = (
    "input_tokens", "output_tokens", "input_price_per_million_tokens", "output_price_per_million_tokens",
)
COMPONENTS = ("api_cost", "gpu_cost", "data_cost", "human_cost", "other_cost")


def _any_set(fields: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields], F.lit(False))


def _any_null(fields: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f).isNull(), True) for f in fields], F.lit(False))


def cost_violations(df: DataFrame) -> DataFrame:
    """Number rules, billing-mode rules and the two-dimension rule."""
    mode = F.col("api_billing")
    numbers = [
        (f"bad_{f}", F.col(f).isNotNull() & ~(finite(f) & (F.col(f) >= 0)), F.col(f)) for f in (*AMOUNT_FIELDS, *COUNT_FIELDS)
    ] + [
        (f"{f}_not_integer", F.col(f).isNotNull() & finite(f) & (F.col(f) != F.floor(f)), F.col(f)) for f in COUNT_FIELDS
    ]
    text = [
        ("missing_id", F.coalesce(F.col("id"), F.lit("")) == ""),
        ("bad_stage", ~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), F.col("stage")),
        ("missing_currency", F.coalesce(F.col("currency"), F.lit("")) == ""),
        ("missing_price_as_of", F.coalesce(strip("price_as_of"), F.lit("")) == ""),
        ("bad_billing_mode", ~F.coalesce(mode.isin(*BILLING_MODES), F.lit(False)), mode),
    ]
    billing = [
        ("price_without_billing", mode.isin("none", "unknown") & _any_set(PRICE_FIELDS)),
        ("per_query_incomplete", (mode == "per_query") & _any_null(("query_count", "price_per_query"))),
        ("per_query_with_token_prices", (mode == "per_query") & _any_set(PRICE_FIELDS[1:])),
        ("tokens_incomplete", (mode == "tokens") & _any_null(TOKEN_FIELDS)),
        ("tokens_with_query_price", (mode == "tokens") & F.col("price_per_query").isNotNull()),
        ("fewer_than_two_dimensions", F.size(reported_dimensions(_components())) < 2),
    ]
    return rules.all_violations(
        [rules.row_rules(df, "id", [*text, *numbers, *billing]), rules.duplicate_rule(df, ["id"], "duplicate_id")]
    )


def _components() -> dict[str, Column]:
    million = 1_000_000.0
    mode = F.col("api_billing")
    tokens = mul_known("input_tokens", "input_price_per_million_tokens", million) + mul_known(
        "output_tokens", "output_price_per_million_tokens", million
    )
    return {
        "api_cost": F.when(mode == "none", 0.0)
        .when(mode == "per_query", mul_known("query_count", "price_per_query"))
        .when(mode == "tokens", tokens),
        "gpu_cost": mul_known("gpu_hours", "gpu_price_per_hour"),
        **{f: F.col(f) for f in ("data_cost", "human_cost", "other_cost")},
    }


def reported_dimensions(components: dict[str, Column]) -> Column:
    return reasons(
        (F.col("query_count").isNotNull(), "queries"),
        (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), "tokens"),
        (F.col("sample_count").isNotNull(), "samples"),
        (F.col("gpu_hours").isNotNull(), "gpu_hours"),
        (F.col("wall_clock_hours").isNotNull(), "wall_clock_hours"),
        (F.coalesce(*components.values()).isNotNull(), "money"),
    )


def cost_records(df: DataFrame) -> DataFrame:
    """Component costs, known subtotal, unknown components and reported dimensions; a narrow projection."""
    components = _components()
    known = [F.coalesce(components[c], F.lit(0.0)) for c in COMPONENTS]
    subtotal = known[0]
    for part in known[1:]:
        subtotal = subtotal + part
    unknown = reasons(*[(components[c].isNull(), c) for c in COMPONENTS])
    kept = [c for c in df.columns if c not in COMPONENTS]
    return df.select(
        *kept,
        *[components[c].alias(c) for c in COMPONENTS],
        subtotal.alias("known_subtotal"),
        unknown.alias("unknown_components"),
        (F.size(unknown) == 0).alias("complete"),
        reported_dimensions(components).alias("reported_cost_dimensions"),
    )


def merge_costs(parts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Sum stage costs (null counts as 0) with distinct models in first-seen order.

    The order of the models comes from their first position, so each model
    travels once per group instead of once per stage row.
    """
    sums = parts.groupBy(*by).agg(
        F.round(F.sum(F.coalesce("wall_seconds", F.lit(0.0))), 3).alias("wall_seconds"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("num_queries", "tokens_generated", "tokens_scored")],
        F.count(F.lit(1)).alias("parts"),
    )
    named = parts.select(*by, F.col(order).alias("_order"), F.posexplode("models").alias("_slot", "_model"))
    firsts = named.groupBy(*by, "_model").agg(F.min(F.struct("_order", "_slot")).alias("_first"))
    models = firsts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "_model"))), lambda m: m["_model"]).alias("models")
    )
    joined = sums.join(models, list(by), "left")
    return joined.withColumn("models", F.coalesce("models", F.array().cast("array<string>")))


def costs_from_runs(runs: DataFrame) -> DataFrame:
    """Cost record of a run from its metrics.

    The query count is the first non-zero of successes, attempts and budget;
    seconds become hours only when they are finite. Nothing else is invented.
    """

    def counted(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(0))

    queries = F.coalesce(counted("successful_queries"), counted("query_attempts"), F.col("budget")).cast("bigint")
    return runs.select(
        F.concat_ws(":", "attack", "run_id", F.lit("attack")).alias("id"),
        F.col("attack").alias("method"),
        F.lit("attack").alias("stage"),
        F.lit("unknown").alias("api_billing"),
        queries.alias("query_count"),
        queries.alias("sample_count"),
        F.when(finite("wall_clock_seconds"), F.col("wall_clock_seconds") / 3600.0).alias("wall_clock_hours"),
        F.col("gpu_hours"),
        F.lit(0.0).alias("data_cost"),
        F.lit(0.0).alias("human_cost"),
        F.lit(0.0).alias("other_cost"),
        F.col("budget").alias("budget_cap"),
    )


def resource_count(resources: Column, name: str) -> Column:
    """Value of ``name`` in a ``key=value,...`` resource text; 0 when absent."""
    return F.coalesce(F.try_element_at(F.str_to_map(resources, F.lit(","), F.lit("=")), F.lit(name)).cast("bigint"), F.lit(0))


def gpu_hours(jobs: DataFrame, by: Sequence[str], resource: str = "gres/gpu") -> DataFrame:
    """Allocated GPU hours of completed jobs from an accounting table."""
    done = jobs.filter(F.col("state").startswith("COMPLETED"))
    seconds = F.col("elapsed_seconds") * resource_count(F.col("tres"), resource)
    return done.groupBy(*by).agg((F.sum(seconds) / 3600.0).alias("gpu_hours"), F.count(F.lit(1)).alias("jobs"))


def job_violations(jobs: DataFrame, resource: str = "gres/gpu") -> DataFrame:
    """Jobs that did not complete, hold no such resource, or occur twice."""
    return rules.all_violations(
        [
            rules.row_rules(
                jobs,
                "job_id",
                [
                    ("job_not_completed", ~F.coalesce(F.col("state").startswith("COMPLETED"), F.lit(False)), F.col("state")),
                    ("no_gpu_allocation", resource_count(F.col("tres"), resource) == 0, F.col("tres")),
                ],
            ),
            rules.duplicate_rule(jobs, ["job_id"], "duplicate_job"),
        ]
    )


def queries_to_target(points: DataFrame, target: float, cap: int, higher_is_better: bool) -> DataFrame:
    """Smallest budget that reaches the target per method, else censored at the largest budget seen.

    All of it is min/max/count per method, which combines before the shuffle.
    """
    usable = F.col("budget") <= cap
    good = F.col("value") >= target if higher_is_better else F.col("value") <= target
    found = points.groupBy("method").agg(
        F.min(F.when(usable & good, F.col("budget"))).alias("queries_to_target"),
        F.max(F.when(usable, F.col("budget"))).alias("_last"),
        F.count_if(usable).alias("points_used"),
    )
    first, last = F.col("queries_to_target"), F.col("_last")
    status = F.when(last.isNull(), "unavailable").when(first.isNull(), "censored").otherwise("reached")
    return found.select(
        "method",
        "queries_to_target",
        (status == "censored").alias("censored"),
        F.when(status == "censored", last).alias("censor_at"),
        F.when(status == "unavailable", "unavailable")
        .when(status == "censored", F.concat(F.lit(">"), last.cast("string")))
        .otherwise(first.cast("string"))
        .alias("display"),
        status.alias("status"),
        "points_used",
        F.coalesce(last == cap, F.lit(False)).alias("observed_at_budget_cap"),
    )


def curve_violations(points: DataFrame) -> DataFrame:
    """One effect identity, one value per method and budget, finite numbers."""
    identity = F.concat_ws("/", "effect_family", "metric", "unit")
    blank = [(f"blank_{c}", F.coalesce(strip(c), F.lit("")) == "") for c in ("method", "effect_family", "metric", "unit")]
    numbers = [
        ("bad_budget", ~F.coalesce((F.col("budget") >= 0) & (F.col("budget") == F.floor("budget")), F.lit(False)), F.col("budget")),
        ("value_not_finite", ~finite("value"), F.col("value")),
    ]
    return rules.all_violations(
        [
            rules.row_rules(points, "method", [*blank, *numbers]),
            rules.duplicate_rule(points, ["method", "budget"], "duplicate_point"),
            rules.single_value_rule(points.withColumn("effect", identity), "effect", "mixed_effect"),
        ]
    )
