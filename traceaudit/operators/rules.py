"""Row and table rules as DataFrames of violations.

A rule never raises by itself: it contributes rows ``(rule, row_key, detail)``.
``enforce`` turns a non-empty result into one error for callers that want the
refusing behaviour.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION_SCHEMA = "rule string, row_key string, detail string"


class AuditRuleError(ValueError):
    """Input broke at least one rule."""


def _text(value: Column | str | None) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return value.cast("string") if isinstance(value, Column) else F.lit(value)


def row_rules(df: DataFrame, key: Column | str, rules: Sequence[tuple]) -> DataFrame:
    """Check every row against ``(name, broken_when, detail)`` in one narrow pass."""
    key = F.col(key) if isinstance(key, str) else key
    checks = [
        F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(F.lit(name).alias("rule"), _text(detail).alias("detail")),
        )
        for name, broken, detail in ((*r, None)[:3] for r in rules)
    ]
    found = df.select(
        key.cast("string").alias("row_key"),
        F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("v"),
    )
    return found.select("v.rule", "row_key", "v.detail")


def duplicate_rule(df: DataFrame, keys: Sequence[str | Column], rule: str) -> DataFrame:
    """Keys that occur more than once (counts combine before the shuffle)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = df.select(*[c.cast("string").alias(f"k{i}") for i, c in enumerate(cols)])
    counted = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *named.columns).alias("row_key"),
        F.concat(F.lit("seen "), F.col("n"), F.lit(" times")).alias("detail"),
    )


def single_value_rule(df: DataFrame, column: str, rule: str) -> DataFrame:
    """The column must hold one value over the whole table."""
    bounds = df.agg(
        F.min(column).cast("string").alias("lo"), F.max(column).cast("string").alias("hi")
    ).filter("not (lo <=> hi)")
    return bounds.select(
        F.lit(rule).alias("rule"), F.lit(column).alias("row_key"), F.concat_ws(" vs ", "lo", "hi").alias("detail")
    )


def constant_per_group_rule(df: DataFrame, by: Sequence[str], columns: Sequence[str], rule: str) -> DataFrame:
    """Columns that must not change inside a group; nulls count as a value."""
    per_group = df.groupBy(*by).agg(
        *[
            F.struct(
                (F.min(c) != F.max(c)).alias("differs"),
                ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))).alias("mixed"),
            ).alias(f"s_{c}")
            for c in columns
        ]
    )
    flags = [
        F.when(F.coalesce(F.col(f"s_{c}.differs"), F.lit(False)) | F.col(f"s_{c}.mixed"), F.lit(c)) for c in columns
    ]
    return per_group.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.col(b).cast("string") for b in by]).alias("row_key"),
        F.explode(F.filter(F.array(*flags), lambda c: c.isNotNull())).alias("detail"),
    )


def non_empty_rule(df: DataFrame, rule: str) -> DataFrame:
    counted = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return counted.select(
        F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("row_key"), F.lit("no rows").alias("detail")
    )


def missing_keys_rule(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``left`` that ``right`` does not hold."""
    lost = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
    return lost.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("row_key"),
        F.lit(None).cast("string").alias("detail"),
    )


def overlap_rule(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that both sides hold although they must be disjoint."""
    shared = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")
    return shared.select(
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("row_key"),
        F.lit(None).cast("string").alias("detail"),
    )


def key_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only left, only right, and on both sides."""
    one = F.lit(True)
    both = (
        left.select(*keys).distinct().withColumn("_l", one)
        .join(right.select(*keys).distinct().withColumn("_r", one), list(keys), "full_outer")
    )
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l") & F.col("_r")).alias("shared"),
    )


def all_violations(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(violations: DataFrame, what: str) -> None:
    """Raise if any rule was broken, quoting a few examples."""
    examples = violations.limit(5).collect()
    if examples:
        shown = "; ".join(f"{r['rule']} [{r['row_key']}] {r['detail'] or ''}".strip() for r in examples)
        raise AuditRuleError(f"{what}: {shown}")
