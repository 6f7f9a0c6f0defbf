"""Report and table sinks. Publication is left to Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.hashing import canonical_json, ordered_hash
from traceaudit.operators import rules


def write_canonical(df: DataFrame, path: str, position: str, fields: Sequence[str], mode: str = "errorifexists") -> DataFrame:
    """Canonical JSON lines (sorted keys, compact) in position order, and their content hash.

    Ranges of the position go to separate files in order; reading the files by
    name gives the rows in order without one task holding them all.
    """
    text = canonical_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    lines = df.select(F.col(position).alias("_p"), text.alias("value"))
    lines.repartitionByRange("_p").sortWithinPartitions("_p").select("value").write.mode(mode).text(path)
    return ordered_hash(lines, "_p", ["value"])


def append_valid(df: DataFrame, violations: DataFrame, path: str) -> None:
    """Append rows unless a rule is broken."""
    rules.enforce(violations, f"append to {path}")
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a fixed column order; unknown columns are left out, absent ones are empty."""
    names = list(columns or df.columns)
    picked = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    df.select(*picked).write.mode(mode).option("header", True).csv(path)


def report_json(df: DataFrame) -> DataFrame:
    """A one-row report as one JSON text column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report_json(df).coalesce(1).write.mode(mode).text(path)


def write_capability_tables(tables: dict[str, DataFrame], root: str, pilot: bool = False, mode: str = "errorifexists") -> list[str]:
    """All summary tables of a run as CSV; a pilot run repeats three of them under its own names."""
    written = []
    extra = {"matrix_long": "pilot_matrix", "per_dataset": "pilot_per_dataset", "per_model": "pilot_per_model"}
    for name, df in tables.items():
        flat = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        names = [name] + ([extra[name]] if pilot and name in extra else [])
        for out in names:
            write_csv(flat, f"{root}/{out}", mode=mode)
            written.append(out)
    return written


def tag_outputs(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Output tables of several systems in one table with their label."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def result_row(
    attack: Column, transcript_hash: Column, ordering_hash: Column, checkpoint: Column, config_source: Column,
    training_config: Column, evaluation_config: Column, metrics: dict[str, Column],
) -> Column:
    """Unified result of a run: lineage, decode settings with their hash, metrics and the held-out flag."""
    held_out = F.coalesce(metrics["M1"]["held_out"] & metrics["M2"]["held_out"], F.lit(False))
    canonical = canonical_json(F.to_json(evaluation_config))
    return F.struct(
        F.lit("stage1_results_v1").alias("schema_version"),
        attack.alias("attack"),
        transcript_hash.alias("transcript_hash"),
        ordering_hash.alias("ordering_hash"),
        checkpoint.alias("checkpoint"),
        config_source.alias("config_source"),
        training_config.alias("training_decode_config"),
        evaluation_config.alias("evaluation_decode_config"),
        F.sha2(canonical, 256).alias("evaluation_decode_config_hash"),
        held_out.alias("held_out_evaluation"),
        F.struct(*[metrics[m].alias(m) for m in ("M1", "M2", "M3", "M6")]).alias("metrics"),
    )


