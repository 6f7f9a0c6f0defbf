"""Small combinations of DataFrames used by several report families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of one-row tables (totals, thresholds) to every row.

    Each table becomes a scalar subquery: Spark computes it once and ships the
    single value with the tasks. A table with more than one row is an error.
    """
    out = df
    added: list[str] = []
    for i, row in enumerate(one_row):
        out = out.withColumn(f"_row{i}", row.select(F.struct(*row.columns)).scalar())
        added += [f"_row{i}.{c}" for c in row.columns]
    return out.select(*df.columns, *added)
