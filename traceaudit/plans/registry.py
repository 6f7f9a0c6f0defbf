"""Named queries: a Spark builder plus, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None = None


class Catalog:
    """Queries of one family, filled by decorators in the plan modules."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def add(build: Builder) -> Builder:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = Query(name, build, sql)
            return build

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
