"""Accounts of any size in a stream: each micro-batch is a batch job over its rows and a small table of states.

A stateful operator hands all rows of a key in a batch to one call, so an account that sends a third of all events fills
one task. Here rows of an account are cut into segments of its sequence, each is summarised where it lies, and only the
summaries (first and last index, extreme, first crossing) meet. States are tables with one version per batch. A batch
reads the version before it and writes its own, so a batch that runs again after a failure gives the same result and
counts nothing twice. The two newest versions are kept.

Rows without ``entity_id`` belong to no account and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from traceaudit.operators.ordering import positions
from traceaudit.operators.provenance import check_direction
from traceaudit.session import checkpoint_root, materialise, stored_tables

#: Queries of an account that are looked at together.
SEGMENT = 4096

SERIES_STATE = "entity_id string, expected bigint, extreme double, detected_at bigint, closed boolean"
OPEN_ROWS = "entity_id string, place bigint, item string, score double"
DONE_WINDOWS = "entity_id string, done bigint, open bigint"


class Versions:
    """A table with one folder per batch number."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self._spark, self._path, self._schema = spark, path, schema

    def _folder(self, name: str = ""):
        hadoop = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)
        return hadoop, hadoop.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Complete versions, oldest first."""
        path, files = self._folder()
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(self._folder(f"{n}/_SUCCESS")[0]))

    def before(self, number: int) -> DataFrame:
        """What the batches before ``number`` left."""
        earlier = [n for n in self.numbers() if n < number]
        if not earlier:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/{earlier[-1]}")

    def newest(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, table: DataFrame, number: int) -> None:
        table.select(*self._spark.createDataFrame([], self._schema).columns).write.mode("overwrite").parquet(f"{self._path}/{number}")
        for old in [n for n in self.numbers() if n < number - 1]:
            path, files = self._folder(str(old))
            files.delete(path, True)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> DataStreamWriter:
    def batch(rows: DataFrame, number: int) -> None:
        with stored_tables(rows.sparkSession):
            write(rows, number)

    location = f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", location).outputMode(mode)


# Ordered series


def series_step(batch: DataFrame, state: DataFrame, threshold: float, direction: str, budget: int, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """What a batch of ``(entity_id, query_index, score)`` adds to each account: ``(found, state)``.

    ``found`` has ``detected`` once per account, ``censored`` at the last query observed when the budget is reached or a
    row without score says that the account has ended, and ``duplicate`` / ``gap`` for indices that are not the next one,
    rows of a batch being taken in the order of index and score.
    """
    check_direction(direction)
    sign = 1.0 if direction == "higher" else -1.0
    known = batch.filter("entity_id is not null").select("entity_id", "query_index", "score")
    rows = known.filter(F.col("score").isNotNull() & (F.col("query_index") <= budget)).withColumn(
        "segment", F.floor((F.col("query_index") - 1) / F.lit(segment))
    )
    # A row per segment, not per query: few enough for one window per account.
    earlier = Window.partitionBy("entity_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("entity_id", "segment").agg(F.max("query_index").alias("last"))
    reached = F.greatest(F.coalesce(F.max("last").over(earlier), F.lit(0)), F.coalesce(F.col("expected") - 1, F.lit(0)))
    starts = last.join(state.select("entity_id", "expected"), "entity_id", "left").select("entity_id", "segment", reached.alias("reached"))
    inside = Window.partitionBy("entity_id", "segment").orderBy("query_index", "score")
    before = F.greatest("reached", F.coalesce(F.lag("query_index").over(inside), F.lit(0)))
    placed = materialise(rows.join(starts, ["entity_id", "segment"]).withColumn("before", before).drop("segment", "reached"))

    kind = F.when(F.col("query_index") <= F.col("before"), "duplicate").when(F.col("query_index") > F.col("before") + 1, "gap")
    odd = placed.select("entity_id", kind.alias("kind"), "query_index", "score").filter("kind is not null")
    over = F.when(sign * F.col("score") >= sign * threshold, F.struct("query_index", "score"))
    summary = placed.filter("query_index > before").groupBy("entity_id").agg(
        F.max("query_index").alias("last"), F.max(sign * F.col("score")).alias("best"), F.min(over).alias("crossing")
    )
    ends = known.filter("score is null").select("entity_id").distinct().withColumn("ended", F.lit(True))
    joined = state.join(summary, "entity_id", "full").join(ends, "entity_id", "full")
    open_ = ~F.coalesce("closed", F.lit(False))
    updated = joined.select(
        "entity_id",
        F.coalesce(F.col("last") + 1, "expected", F.lit(1)).alias("expected"),
        (sign * F.greatest(sign * F.col("extreme"), F.col("best"))).alias("extreme"),
        F.coalesce("detected_at", F.when(open_, F.col("crossing.query_index"))).alias("detected_at"),
        F.when(F.col("detected_at").isNull() & open_, F.col("crossing")).alias("crossing"),
        open_.alias("open"), F.coalesce("ended", F.lit(False)).alias("ended"),
    )
    ends_now = F.col("detected_at").isNull() & F.col("open") & F.col("extreme").isNotNull() & (F.col("ended") | (F.col("expected") > budget))
    settled = materialise(updated.withColumn("censored", ends_now))
    detected = settled.filter("crossing is not null").select("entity_id", F.lit("detected").alias("kind"), "crossing.query_index", "crossing.score")
    censored = settled.filter("censored").select(
        "entity_id", F.lit("censored").alias("kind"), (F.col("expected") - 1).alias("query_index"), F.col("extreme").alias("score")
    )
    after = settled.select("entity_id", "expected", "extreme", "detected_at", (~F.col("open") | F.col("censored")).alias("closed"))
    return odd.unionByName(detected).unionByName(censored), after


def monitor_accounts(events: DataFrame, threshold: float, direction: str, budget: int, path: str, name: str, segment: int = SEGMENT) -> DataStreamWriter:
    """Detections, censorings and order violations of a stream, below ``path/found``; states below ``path/state``."""
    states = Versions(events.sparkSession, f"{path}/state", SERIES_STATE)

    def write(batch: DataFrame, number: int) -> None:
        found, after = series_step(batch, states.before(number), threshold, direction, budget, segment)
        found.write.mode("overwrite").parquet(f"{path}/found/micro_batch={number}")
        states.write(after, number)

    return _start(events, write, name)


# Count windows


def window_step(batch: DataFrame, rows_open: DataFrame, done: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full windows of ``size`` queries per account, the rows left open, and the windows done: from a batch and what was left.

    Rows of a batch follow those left open, in ``order``.
    """
    known = batch.filter("entity_id is not null").select("entity_id", "order", "item", F.col("score").cast("double"))
    numbered = positions(known, ["order"], by=["entity_id"]).withColumn("position", F.col("position") - 1)
    counted = known.groupBy("entity_id").agg(F.count("*").alias("arrived"))
    totals = materialise(
        done.join(counted, "entity_id", "full").select(
            "entity_id", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("open", F.lit(0)).alias("open"),
            F.coalesce("arrived", F.lit(0)).alias("arrived"),
        )
    )
    full = F.floor((F.col("open") + F.col("arrived")) / F.lit(size))
    fresh = numbered.join(totals, "entity_id").withColumn("place", F.col("position") + F.col("open"))
    kept = rows_open.join(totals, "entity_id")
    columns = ("entity_id", "place", "item", "score", "done", full.alias("full"))
    rows = materialise(fresh.select(*columns).unionByName(kept.select(*columns)))
    window = F.floor(F.col("place") / F.lit(size))
    ready = rows.filter(window < F.col("full")).select(
        "entity_id", (window + F.col("done")).alias("batch"), (F.col("place") % size).alias("slot"), "item", "score"
    )
    left = rows.filter(window >= F.col("full")).withColumn("place", F.col("place") % size)
    after = totals.select("entity_id", (F.col("done") + full).alias("done"), ((F.col("open") + F.col("arrived")) % size).alias("open"))
    return ready, left.select("entity_id", "place", "item", "score"), after


def account_windows(events: DataFrame, size: int, path: str, name: str) -> DataStreamWriter:
    """Full count windows of ``(entity_id, order, item, score)``, below ``path/windows``."""
    spark = events.sparkSession
    open_, done = Versions(spark, f"{path}/open", OPEN_ROWS), Versions(spark, f"{path}/done", DONE_WINDOWS)

    def write(batch: DataFrame, number: int) -> None:
        ready, left, after = window_step(batch, open_.before(number), done.before(number), size)
        ready.write.mode("overwrite").parquet(f"{path}/windows/micro_batch={number}")
        open_.write(left, number)
        done.write(after, number)

    return _start(events, write, name)


# Views


def upserted(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with rows of ``changes`` in place of those with the same keys; null keys are equal."""
    fresh = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return table.join(fresh, same, "left_anti").unionByName(changes)


def keyed_view(view: DataFrame, keys: Sequence[str], path: str, name: str) -> DataStreamWriter:
    """A streaming aggregate kept as a table by its keys: each batch sends only the rows that it changed."""
    versions = Versions(view.sparkSession, path, view.schema)

    def write(batch: DataFrame, number: int) -> None:
        versions.write(upserted(versions.before(number), materialise(batch), keys), number)

    return _start(view, write, name, "update")


def read_view(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return Versions(spark, path, schema).newest()
