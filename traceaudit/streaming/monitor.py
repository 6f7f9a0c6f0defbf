"""Structured Streaming side: running detection, ordered series, windows, counters, ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from traceaudit.operators import rules
from traceaudit.operators.monitor import crosses
from traceaudit.operators.provenance import check_direction
from traceaudit.session import checkpoint_root

MONITOR_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("query_index", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_SERIES_STATE = T.StructType(
    [
        T.StructField("next_index", T.LongType()),
        T.StructField("extreme", T.DoubleType()),
        T.StructField("detected_at", T.LongType()),
        T.StructField("closed", T.BooleanType()),
    ]
)
_ROW_STATE = T.StructType([T.StructField("item", T.StringType()), T.StructField("score", T.DoubleType())])


class SeriesMonitor(StatefulProcessor):
    """First crossing of a locked threshold per entity, with the order rule of a series.

    Emits ``detected`` once; ``censored`` at the last query observed when the
    budget is reached, when a row without score says that the entity has ended,
    or when it was idle for ``idle_ms``; and ``duplicate`` / ``gap`` for indices
    that are not the next one. The exact next index is kept: counts and sums
    cannot tell {1, 1, 4, 4} from a clean series.
    """

    def __init__(self, threshold: float, direction: str, budget: int, idle_ms: int | None = None) -> None:
        check_direction(direction)
        self.threshold, self.sign, self.budget = threshold, (1.0 if direction == "higher" else -1.0), budget
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", _SERIES_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["query_index", "score"]] for r in rows])
        ended = bool(batch["score"].isna().any())
        batch = batch[batch["score"].notna() & (batch["query_index"] <= self.budget)].sort_values("query_index", kind="stable")
        expected, extreme, detected, closed = self.state.get() if self.state.exists() else (1, None, None, False)
        index, score = batch["query_index"].to_numpy(dtype="int64"), batch["score"].to_numpy(dtype="float64")
        out: list[tuple] = []
        if len(index):
            before = np.maximum(expected - 1, np.concatenate([[expected - 1], index[:-1]]))
            repeated, jumped = index <= before, index > before + 1
            odd = repeated | jumped
            kinds = np.where(repeated, "duplicate", "gap")
            out += zip(kinds[odd].tolist(), index[odd].tolist(), score[odd].tolist())
            index, score = index[~repeated], score[~repeated]
        if len(index):
            expected = int(index[-1]) + 1
            best = float(score[np.argmax(self.sign * score)])
            extreme = best if extreme is None or self.sign * best > self.sign * extreme else extreme
            over = np.flatnonzero(self.sign * score >= self.sign * self.threshold)
            if detected is None and len(over) and not closed:
                detected = int(index[over[0]])
                out.append(("detected", detected, float(score[over[0]])))
        if detected is None and not closed and extreme is not None and (ended or expected > self.budget):
            closed = True
            out.append(("censored", expected - 1, extreme))
        self.state.update((expected, extreme, detected, closed))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if detected is None and not closed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, extreme, detected, closed = self.state.get()
        if detected is None and not closed and extreme is not None:
            self.state.update((expected, extreme, detected, True))
            yield self._rows(key, [("censored", expected - 1, extreme)])

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "entity_id": pd.Series([key[0]] * len(out), dtype="object"),
                "kind": pd.Series([o[0] for o in out], dtype="object"),
                "query_index": pd.Series([o[1] for o in out], dtype="int64"),
                "score": pd.Series([o[2] for o in out], dtype="float64"),
            }
        )

    def close(self) -> None:
        pass


def monitor_stream(events: DataFrame, threshold: float, direction: str, budget: int, idle_ms: int | None = None) -> DataFrame:
    """Detections, censorings and order violations of ``(entity_id, query_index, score)``.

    A log that ends needs a row with a null score per entity; a live one, ``idle_ms``.
    """
    return events.select("entity_id", "query_index", "score").groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=SeriesMonitor(threshold, direction, budget, idle_ms),
        outputStructType=MONITOR_SCHEMA,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def ended_series(events: DataFrame) -> DataFrame:
    """A finished log with the row per entity that says so."""
    ends = events.select("entity_id").distinct().select(
        "entity_id", F.lit(None).cast("bigint").alias("query_index"), F.lit(None).cast("double").alias("score")
    )
    return events.select("entity_id", "query_index", "score").unionByName(ends)


def monitor_view(events: DataFrame, threshold: float, direction: str) -> DataFrame:
    """Running extreme score and first crossing per entity, without custom state."""
    check_direction(direction)
    extreme = F.max("score") if direction == "higher" else F.min("score")
    crossed = F.when(crosses(F.col("score"), threshold, direction), F.col("query_index"))
    return events.groupBy("entity_id").agg(
        extreme.alias("score"), F.max("query_index").alias("observed_until"), F.min(crossed).alias("queries_to_detection")
    )


WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("slot", T.LongType()),
        T.StructField("item", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class CountWindows(StatefulProcessor):
    """Windows of ``size`` queries per entity; a window leaves when it is full.

    State holds the open window only, fewer than ``size`` rows.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", _ROW_STATE)
        self.done = handle.getValueState("done", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([r[["order", "item", "score"]] for r in rows]).sort_values("order", kind="stable")
        pending = [tuple(r) for r in self.open.get()]
        done = self.done.get()[0] if self.done.exists() else 0
        merged = pending + list(zip(arrived["item"].tolist(), arrived["score"].astype("float64").tolist()))
        full = len(merged) // self.size
        ready, rest = merged[: full * self.size], merged[full * self.size :]
        self.open.clear()
        if rest:
            self.open.put([(i, float(s)) for i, s in rest])
        self.done.update((int(done + full),))
        places = np.arange(len(ready))
        yield pd.DataFrame(
            {
                "entity_id": pd.Series([key[0]] * len(ready), dtype="object"),
                "batch": (places // self.size + done).astype("int64"),
                "slot": (places % self.size).astype("int64"),
                "item": pd.Series([r[0] for r in ready], dtype="object"),
                "score": pd.Series([r[1] for r in ready], dtype="float64"),
            }
        )

    def close(self) -> None:
        pass


def batch_stream(events: DataFrame, size: int) -> DataFrame:
    """Full count windows of ``(entity_id, order, item, score)``."""
    return events.select("entity_id", "order", "item", "score").groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=CountWindows(size), outputStructType=WINDOW_SCHEMA, outputMode="Append", timeMode="None"
    )


def counters(records: DataFrame, time: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Validity and failure counts per model and time window; rows later than the delay are dropped."""
    return records.withWatermark(time, delay).groupBy(F.window(time, window), "model_key").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("request_status") == "completed").alias("completed"),
        F.count_if(F.col("request_status") == "failed").alias("request_failures"),
        F.count_if(F.col("parse_status") == "failed").alias("parse_failures"),
    )


def ingest(stream: DataFrame, keys: Sequence[str], time: str, path: str, name: str, delay: str = "1 hour"):
    """Append-only collection that survives restarts and drops repeated keys within the watermark."""
    spark = stream.sparkSession
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return (
        unique.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint_root(spark)}/streams/{name}")
        .outputMode("append")
    )


def validated(stream: DataFrame, check, path: str, name: str):
    """Append-only sink behind a gate: a batch with violations (``check`` gives them) stops the query unwritten."""

    def write(batch: DataFrame, number: int) -> None:
        rules.enforce(check(batch), f"batch {number}")
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    location = f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", location).outputMode("append")
