"""Streaming queries over the tables, run to completion and read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.operators.ordering import positions
from traceaudit.operators.rules import row_rules
from traceaudit.plans.monitor import FOUND, SERIES, series
from traceaudit.plans.registry import Catalog, table
from traceaudit.session import DEFAULTS, checkpoint_root, materialise
from traceaudit.streaming import accounts as A
from traceaudit.streaming import monitor as S

CATALOG = Catalog()
query = CATALOG.query

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"


def as_stream(spark, df):
    """The rows of a table as a file stream in the shared folder."""
    path = f"{scratch(spark)}/in"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(stream, mode="append"):
    """Run a stream over what is available and read its output table."""
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    base = scratch(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", f"{base}/out")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "stream_detections",
    f"""WITH {SERIES}, {FOUND.format(t=90, where='query_index <= 40')}
SELECT entity_id, CASE WHEN queries_to_detection IS NULL THEN 'censored' ELSE 'detected' END AS kind, coalesce(queries_to_detection, observed_until)::BIGINT AS query_index FROM found""",
)
def stream_detections(spark, sf_dir):
    rows = series(spark, sf_dir).select("entity_id", "query_index", "score")
    found = drain(S.monitor_stream(as_stream(spark, S.ended_series(rows)), 90.0, "higher", 40))
    return found.select("entity_id", "kind", "query_index")


# Events of one type are left out, so their places show up as gaps.
@query(
    "stream_order_violations",
    """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT user_id, i, lag(i, 1, 0) OVER (PARTITION BY user_id ORDER BY i) AS before FROM s WHERE event_type <> 'error')
SELECT user_id::VARCHAR AS entity_id, count(*)::BIGINT AS gaps FROM l WHERE i <> before + 1 GROUP BY 1""",
)
def stream_order_violations(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    ordered = positions(events, ["ts", "event_id"], by=["user_id"], name="query_index", sample_of=events)
    rows = ordered.filter("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("entity_id"), "query_index", F.col("value").alias("score")
    )
    found = drain(S.monitor_stream(as_stream(spark, rows), 1e9, "higher", 1 << 40)).filter("kind = 'gap'")
    return found.groupBy("entity_id").agg(F.count(F.lit(1)).alias("gaps"))


@query(
    "stream_running_view",
    f"WITH {SERIES} SELECT entity_id, max(score) AS score, max(query_index)::BIGINT AS observed_until, (min(query_index) FILTER (score >= 90))::BIGINT AS queries_to_detection FROM series GROUP BY 1",
)
def stream_running_view(spark, sf_dir):
    rows = series(spark, sf_dir).select("entity_id", "query_index", "score")
    return drain(S.monitor_view(as_stream(spark, rows), 90.0, "higher"), "complete")


@query(
    "stream_count_windows",
    """WITH b AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, (p // 10)::BIGINT AS batch, (p % 10)::BIGINT AS slot FROM b WHERE p // 10 < n // 10""",
)
def stream_count_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("order"),
        F.col("event_id").cast("string").alias("item"), F.col("value").alias("score"),
    )
    found = drain(S.batch_stream(as_stream(spark, rows), 10))
    return found.select(F.col("item").cast("bigint").alias("event_id"), "batch", "slot")


@query(
    "stream_counters",
    """SELECT event_type AS model_key, epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS window_start, count(*)::BIGINT AS attempted, count(*) FILTER (value >= 2)::BIGINT AS completed,
count(*) FILTER (value < 2)::BIGINT AS request_failures, count(*) FILTER (value >= 2 AND value < 5)::BIGINT AS parse_failures FROM events GROUP BY 1, 2""",
)
def stream_counters(spark, sf_dir):
    value = F.col("value")
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model_key"),
        F.when(value < 2, "failed").otherwise("completed").alias("request_status"),
        F.when(value < 2, "not_attempted").when(value < 5, "failed").otherwise("success").alias("parse_status"),
    )
    found = drain(S.counters(as_stream(spark, rows), "ts", "1 day", "1 day"), "complete")
    return found.withColumn("window_start", F.unix_seconds("window.start")).drop("window")


@query("stream_ingest", "SELECT event_id, user_id, value FROM events")
def stream_ingest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    doubled = rows.unionByName(rows)
    path, name = f"{scratch(spark)}/collected", uuid.uuid4().hex
    S.ingest(as_stream(spark, doubled), ["event_id"], "ts", path, name).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "value")


@query("stream_validated", "SELECT event_id, user_id, value FROM events")
def stream_validated(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    path = f"{scratch(spark)}/gated"

    def check(batch):
        return row_rules(batch, "event_id", [("no_value", F.col("value").isNull()), ("negative", F.col("value") < 0)])

    S.validated(as_stream(spark, rows), check, path, uuid.uuid4().hex).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "value")


# Logs that arrive file by file


#: Files that a log arrives in; a query takes one per micro-batch.
FILES = 10


def replay(spark, df, order, start):
    """Rows in files by ranges of ``order``, one micro-batch each; the query stops in mid-log and goes on from its checkpoint.

    ``start`` makes a stream's writer; it is called for each of the two runs. The log is worked out once and stored by
    its parts, so that the one task that writes a file reads the rows of that file only.
    """
    spark.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    path, parts = f"{scratch(spark)}/in", f"{scratch(spark)}/parts"
    log = materialise(df)
    cuts = log.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [k / FILES for k in range(1, FILES)], 0.001)
    place = sum(((F.col(order).cast("double") > c).cast("int") for c in cuts), F.lit(0))
    log.withColumn("_part", place).write.partitionBy("_part").parquet(parts)
    cut = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(parts)
    for part in range(FILES):
        cut.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
        if part in (FILES // 2, FILES - 1):
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
            start(stream).trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_replayed_detections",
    f"""WITH {SERIES}, {FOUND.format(t=90, where='query_index <= 40')}
SELECT entity_id, CASE WHEN queries_to_detection IS NULL THEN 'censored' ELSE 'detected' END AS kind, coalesce(queries_to_detection, observed_until)::BIGINT AS query_index FROM found""",
)
def stream_replayed_detections(spark, sf_dir):
    """Accounts of any size over many batches and a restart; rows without score end the log."""
    rows = series(spark, sf_dir).select("entity_id", "query_index", "score")
    log = S.ended_series(rows).withColumn("at", F.coalesce("query_index", F.lit(1 << 40)))
    out, name = scratch(spark), uuid.uuid4().hex
    replay(spark, log, "at", lambda stream: A.monitor_accounts(stream, 90.0, "higher", 40, out, name))
    return spark.read.parquet(f"{out}/found").select("entity_id", "kind", "query_index")


@query(
    "stream_replayed_gaps",
    """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT user_id, i, lag(i, 1, 0) OVER (PARTITION BY user_id ORDER BY i) AS before FROM s WHERE event_type <> 'error')
SELECT user_id::VARCHAR AS entity_id, i::BIGINT AS query_index, 'gap' AS kind FROM l WHERE i <> before + 1""",
)
def stream_replayed_gaps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    ordered = positions(events, ["ts", "event_id"], by=["user_id"], name="query_index", sample_of=events)
    rows = ordered.filter("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("entity_id"), "query_index", F.col("value").alias("score"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    out, name = scratch(spark), uuid.uuid4().hex
    # Short segments, so that accounts of the small tables have several.
    replay(spark, rows, "at", lambda stream: A.monitor_accounts(stream, 1e9, "higher", 1 << 40, out, name, segment=16))
    return spark.read.parquet(f"{out}/found").select("entity_id", "query_index", "kind")


@query(
    "stream_replayed_windows",
    """WITH b AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, (p // 10)::BIGINT AS batch, (p % 10)::BIGINT AS slot FROM b WHERE p // 10 < n // 10""",
)
def stream_replayed_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("order"),
        F.col("event_id").cast("string").alias("item"), F.col("value").alias("score"),
    )
    out, name = scratch(spark), uuid.uuid4().hex
    replay(spark, rows, "order", lambda stream: A.account_windows(stream, 10, out, name))
    return spark.read.parquet(f"{out}/windows").select(F.col("item").cast("bigint").alias("event_id"), "batch", "slot")


@query(
    "stream_keyed_view",
    f"WITH {SERIES} SELECT entity_id, max(score) AS score, max(query_index)::BIGINT AS observed_until, (min(query_index) FILTER (score >= 90))::BIGINT AS queries_to_detection FROM series GROUP BY 1",
)
def stream_keyed_view(spark, sf_dir):
    """The running view in update mode: a batch sends the accounts it changed."""
    rows = series(spark, sf_dir).select("entity_id", "query_index", "score")
    out, name = scratch(spark), uuid.uuid4().hex
    replay(spark, rows, "query_index", lambda stream: A.keyed_view(S.monitor_view(stream, 90.0, "higher"), ["entity_id"], out, name))
    return A.read_view(spark, out, S.monitor_view(rows, 90.0, "higher").schema)


def _requests(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model_key"),
        F.when(value < 2, "failed").otherwise("completed").alias("request_status"),
        F.when(value < 2, "not_attempted").when(value < 5, "failed").otherwise("success").alias("parse_status"),
    ).withColumn("at", F.unix_micros("ts"))


COUNTED = """SELECT event_type AS model_key, time_bucket(INTERVAL '1 day', ts) AS w, count(*)::BIGINT AS attempted, count(*) FILTER (value >= 2)::BIGINT AS completed,
count(*) FILTER (value < 2)::BIGINT AS request_failures, count(*) FILTER (value >= 2 AND value < 5)::BIGINT AS parse_failures FROM events GROUP BY 1, 2"""


@query(
    "stream_keyed_counters",
    f"SELECT * EXCLUDE (w), epoch_us(w) // 1000000 AS window_start FROM ({COUNTED})",
)
def stream_keyed_counters(spark, sf_dir):
    """Counters in update mode: state holds the windows that rows may still come for, the view all of them."""
    rows, out, name = _requests(spark, sf_dir), scratch(spark), uuid.uuid4().hex

    def counted(stream):
        return S.counters(stream, "ts", "1 day", "1 day")

    replay(spark, rows, "at", lambda stream: A.keyed_view(counted(stream), ["window", "model_key"], out, name))
    view = A.read_view(spark, out, counted(rows).schema)
    return view.withColumn("window_start", F.unix_seconds("window.start")).drop("window")


@query(
    "stream_closed_counters",
    f"""SELECT * EXCLUDE (w), epoch_us(w) // 1000000 AS window_start FROM ({COUNTED})
WHERE w + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'""",
)
def stream_closed_counters(spark, sf_dir):
    """Counters in append mode: a window leaves, and its state goes, when no row of it can come any more."""
    base = scratch(spark)

    def write(stream):
        writer = S.counters(stream, "ts", "1 day", "1 day").writeStream.outputMode("append").format("parquet")
        return writer.option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")

    replay(spark, _requests(spark, sf_dir), "at", write)
    return spark.read.parquet(f"{base}/out").withColumn("window_start", F.unix_seconds("window.start")).drop("window")


@query("stream_replayed_ingest", "SELECT event_id, user_id, value FROM events")
def stream_replayed_ingest(spark, sf_dir):
    """Every row twice, in files without order: late rows and copies of rows from other batches and before the restart."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.pmod(F.xxhash64("event_id", "copy"), F.lit(1000)))
    path, name = f"{scratch(spark)}/collected", uuid.uuid4().hex
    replay(spark, doubled.drop("copy"), "at", lambda stream: S.ingest(stream, ["event_id"], "ts", path, name, "1000 days"))
    return spark.read.parquet(path).select("event_id", "user_id", "value")
