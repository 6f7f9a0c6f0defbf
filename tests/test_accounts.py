"""Streams over many batches, with restarts, repeated batches and hot accounts, against plain versions."""

import collections
import random
import uuid

import pytest
from pyspark.sql import functions as F

from traceaudit.streaming import accounts, monitor

EVENTS = "entity_id string, query_index bigint, score double"


def series_by_hand(batches, threshold, sign, budget):
    """Detections and violations, row by row, with the state each account has."""
    states, out = {}, []
    for batch in batches:
        by = collections.defaultdict(list)
        for who, index, score in batch:
            if who is not None:
                by[who].append((index, score))
        for who, rows in by.items():
            expected, best, found, closed = states.get(who, (1, None, None, False))
            ended = any(s is None for _, s in rows)
            before = expected - 1
            for index, score in sorted((r for r in rows if r[1] is not None and r[0] <= budget), key=lambda r: r):
                if index <= before:
                    out.append((who, "duplicate", index, score))
                else:
                    if index > before + 1:
                        out.append((who, "gap", index, score))
                    best = score if best is None else sign * max(sign * best, sign * score)
                    if found is None and not closed and sign * score >= sign * threshold:
                        found = index
                        out.append((who, "detected", index, score))
                before = max(before, index)
            expected = max(expected, before + 1)
            if found is None and not closed and best is not None and (ended or expected > budget):
                closed = True
                out.append((who, "censored", expected - 1, best))
            states[who] = (expected, best, found, closed)
    return sorted(out)


def made_batches(seed, count):
    draw = random.Random(seed)
    places = collections.Counter()
    out = []
    for _ in range(count):
        batch = []
        for who in ("hot", "hot", "a", "b", "c", None):
            for _ in range(draw.randrange(60) if who == "hot" else draw.randrange(6)):
                places[who] += draw.choice((1, 1, 1, 1, 2))
                batch.append((who, places[who] if draw.random() < 0.9 else max(1, places[who] - draw.randrange(30)), round(draw.random() * 100, 3)))
        if draw.random() < 0.3:
            batch.append((draw.choice("abc"), None, None))
        draw.shuffle(batch)
        out.append(batch)
    return out


@pytest.mark.parametrize("direction", ["higher", "lower"])
def test_series_steps_like_by_hand(spark, direction):
    sign, threshold = (1, 90.0) if direction == "higher" else (-1, 10.0)
    batches = made_batches(5, 5)
    state = spark.createDataFrame([], accounts.SERIES_STATE)
    got = []
    for batch in batches:
        found, after = accounts.series_step(spark.createDataFrame(batch, EVENTS), state, threshold, direction, 150, segment=16)
        got += [tuple(r) for r in found.collect()]
        state = spark.createDataFrame(after.collect(), accounts.SERIES_STATE)
    want = series_by_hand(batches, threshold, sign, 150)
    assert sorted(got) == want
    assert {k for _, k, _, _ in want} == {"duplicate", "gap", "detected", "censored"}


def files_of(spark, path, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_monitor_over_batches_and_a_restart(spark, tmp_path):
    batches = made_batches(8, 6)
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), uuid.uuid4().hex
    for part in (batches[:3], batches[3:]):  # the second run goes on where the first ended
        files_of(spark, source, part, EVENTS)
        run(accounts.monitor_accounts(stream_of(spark, source, EVENTS), 90.0, "higher", 150, out, name, segment=16))
    found = spark.read.parquet(f"{out}/found").select("entity_id", "kind", "query_index", "score")
    assert sorted(map(tuple, found.collect())) == series_by_hand(batches, 90.0, 1, 150)
    states = accounts.Versions(spark, f"{out}/state", accounts.SERIES_STATE)
    assert len(states.numbers()) == 2 and states.newest().count() == 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    """A failure between the output and the state of a batch: the batch is repeated from the state before it."""
    batches = made_batches(9, 4)
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), uuid.uuid4().hex
    files_of(spark, source, batches, EVENTS)
    write, failed = accounts.Versions.write, []

    def break_once(self, table, number):
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")
        write(self, table, number)

    monkeypatch.setattr(accounts.Versions, "write", break_once)
    start = lambda: run(accounts.monitor_accounts(stream_of(spark, source, EVENTS), 90.0, "higher", 150, out, name, segment=16))
    with pytest.raises(Exception, match="lost"):
        start()
    start()
    found = spark.read.parquet(f"{out}/found").select("entity_id", "kind", "query_index", "score")
    assert failed and sorted(map(tuple, found.collect())) == series_by_hand(batches, 90.0, 1, 150)


def test_windows_over_batches_and_a_restart(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice(["hot"] * 6 + ["a", "b"]), k, f"i{k}", float(k)) for k in range(300)]
    schema = "entity_id string, order bigint, item string, score double"
    batches = [rows[k : k + 60] for k in range(0, 300, 60)]
    for batch in batches:
        draw.shuffle(batch)
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), uuid.uuid4().hex
    for part in (batches[:2], batches[2:]):
        files_of(spark, source, part, schema)
        run(accounts.account_windows(stream_of(spark, source, schema), 7, out, name))
    want, seen = [], collections.Counter()
    totals = collections.Counter(r[0] for r in rows)
    for who, _, item, score in rows:
        place = seen[who]
        seen[who] += 1
        if place // 7 < totals[who] // 7:
            want.append((who, place // 7, place % 7, item, score))
    found = spark.read.parquet(f"{out}/windows").select("entity_id", "batch", "slot", "item", "score")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert accounts.Versions(spark, f"{out}/open", accounts.OPEN_ROWS).newest().count() == sum(n % 7 for n in totals.values())


def test_view_in_update_mode(spark, tmp_path):
    batches = [[(who, k * 9 + j, float((k * j * 7) % 50)) for j in range(9) for who in ("a", None, "b")[: 1 + j % 3]] for k in range(4)]
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), uuid.uuid4().hex
    files_of(spark, source, batches, EVENTS)
    view = monitor.monitor_view(stream_of(spark, source, EVENTS), 40.0, "higher")
    query = run(accounts.keyed_view(view, ["entity_id"], out, name))
    assert query.lastProgress["batchId"] >= 3
    rows = [r for b in batches for r in b]
    got = {r.entity_id: (r.score, r.observed_until, r.queries_to_detection) for r in accounts.read_view(spark, out, view.schema).collect()}
    for who in ("a", None, "b"):
        own = [r for r in rows if r[0] == who]
        over = [i for _, i, s in own if s >= 40.0]
        assert got[who] == (max(s for *_, s in own), max(i for _, i, _ in own), min(over, default=None))
    assert len(got) == 3


def test_state_of_closed_windows_is_dropped(spark, tmp_path):
    """Rows of a hundred hours, one per batch file of ten: append mode returns closed windows and state keeps the open ones."""
    schema = "ts timestamp, model_key string, request_status string, parse_status string"
    source, base = str(tmp_path / "in"), str(tmp_path / "base")
    for k in range(6):
        hours = spark.range(k * 10, k * 10 + 10).select(
            F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("m").alias("model_key"),
            F.lit("completed").alias("request_status"), F.lit("success").alias("parse_status"),
        )
        hours.coalesce(1).write.mode("append").parquet(source)
    counted = monitor.counters(stream_of(spark, source, schema), "ts", "1 hour", "2 hours")
    writer = counted.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
    query = run(writer)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 14 and kept[-1] <= 3
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == 57 and out.agg(F.sum("attempted")).first()[0] == 57
