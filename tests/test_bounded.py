"""Steps that hold a bounded part of a table, whatever its size."""

from unittest.mock import MagicMock

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceaudit.functions import ngrams, text
from traceaudit.plans import streams
from traceaudit.sources import jsonl, tasks


@pytest.mark.parametrize("kind", ["texts", "lists"])
def test_python_sees_slices_of_bounded_bytes(monkeypatch, kind):
    monkeypatch.setattr(text, "SLICE_BYTES", 10)
    values = ["abcd", None, "efgh", "x" * 30, "", "é" * 5, "ij"] if kind == "texts" else [["ab", "cd"], None, [], ["e" * 30, None], ["é"], ["k" * 10]]
    column = pa.array([["zz"] if kind == "lists" else "zz", *values]).slice(1)
    parts = [p.to_pylist() for p in text.sliced(column)]
    assert [v for p in parts for v in p] == values

    def size(v):
        return sum(len(t.encode()) for t in ([v] if isinstance(v, str) else v or []) if t)

    assert len(parts) > 2
    assert all(len(p) == 1 or sum(map(size, p)) <= 10 for p in parts)
    assert text.each_value(column, lambda v: v, column.type).to_pylist() == values
    assert text.each_value(column.slice(0, 0), lambda v: v, column.type).to_pylist() == []


def test_tokens_are_numbered_a_part_at_a_time(monkeypatch):
    monkeypatch.setattr(ngrams, "SLICE_TOKENS", 4)
    tokens = pa.array([["a", "b"], ["c"], None, ["d", "e", "d", "e"], ["f"]])
    parts = list(ngrams._parts(tokens))
    assert [len(codes) for _, _, codes, _ in parts] == [3, 4, 1]
    assert all(codes.max() <= len(codes) for _, _, codes, _ in parts)
    assert [r["r1"] for r in ngrams._shares(tokens, [1]).to_pylist()] == [0.0, 0.0, None, 0.5, 0.0]


def test_only_rows_without_an_id_go_to_python(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(tasks, "canonical_json", lambda c: sent.append(c) or c)
    rows = spark.createDataFrame([("7", "a"), (" ", "b"), (None, "c")], "id string, text string")
    tasks.example_id(rows, "fpb", F.lit("test"))
    assert [r.text for r in rows.filter(sent[0].isNotNull()).collect()] == ["b", "c"]


def test_a_replayed_log_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    files = []
    log = spark.range(200).select("id", F.when(F.col("id") < 100, 5).otherwise(F.col("id")).alias("at")).mapInArrow(count, "id bigint, at bigint")

    def start(stream):
        assert stream.isStreaming
        files.append(stream)
        return MagicMock()

    streams.replay(spark, log, "at", start)
    assert len(files) == 2
    assert seen.value == 200


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"x": {k}}}\n' for k in range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = jsonl.read_jsonl(spark, str(tmp_path), "x bigint", numbered=True)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert [(r.x, r.line_no) for r in rows.orderBy("x").collect()] == [(k, k + 1) for k in range(50)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
