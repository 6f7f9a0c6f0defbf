"""Distinct pairs of context and token: few bytes in the shuffle, every pair once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceaudit.operators import watermark as W

PAIRS = [
    ("a b", "c"), ("a b", "c"), ("a", "b c"), ("a b c", ""), ("a b", None), ("a b", None), ("a b|c", "d"), ("a b", "c|d"),
    ("", ""), ("", None), ("x\ny", "z"), ("x", "\nyz"), ("é" * 40, "日本"), ("é" * 40, "日"), ("a\0", "b"), ("a", "\0b"),
]


def shuffled_bytes(plan) -> int:
    """Bytes that the exchanges of an executed plan have written."""
    at = plan.getClass().getSimpleName()
    if at == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if at.endswith("QueryStageExec"):
        return shuffled_bytes(plan.plan())
    written = plan.metrics().get("shuffleBytesWritten")
    below = plan.children()
    return (written.get().value() if written.isDefined() else 0) + sum(shuffled_bytes(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("volume", [None, 0, 40 * W.PAIR_BYTES])
def test_distinct_pairs_are_compared_as_they_are(spark, volume):
    rows = spark.createDataFrame(PAIRS * 3, "context string, token string").repartition(5)
    found = [tuple(r) for r in W.deduplicate(rows, "v2", None if volume is None else F.lit(volume)).collect()]
    assert len(found) == len(set(PAIRS)) and set(found) == set(PAIRS)
    assert W.deduplicate(rows.limit(0), "v2").collect() == []


def test_pairs_are_packed_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(W, "PAIR_ROWS", 4)
    schema = pa.schema([("context", pa.string()), ("token", pa.string()), ("bucket", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([{"context": c, "token": t, "bucket": i % 2} for c, t in PAIRS[i : i + 3]], schema) for i in range(0, len(PAIRS), 3)]
    packed = list(W._pack_pairs(iter(batches)))
    assert [sum(b.column("pairs").to_pylist()) for b in packed] == [4, 6, 4]
    assert list(W._pack_pairs(iter([]))) == []
    tables = [pa.Table.from_batches([b]) for b in packed]
    found = W._distinct_pairs(pa.concat_tables(tables)).select(["context", "token"]).to_pylist()
    assert len(found) == len(set(PAIRS)) and {(r["context"], r["token"]) for r in found} == set(PAIRS)


def test_distinct_pairs_are_shuffled_packed(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(4000)]
    docs = [(i, [words[int(4000 * draw.random() ** 2)] for _ in range(600)]) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").coalesce(2)
    want = {(f"{a} {b}", c) for _, t in docs for a, b, c in zip(t[1:], t[2:], t[3:])}
    unique = W.deduplicate(W.scored_positions(df, "doc_id", "tokens", 2), "v2", W.pair_volume(df, "tokens", 2))
    found = unique.agg(F.count(F.lit(1)).alias("n"))
    assert found.collect()[0].n == len(want)
    written = shuffled_bytes(found._jdf.queryExecution().executedPlan())
    assert 0 < written < 16 * len(want)


def test_the_given_size_changes_no_result(spark):
    docs = [(1, ["a", "b", "c", "d", "a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, []), (4, None), (5, ["x", "y", "z", "w", None])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").withColumn("size", F.lit(10).cast("int"))
    runs = [W.green_test(df, "doc_id", "tokens", 2, 0.25, key="k", mode="v2", size=s).collect() for s in (None, "size")]
    assert runs[0] == runs[1]
    # (b c, d), (c d, a), (d a, b), (a b, c), (y z, w), (z w, null)
    assert runs[0][0].scored_tokens == 6
