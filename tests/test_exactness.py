"""Large keys, large counts and long inputs, where an approximation would show."""

import random

import pytest
from pyspark.sql import functions as F

from traceaudit.functions import stats as N
from traceaudit.functions.hashing import ordered_hash
from traceaudit.operators import ordering, probes, traffic


def test_positions_of_keys_beyond_doubles(spark):
    base = 1 << 60
    rows = [(base + k // 2, 1000 - k) for k in range(400)] + [(base + 50, 5000 + k) for k in range(300)] + [(7, 1), (-(1 << 62), 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = {(r.a, r.b): r.position for r in ordering.positions(df, ["a", "b"]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), 1)}


def test_beta_cdf_of_large_counts():
    for n in (10**6, 10**9, 10**12):
        # The median of a symmetric beta distribution is 1/2 at any size.
        assert N.beta_cdf(0.5, n / 2, n / 2) == pytest.approx(0.5, abs=2e-6)
    assert N.beta_cdf(0.25 + 1e-6, 0.25e12, 0.75e12) == pytest.approx(0.98953, abs=2e-4)  # 2.3094 standard deviations




def test_answer_letters(spark):
    df = spark.createDataFrame(
        [(1, ["1", "2", "3", "4"], "2", None), (2, ["x", "y"], None, 1), (3, ["x", "y"], None, 5), (4, ["x", "y"], "b", None), (5, ["a", "bb"], "bb", None), (6, ["x", "y"], "0", None)],
        "i int, options array<string>, answer string, answer_index int",
    )
    letters = df.select("i", probes.answer_letter("answer", F.col("options"), F.col("answer_index")).alias("v"))
    assert [r.v for r in letters.orderBy("i").collect()] == ["B", "B", None, "B", "B", None]


def test_too_many_options(spark):
    rows = [(1, "c", "q", [f"o{k}" for k in range(18)], "A"), (2, "c", "q", [f"o{k}" for k in range(16)], "P")]
    df = spark.createDataFrame(rows, "id int, category string, question string, options array<string>, answer string")
    assert [(r.id, r.answer) for r in probes.build_probes(df).collect()] == [(2, "P")]
    assert [(r.rule, r.row_key, r.detail) for r in probes.option_violations(df, "id").collect()] == [("too_many_options", "1", "18")]


def test_normality_of_any_length():
    draw = random.Random(3)
    assert traffic.shapiro_w([draw.gauss(0, 1) for _ in range(20_000)]) > 0.99
    assert traffic.shapiro_w([draw.random() ** 4 for _ in range(20_000)]) < 0.9


def test_two_sided_bounds(spark):
    null = spark.createDataFrame([(float(k),) for k in range(101)], "score double")
    assert traffic.null_bounds(null, 90.0, "two-sided") == pytest.approx((5.0, 95.0))
    assert traffic.null_bounds(null, 90.0, "upper") == (None, pytest.approx(90.0))
    flagged = traffic.flag_outside(null, (5.0, 95.0)).filter("detected")
    assert flagged.count() == 10


def test_windows_per_entity(spark):
    rows = [(k, "a" if k % 3 else "b", [float(k), 0.0]) for k in range(90)]
    df = spark.createDataFrame(rows, "i int, who string, embedding array<double>")
    cut = traffic.windows(df, "i", 7, by=["who"])
    sizes = {(r.who, r.window): r["count"] for r in cut.groupBy("who", "window").count().collect()}
    assert sizes == {("a", w): 7 for w in range(8)} | {("b", w): 7 for w in range(4)}
    nearest = traffic.min_prev_distance(cut, "i", by=["who"]).filter("min_distance is not null")
    assert nearest.filter("who = 'b'").agg(F.min("min_distance"), F.max("min_distance")).first()[:] == (3.0, 3.0)


def test_ordered_hash_of_sparse_positions(spark):
    rows = [((1 << 40) * k + 3, f"t{k}") for k in range(200)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "p bigint, t string")
    a = ordered_hash(df, "p", ["p", "t"], block=8).first()
    b = ordered_hash(df.repartition(3), "p", ["p", "t"], block=8).first()
    assert a == b and a["row_count"] == 200
