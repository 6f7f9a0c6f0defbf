"""Nearest earlier query over whole histories, against brute force."""

import random

import numpy as np
import pytest

from traceaudit.operators import history, traffic

SCHEMA = "at int, who string, embedding array<float>, _cell string, distance double"


def histories(seed, count, dim=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dim)) * 3
    x = (centres[draw.integers(0, 5, count)] + draw.normal(size=(count, dim)) * 0.3).astype(np.float32)
    x[count // 4 : count // 2 : 2] = x[0]  # one vector that many rows share
    x[-20:] = x[-40:-20] + np.float32(1e-3)  # repeated late, with a trifle changed
    who = [None if k % 11 == 0 else "hot" if k % 3 else f"a{k % 7}" for k in range(count)]
    rows = [(k, w, v.tolist(), "c", -1.0) for k, (w, v) in enumerate(zip(who, x))]
    odd = [None, [], [float("nan")] * dim, [1.0, None] * (dim // 2), [float("inf")] * dim]
    return rows + [(count + k, "hot", v, None, None) for k, v in enumerate(odd)]


def by_hand(rows, by, metric):
    out, seen = {}, {}
    for at, who, v, *_ in rows:
        known = v and all(x is not None and np.isfinite(x) for x in v) and (metric == "euclidean" or any(v))
        if not known:
            out[at] = None
            continue
        x, earlier = np.array(v, dtype=float), seen.setdefault(who if by else 0, [])
        if metric == "euclidean":
            gaps = [np.sqrt(((x - y) ** 2).sum()) for y in earlier]
        else:
            gaps = [1 - x @ y / np.sqrt((x @ x) * (y @ y)) for y in earlier]
        out[at] = min(gaps, default=None)
        earlier.append(x)
    return out


@pytest.mark.parametrize(("by", "metric", "block"), [([], "euclidean", 4096), ([], "euclidean", 40), (["who"], "euclidean", 40), (["who"], "cosine", 25)])
def test_nearest_earlier_like_by_hand(spark, by, metric, block):
    rows = histories(4, 700)
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA)
    out = history.nearest_earlier_distance(df, ["at"], by=by, metric=metric, pivots=5, rings=4, block_rows=block)
    assert out.columns == [*df.columns, "min_distance"]
    got, want = {r.at: r.min_distance for r in out.collect()}, by_hand(rows, by, metric)
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert got[at] == (None if value is None else pytest.approx(value, abs=1e-7)), at


@pytest.mark.parametrize(("by", "metric"), [([], "euclidean"), (["who"], "cosine")])
def test_histories_of_several_eras(spark, monkeypatch, by, metric):
    """Rows meet the bundles of their own and all earlier eras, and of equal vectors the first one is their neighbour."""
    monkeypatch.setattr(history, "ERA_BYTES", 8 * 6 * 60)
    rows = histories(9, 600)
    out = history.nearest_earlier_distance(spark.createDataFrame(rows, SCHEMA), ["at"], by=by, metric=metric, pivots=5, rings=4, block_rows=16)
    got, want = {r.at: r.min_distance for r in out.collect()}, by_hand(rows, by, metric)
    assert got.keys() == want.keys()
    for at, value in want.items():
        assert got[at] == (None if value is None else pytest.approx(value, abs=1e-7)), at


def test_accounts_stay_together_behind_a_join(spark):
    """A join by account that turns into a broadcast while it runs leaves no account in pieces."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64m"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [r for r in histories(4, 700) if r[1] != "hot"]
        out = history.nearest_earlier_distance(spark.createDataFrame(rows, SCHEMA).repartition(8), ["at"], by=["who"])
        got = {r.at: r.min_distance for r in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for at, value in by_hand(rows, ["who"], "euclidean").items():
        assert got[at] == (None if value is None else pytest.approx(value, abs=1e-7)), at


def test_few_copies_of_a_visitor(spark, monkeypatch):
    """A row goes once to a bundle, however many rings and blocks the history has."""
    taken = []
    visits = history._visits
    monkeypatch.setattr(history, "_visits", lambda rows, keys: taken.append(rows.filter("_bound is not null").count()) or visits(rows, keys))
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "at int, embedding array<float>")
    history.nearest_earlier_distance(df, ["at"], pivots=8, rings=8, block_rows=4)
    assert taken[0] <= history.BUNDLES * 400


def test_no_and_single_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert history.nearest_earlier_distance(none, ["at"]).collect() == []
    one = spark.createDataFrame([(1, "a", [1.0, 2.0], None, None), (2, "b", [1.0, 2.0], None, None)], SCHEMA)
    assert [r.min_distance for r in history.nearest_earlier_distance(one, ["at"], by=["who"]).collect()] == [None, None]


def test_rings_leave_out_only_what_is_too_far():
    """Whatever ring holds a row within the bound is visited, and most others are not."""
    draw = np.random.default_rng(7)
    x = np.concatenate([draw.normal(size=(300, 4)) * 0.2 + c for c in draw.normal(size=(6, 4)) * 5])
    index = history.Rings(x[::3], 8, 5)
    cell, radius, _ = index.place(x)
    ring = index.ring(cell, radius)
    bound = draw.uniform(0.05, 1.0, len(x))
    reach = index.reachable(x, bound)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    row, other = np.nonzero(far < bound[:, None])
    assert reach[row, cell[other], ring[other]].all()
    assert reach.mean() < 0.5


def test_exact_percentile(spark):
    draw = random.Random(3)
    values = [draw.choice([0.0, 0.25, draw.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "score double")
    for percentile in (0.0, 12.5, 50.0, 95.0, 100.0):
        assert traffic.exact_percentile(df, "score", percentile) == pytest.approx(np.percentile(values, percentile))
    assert traffic.exact_percentile(df.limit(0), "score", 50.0) is None
