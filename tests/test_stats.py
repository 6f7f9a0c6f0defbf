"""Detectors, thresholds, monitoring and cost on hand-computed examples and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traceaudit.functions import stats as N
from traceaudit.operators import capability, cost, fidelity, monitor, ordering, provenance, quality, retention, rules, traffic


def scores(spark, positives, negatives, direction="higher"):
    rows = [(f"p{i}", "positive", s) for i, s in enumerate(positives)] + [(f"n{i}", "negative", s) for i, s in enumerate(negatives)]
    df = spark.createDataFrame(rows, "id string, label string, score double")
    return df.withColumns({"direction": F.lit(direction), "detector": F.lit("d")})


def test_binomial_bound():
    assert N.upper_bound(0, 299) < 0.01 < N.upper_bound(0, 298)
    assert N.upper_bound(950, 100000) == pytest.approx(0.01002024, abs=1e-8)
    assert N.upper_bound(5, 5) == 1.0
    with pytest.raises(ValueError):
        N.upper_bound(1, 0)


def test_beta_cdf_matches_sum():
    for k, n, p in [(3, 10, 0.25), (40, 100, 0.5), (1, 7, 0.9)]:
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert N.beta_cdf(p, k, n - k + 1) == pytest.approx(tail, rel=1e-10)


def test_green_p(spark):
    row = spark.createDataFrame([(25, 100), (0, 0)], "k long, n long").select(
        N.green_z("k", "n", 0.25).alias("z"), N.green_p_normal("k", "n", 0.25).alias("p"), N.green_p_exact("k", "n", 0.25).alias("e")
    ).collect()
    assert row[0]["z"] == 0.0 and row[0]["p"] == pytest.approx(0.5)
    assert row[1]["p"] == 1.0 and row[1]["e"] == 1.0


def test_calibration(spark):
    got = provenance.calibrate(scores(spark, [], [0.1, 0.2, 0.3, 0.4]), 0.25, "higher").first()
    assert got["threshold"] == 0.3 and got["false_positives"] == 1
    low = provenance.calibrate(scores(spark, [], [0.6, 0.7, 0.8, 0.9]), 0.25, "lower").first()
    assert low["threshold"] == 0.7


def test_calibration_random(spark):
    rng = random.Random(3)
    values = [round(rng.random(), 1) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for fpr in (0.0, 0.13, 0.5):
        want = min(t for t in set(values) if sum(v > t for v in values) / len(values) <= fpr)
        assert provenance.calibrate(df, fpr, "higher").first()["threshold"] == want


def test_auc_random(spark):
    rng = random.Random(4)
    pos, neg = [rng.randrange(12) / 2 for _ in range(60)], [rng.randrange(12) / 2 for _ in range(90)]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert provenance.roc_auc(scores(spark, pos, neg)).first()["roc_auc"] == pytest.approx(want)
    assert provenance.roc_auc(scores(spark, pos, neg), "lower").first()["roc_auc"] == pytest.approx(1 - want)
    assert provenance.roc_auc(scores(spark, [1.0], [1.0])).first()["roc_auc"] == 0.5


def test_detector_report_withholds(spark):
    test = scores(spark, [0.2, 0.5], [0.3, 0.35])
    calibration = scores(spark, [], [0.1, 0.2, 0.3, 0.4])
    row = provenance.detector_report(test, calibration, 0.25, "higher").first()
    assert (row["threshold"], row["tpr"], row["fpr"]) == (0.3, 0.5, 0.5)
    assert row["tpr_at_target_fpr"] is None and len(row["withheld_reasons"]) == 3
    own = provenance.detector_report(test, None, 0.25, "higher").first()
    assert own["withheld_reasons"][0] == provenance.NEEDS_CALIBRATION


def test_score_rules(spark):
    df = spark.createDataFrame(
        [("a", "positive", 1.0, "higher", "d"), ("a", "odd", float("nan"), "higher", " ")],
        "id string, label string, score double, direction string, detector string",
    )
    names = {r["rule"] for r in provenance.score_violations(df).collect()}
    assert names == {"duplicate_id", "bad_label", "score_not_finite", "missing_detector", "mixed_detector"}
    with pytest.raises(rules.AuditRuleError):
        rules.enforce(provenance.score_violations(df), "scores")


def test_fingerprints(spark):
    schema = "model_id string, id string, response string, expected string, detector string"
    suspect = spark.createDataFrame([("s", "1", "a", "a", "d"), ("s", "2", "b", "b", "d")], schema)
    negatives = spark.createDataFrame([("m", "1", "x", "a", "d"), ("m", "2", "y", "b", "d"), ("n", "1", "x", "a", "d"), ("n", "2", "b", "b", "d")], schema)
    row = provenance.fingerprint_report(suspect, negatives, 0.5).first()
    assert (row["fsr"], row["fpr"], row["uniqueness"], row["flagged"]) == (1.0, 0.0, 1.0, True)
    assert provenance.trigger_set_violations(suspect, negatives).count() == 0
    assert provenance.trigger_set_violations(suspect, negatives.filter("id = '1'")).count() == 2


def test_common_probes(spark):
    rows = [("a", "1", "A", "A"), ("a", "2", "B", None), ("b", "1", "A", "C"), ("b", "2", "B", "B")]
    df = spark.createDataFrame(rows, "model string, probe_id string, teacher_choice string, student_choice string")
    got = {r["model"]: r for r in provenance.similarity_summary(df, "b").collect()}
    assert (got["a"]["score"], got["b"]["score"], got["a"]["common_valid_probes"]) == (1.0, 0.0, 1)


def test_finalized_rows(spark):
    df = spark.createDataFrame([("m", "WM", 3.0, 0.01), ("n", "odd", 1.0, None)], "student string, label string, score double, p_value double")
    got = {r["model_id"]: r for r in provenance.finalize_scores(df, "radioactivity").collect()}
    assert (got["m"]["label"], got["m"]["label_raw"], got["m"]["score"], got["m"]["green_score"]) == ("positive", "WM", 0.01, 3.0)
    assert (got["m"]["direction"], got["m"]["id"], got["n"]["label"], got["n"]["label_raw"]) == ("lower", "radioactivity:m", "odd", "odd")


def test_retention(spark):
    before, after = scores(spark, [0.9, 0.8], [0.1, 0.2]), scores(spark, [0.9, 0.3], [0.1, 0.2])
    row = retention.detector_retention(before, after, 0.5, 0.25, "higher", True).first()
    assert (row["before"], row["after"], row["signal_loss"], row["retention_ratio"], row["evasion_rate"]) == (1.0, 0.5, 0.5, 0.5, 0.5)
    assert not row["fixed_fpr_available"] and row["fixed_fpr_retention_ratio"] is None
    none = retention.detector_retention(scores(spark, [0.1], [0.0]), scores(spark, [0.9], [0.0]), 0.5, 0.25, "higher", True).first()
    assert none["retention_ratio"] is None


def benign_scores(spark, values):
    return spark.createDataFrame([(f"e{i}", v) for i, v in enumerate(values)], "entity_id string, score double")


def test_entity_threshold(spark):
    locked = monitor.entity_threshold(benign_scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), 0.2, "higher")
    assert tuple(locked) == (0.5, 5, 1)
    strict = monitor.entity_threshold(benign_scores(spark, [0.1, 0.2]), 0.01, "higher")
    assert strict.value == math.nextafter(0.2, math.inf) and strict.false_positives == 0
    low = monitor.entity_threshold(benign_scores(spark, [0.1, 0.2]), 0.01, "lower")
    assert low.value == math.nextafter(0.1, -math.inf)


def events(spark, rows):
    df = spark.createDataFrame(rows, "entity_id string, label string, query_index bigint, score double, attack_type string")
    return df.withColumns({"detector": F.lit("v1"), "monitor_mode": F.lit("per-account")})


def test_monitor_report(spark):
    calibration = events(spark, [(f"c{i}", "benign", q, s if q == 3 else 0.0, None) for i, s in enumerate((0.1, 0.2, 0.3, 0.4, 0.5)) for q in (1, 2, 3)])
    evaluation = events(
        spark,
        [("b1", "benign", q, 0.1, None) for q in (1, 2, 3)]
        + [("b2", "benign", q, 0.6, None) for q in (1, 2, 3)]
        + [("fast", "attacker", 1, 0.2, "x"), ("fast", "attacker", 2, 0.9, "x")]
        + [("slow", "attacker", q, 0.2, "y") for q in (1, 2, 3)],
    )
    row = monitor.monitor_report(calibration, evaluation, 0.2, 3).first()
    assert (row["threshold"], row["actual_fpr"], row["tpr_at_locked_threshold"], row["roc_auc"]) == (0.5, 0.5, 0.5, None)
    found = {r["entity_id"]: r for r in monitor.first_detection(evaluation, 0.5, "higher").collect()}
    assert found["fast"]["queries_to_detection"] == 2 and found["slow"]["censor_at"] == 3


def test_monitor_evidence(spark):
    def benign(tag, base):
        return [(f"{tag}{i}", "benign", q, base, None) for i in range(20) for q in (1, 2)]

    evaluation = events(spark, benign("e", 0.0) + [("a", "attacker", q, 0.9, "x") for q in (1, 2)])
    row = monitor.monitor_report(events(spark, benign("c", 0.1)), evaluation, 0.2, 2).first()
    assert row["tpr_at_fixed_fpr"] == 1.0 and row["roc_auc"] == 1.0 and row["withheld_reasons"] == []


def test_series_rules(spark):
    rows = [("a", "benign", q, 0.0, None) for q in (1, 1, 4, 4)] + [("b", "benign", 1, 0.0, None), ("b", "attacker", 2, 0.0, "x"), ("c", "benign", 2, 0.0, None)]
    got = {(r["rule"], r["row_key"]) for r in monitor.series_violations(events(spark, rows)).collect()}
    assert {("duplicate_query_index", "a"), ("query_index_gap", "a"), ("attribute_changes", "b"), ("query_index_gap", "c")} <= got


def test_positions_with_a_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", 5 if rng.random() < 0.4 else rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g string, v int").repartition(5)
    got = {r["id"]: r["position"] for r in ordering.positions(df, ["v", "id"], by=["g"]).collect()}
    want = {}
    for group in {r[1] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[1] == group), key=lambda r: (r[2], r[0])), 1):
            want[row[0]] = place
    assert got == want
    whole = {r["id"]: r["position"] for r in ordering.positions(df, ["v", "id"]).collect()}
    assert whole == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}


def test_exact_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), float(rng.randrange(20))) for _ in range(301)]
    got = {r["g"]: r["median"] for r in ordering.exact_medians(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        n = len(values)
        assert got[g] == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_repetition_policies(spark):
    df = spark.createDataFrame([("1", "a b a b"), ("2", ""), ("3", "x")], "id string, text string")
    zero = quality.repetition(df, "text", (2,)).first()
    assert zero["rep_2"] == pytest.approx(1 / 9) and zero["short_2"] == 2
    assert quality.repetition(df, "text", (2,), short_policy="exclude").first()["rep_2"] == pytest.approx(1 / 3)


def test_choose(spark):
    df = spark.createDataFrame([([-1.0, -1.5], [" a", " a much longer option"])], "s array<double>, c array<string>")
    row = df.select(fidelity.choose(F.col("s"), F.col("c")).alias("norm"), fidelity.choose(F.col("s")).alias("raw")).first()
    assert (row["norm"], row["raw"]) == (1, 0)


def test_agreement_modes(spark):
    t = spark.createDataFrame([("arc", "1", "none", "s", 0), ("arc", "2", "none", "s", 1)], "task string, doc_id string, filter string, signature string, prediction int")
    s = t.withColumn("prediction", F.lit(0))
    rates, coverage = fidelity.agreement(t, s)
    assert {r["task"]: r["agreement_rate"] for r in rates.collect()} == {None: 0.5, "arc": 0.5}
    with pytest.raises(rules.AuditRuleError):
        fidelity.agreement(t, s.filter("doc_id = '1'"))
    _, partial = fidelity.agreement(t, s.filter("doc_id = '1'"), allow_partial=True)
    assert partial.first().asDict() == {"teacher_only": 1, "student_only": 0, "n": 1}


def test_judgments(spark):
    rows = [("1", "A", "A", "B", "B", 10, 10), ("2", "A", "A", "B", "A", 2, 10), ("3", "A", "tie", "B", "TIE", 30, 10), ("4", "A", "B", "B", "A", 10, 10)]
    df = spark.createDataFrame(rows, "id string, fp string, fw string, rp string, rw string, cl int, rl int").select(
        "id", F.struct(F.col("fp").alias("candidate_position"), F.col("fw").alias("winner")).alias("forward"),
        F.struct(F.col("rp").alias("candidate_position"), F.col("rw").alias("winner")).alias("reverse"),
        quality.TOKENIZERS and F.col("cl"), "rl",
    )
    from traceaudit.functions.text import length_group

    decided = quality.judgments(df).withColumn("length_group", length_group(F.col("cl"), F.col("rl"), 0.8, 1.25))
    assert [r["outcome"] for r in decided.orderBy("id").collect()] == ["candidate", "tie", "tie", "reference"]
    report = quality.judge_report(decided)
    overall = report.filter("length_group is null").first()
    assert overall["candidate_tie_adjusted_win_rate"] == 0.5 and overall["position_disagreement_ties"] == 1
    assert quality.length_controlled(report).first()[0] == pytest.approx(0.5)
    assert quality.judgment_violations(df).count() == 0


def cost_row(**given):
    base = dict.fromkeys((*cost.AMOUNT_FIELDS, *cost.COUNT_FIELDS))
    return {"id": "r", "stage": "attack", "currency": "USD", "price_as_of": "2026", "api_billing": "none", **base, **given}


def cost_frame(spark, *rows):
    fields = ["id", "stage", "currency", "price_as_of", "api_billing"]
    schema = ", ".join([f"{f} string" for f in fields] + [f"{f} double" for f in cost.AMOUNT_FIELDS] + [f"{f} double" for f in cost.COUNT_FIELDS])
    order = fields + list(cost.AMOUNT_FIELDS) + list(cost.COUNT_FIELDS)
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)


def test_costs(spark):
    df = cost_frame(
        spark,
        cost_row(id="q", api_billing="per_query", query_count=10.0, price_per_query=0.5, data_cost=1.0),
        cost_row(id="t", api_billing="tokens", input_tokens=2e6, output_tokens=1e6, input_price_per_million_tokens=3.0, output_price_per_million_tokens=4.0, gpu_hours=2.0, gpu_price_per_hour=1.5),
        cost_row(id="u", api_billing="unknown", query_count=5.0, gpu_hours=1.0),
    )
    got = {r["id"]: r for r in cost.cost_records(df).collect()}
    assert got["q"]["api_cost"] == 5.0 and got["q"]["known_subtotal"] == 6.0 and "gpu_cost" in got["q"]["unknown_components"]
    assert got["t"]["api_cost"] == 10.0 and got["t"]["gpu_cost"] == 3.0
    assert got["u"]["api_cost"] is None and got["u"]["gpu_cost"] is None and got["u"]["reported_cost_dimensions"] == ["queries", "gpu_hours"]
    assert cost.cost_violations(df).count() == 0


@pytest.mark.parametrize(
    "given, rule",
    [
        ({"query_count": -1.0, "gpu_hours": 1.0}, "bad_query_count"),
        ({"query_count": 1.5, "gpu_hours": 1.0}, "query_count_not_integer"),
        ({"price_per_query": 1.0, "query_count": 2.0}, "price_without_billing"),
        ({"api_billing": "tokens", "input_tokens": 1.0, "gpu_hours": 1.0}, "tokens_incomplete"),
        ({"api_billing": "unknown", "query_count": 1.0}, "fewer_than_two_dimensions"),
        ({"api_billing": "odd", "query_count": 1.0, "gpu_hours": 1.0}, "bad_billing_mode"),
    ],
)
def test_cost_rules(spark, given, rule):
    assert rule in {r["rule"] for r in cost.cost_violations(cost_frame(spark, cost_row(**given))).collect()}


def test_queries_to_target(spark):
    rows = [("a", 100, 0.5), ("a", 200, 0.9), ("b", 100, 0.1), ("c", 5000, 1.0)]
    got = {r["method"]: r for r in cost.queries_to_target(spark.createDataFrame(rows, "method string, budget bigint, value double"), 0.8, 1000, True).collect()}
    assert (got["a"]["display"], got["b"]["display"], got["c"]["display"]) == ("200", ">100", "unavailable")


def test_latest_ties(spark):
    rows = [("m", "d", "s", "1", "t1", 1, "old"), ("m", "d", "s", "1", "t1", 2, "new"), ("m", "d", "s", "1", None, 3, "none")]
    df = spark.createDataFrame(rows, "model_key string, dataset string, split string, example_id string, timestamp_utc string, seq int, v string")
    assert capability.latest(df, "seq").first()["v"] == "new"


def test_accuracy_types(spark):
    df = spark.createDataFrame([("a", "1", "1.0"), ("a", "1", '"1"'), ("b", "true", "1"), ("b", '"x"', '"x"')], "task string, p string, t string")
    rows = df.select("task", F.parse_json("p").alias("prediction"), F.parse_json("t").alias("target"))
    assert {r["task"]: r["accuracy"] for r in capability.accuracy(rows).collect()} == {None: 0.5, "a": 0.5, "b": 0.5}
    assert capability.accuracy_violations(rows, "prediction", "target", "task", "task").count() == 0


def test_capability_tables(spark):
    rows = [("m", "humaneval", "s", str(i), "t", i, "completed", st, None, 1.0 * i, False) for i, st in enumerate(("success", "failed"))]
    rows += [("m", "gsm8k", "s", str(i), "t", i, "completed", "success", ok, 2.0, False) for i, ok in enumerate((True, False))]
    df = spark.createDataFrame(rows, "model_key string, dataset string, split string, example_id string, timestamp_utc string, seq int, request_status string, parse_status string, correct boolean, latency_seconds double, execution_enabled boolean")
    df = df.withColumns({c: F.lit(None).cast("bigint") for c in ("input_tokens", "output_tokens", "total_tokens")})
    models = spark.createDataFrame([("m",), ("idle",)], "model_key string")
    out = capability.tables(df, "seq", models)
    cells = {r["dataset"]: r for r in out["per_dataset"].collect()}
    assert cells["humaneval"]["metric_name"] == "completion_extraction_rate" and cells["humaneval"]["score"] == 0.5
    assert cells["humaneval"]["median_latency_seconds"] == 0.5 and cells["gsm8k"]["completion_extraction_success_count"] is None
    grid = {r["model_key"]: r for r in out["overall_matrix"].collect()}
    assert grid["m"]["gsm8k"] == 0.5 and grid["idle"]["gsm8k"] is None
    assert out["matrix_long"].count() == 26 and out["per_model"].filter("model_key = 'idle'").first()["attempted_count"] == 0


def test_shapiro():
    values = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert traffic.shapiro_w(values) == pytest.approx(0.79, abs=0.005)
    rng = random.Random(0)
    assert traffic.shapiro_w([rng.gauss(0, 1) for _ in range(100)]) > 0.96


def test_kernel_statistic_prefers_the_same_distribution():
    import numpy as np

    rng = np.random.default_rng(0)
    blocks = rng.normal(size=(3, 40, 8))
    reference = traffic.KernelReference(blocks, 4.0, False)
    assert reference.statistic(rng.normal(size=(40, 8))) < 0.02 < reference.statistic(rng.normal(loc=2.0, size=(40, 8)))
    x, y = blocks[0][:3], blocks[1][:3]

    def k(a, b):
        return math.exp(-sum((p - q) ** 2 for p, q in zip(a, b)) / (2 * 16.0))

    def off(z):
        return sum(k(z[i], z[j]) for i in range(3) for j in range(3) if i != j) / 6

    want = off(x) + off(y) - 2 * sum(k(a, b) for a in x for b in y) / 9
    assert traffic.KernelReference(y[None], 4.0, False).statistic(x) == pytest.approx(want)


def test_registered_scorer(spark):
    @provenance.register_scorer("seat")
    def scorer(df):
        return df.select("model_id", F.col("share").alias("score"), F.lit("clean").alias("label"))

    row = provenance.run_scorer("seat", spark.createDataFrame([("m", 0.5)], "model_id string, share double"), defense_run_id="r").first()
    assert (row["id"], row["label"], row["direction"], row["defense_run_id"], row["score"]) == ("seat:m", "negative", "higher", "r", 0.5)


def test_clean_rows_with_a_hot_text(spark):
    from traceaudit.operators import corpus

    rng = random.Random(9)
    rows = [(i, "Same  TEXT" if i % 3 == 0 else f"text {rng.randrange(400)}", f"s{i % 4}") for i in range(1500)]
    evaluation = [(10_000 + i, f"TEXT\t{i}", "eval") for i in range(50)]
    schema = "id bigint, text string, source string"
    df, held = spark.createDataFrame(rows, schema).repartition(6), spark.createDataFrame(evaluation, schema)
    seen, want = {" ".join(t.lower().split()) for _, t, _ in evaluation}, {}
    for i, text, source in rows:
        key = " ".join(text.lower().split())
        if key not in seen:
            want.setdefault(key, (i, source))
    got = corpus.clean_rows(df, held, "text", "id", ["source"])
    assert sorted((r["id"], r["source"]) for r in got.collect()) == sorted(want.values())
    kept = corpus.decontaminate(corpus.dedup(df, "text", "id"), held, "text")
    assert sorted(r["id"] for r in kept.collect()) == sorted(i for i, _ in want.values())
    ordered = corpus.seeded_order(got, "id", 3)
    assert sorted(r["position"] for r in ordered.collect()) == list(range(1, len(want) + 1))
    prefix = corpus.budget_prefixes(ordered, (100, 10_000)).collect()
    assert [(r["actual"], r["insufficient_data"]) for r in prefix] == [(100, False), (len(want), True)]
    assert corpus.held_out_violations(held, got.join(df.select("id", "text"), "id"), "text").count() == 0
    blocks = corpus.holdout_blocks(ordered, 100, 50, [2, 3])
    assert corpus.block_violations(blocks.withColumn("text", F.lit("t")), ordered, 100, 50, [2, 3], "id", "text").count() == 0
    with pytest.raises(ValueError):
        corpus.holdout_blocks(ordered, 101, 50, [2])


def test_mixing_and_allocation(spark):
    from traceaudit.operators import corpus

    assert corpus.mix_quotas(80, 100, 0.8) == (80, 20)
    assert corpus.mix_quotas(1000, 10, 0.8) == (40, 10)
    assert corpus.mix_quotas(0, 10, 0.8) == (0, 10)
    assert corpus.mix_quotas(10, 5, 1.0) == (10, 0)
    weights = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "stratum string, weight bigint")
    got = {r["stratum"]: r["quota"] for r in corpus.largest_remainder(weights, 4).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
