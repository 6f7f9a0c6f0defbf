"""File sources, sinks, bundles, catalogue and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from traceaudit.operators import probes, rules, transcripts
from traceaudit.plans import checks
from traceaudit.session import DEFAULTS
from traceaudit.sources import bundles, catalog, jsonl, pools, sinks, tasks
from traceaudit.streaming import monitor as stream


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def test_strict_jsonl(spark, tmp_path):
    path = put(f"{tmp_path}/a.jsonl", '{"id": "1", "x": 1.5}\n\n  \n[1]\n{"id": "2", "x": true}\n{bad\n{"id": "3", "x": NaN}\n')
    rows, broken = jsonl.read_jsonl(spark, path, "id string, x double", strict=False, numbered=True)
    assert {r["id"]: r["line_no"] for r in rows.collect()} == {"1": 1, "3": 7}
    plain, unnumbered = jsonl.read_jsonl(spark, path, "id string, x double", strict=False)
    assert plain.columns == ["file", "id", "x"] and plain.count() == 2
    for each in (broken, unnumbered):
        found = {r["row_key"].rsplit(":", 1)[1]: r["rule"] for r in each.collect()}
        assert found == {"4": "not_an_object", "5": "not_valid_json", "6": "not_valid_json"}
    _, no_nan = jsonl.read_jsonl(spark, path, "id string, x double", strict=False, allow_nan=False)
    assert no_nan.count() == 4
    with pytest.raises(rules.AuditRuleError):
        jsonl.read_jsonl(spark, path, "id string, x double")


def test_line_separators_stay_inside(spark, tmp_path):
    text = "a\u0085b c d"
    df = spark.createDataFrame([("1", text)], "id string, t string")
    jsonl.write_jsonl(df, f"{tmp_path}/out")
    rows, _ = jsonl.read_jsonl(spark, f"{tmp_path}/out", "id string, t string")
    assert rows.first()["t"] == text


def test_line_numbers_over_splits(spark, tmp_path):
    path = put(f"{tmp_path}/big.jsonl", "".join(json.dumps({"id": i}) + "\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, _ = jsonl.read_jsonl(spark, path, "id bigint", numbered=True)
        assert rows.filter("id <> line_no").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pools(spark, tmp_path):
    path = put(f"{tmp_path}/p.json", json.dumps({"meta": {"tier": 3}, "data": [{"id": "a", "prompt": "Hi  There"}, {"id": "", "prompt_id": "b", "query": "x"}, {"prompt": "hi there"}]}))
    rows, meta = pools.read_pool(spark, path)
    assert [(r["prompt_id"], r["prompt_text"]) for r in rows.orderBy("position").collect()] == [("a", "Hi  There"), ("b", "x"), ("row_00000002", "hi there")]
    assert meta.select(F.try_variant_get("meta", "$.tier", "int")).first()[0] == 3
    with pytest.raises(rules.AuditRuleError):
        pools.read_pool(spark, path, unique=True)


def raw(spark, *records):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string").select("i", F.parse_json("j").alias("raw"))


def picked(df, expr):
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_pickers_disagree_on_missing(spark):
    df = raw(spark, {"id": "", "query_id": "q"}, {"id": 0, "query_id": "q"}, {"id": None, "query_id": "q"}, {"id": False}, {"id": "0"})
    get = transcripts.variant_fields("raw")
    keys = ("id", "query_id")
    assert picked(df, transcripts.first_non_null(get, keys)) == ["", "0", "q", "false", "0"]
    assert picked(df, transcripts.first_truthy(get, keys)) == ["q", "q", "q", None, "0"]
    assert picked(df, transcripts.first_filled(get, keys)) == ["q", "0", "q", "false", "0"]
    assert picked(df, transcripts.first_text(get, keys)) == ["", "q", "q", None, "0"]
    assert picked(df, transcripts.first_non_blank(get, keys)) == ["q", "q", "q", None, "0"]


def test_pick_query(spark):
    df = raw(
        spark,
        {"prompt": "  ", "text": " t "},
        {"messages": [{"content": " a "}, {"content": ""}, {"content": 5}, {"content": "b"}]},
        {"request": {"request": {"query": "deep"}}},
        {"messages": [{"content": "  "}], "request": {"query": "never"}},
        {"other": 1},
    )
    found = transcripts.received_queries(df, "raw", "q")
    assert [r.q for r in found.orderBy("i").collect()] == ["t", "a\nb", "deep", "", None]


def test_received_query_at_any_depth(spark):
    rows = []
    for depth in (0, 3, 4, 5, 11):
        row = {"query": f"at {depth}"}
        for _ in range(depth):
            row = {"request": row}
        rows.append(row)
    found = transcripts.received_queries(raw(spark, *rows), "raw", "q")
    assert [r.q for r in found.orderBy("i").collect()] == [f"at {d}" for d in (0, 3, 4, 5, 11)]


def test_budget_in_a_path(spark):
    df = spark.createDataFrame([("/a/d/m/b100/x",), ("/a/d/m/b1" + "0" * 21 + "/x",), ("/a/m/x",)], "path string")
    budgets = [r.b for r in df.select(transcripts.path_identity("path")["budget"].alias("b")).collect()]
    assert budgets == [100, None, None]
    assert [r.rule for r in transcripts.path_violations(df, "path").collect()] == ["budget_out_of_range"]


def test_transcript_record_rules(spark):
    good = {k: "x" for k in transcripts.TRANSCRIPT_FIELDS} | {"decode_config": {"a": 1}}
    df = raw(spark, good, good | {"logits": 1}, good | {"decode_config": "s"}, {"prompt_id": "x"})
    got = {(r["row_key"], r["rule"]) for r in transcripts.record_violations(df, "raw", "i").collect()}
    assert got == {("1", "forbidden_fields"), ("2", "decode_config_not_object"), ("3", "missing_fields"), ("3", "decode_config_not_object")}


def test_prediction_record_rules(spark):
    from traceaudit.operators import capability as A

    good = {k: None for k in A.RECORD_FIELDS} | {
        "request_status": "completed", "parse_status": "success", "generation_config": {k: None for k in A.GENERATION_FIELDS},
    }
    df = raw(
        spark, good, good | {"parse_status": "failed", "parsed_prediction": "x"}, good | {"dataset": "humaneval"},
        good | {"request_status": "odd", "generation_config": {}}, {},
    )
    got = {}
    for r in A.prediction_violations(df, "raw", "i").collect():
        got.setdefault(r["row_key"], set()).add(r["rule"])
    assert got["1"] == {"failed_parse_with_prediction"} and got["2"] == {"code_record_missing_fields"}
    assert got["3"] == {"bad_request_status", "generation_config_missing_fields"} and "missing_fields" in got["4"] and "0" not in got


def test_preferences_report_missing(spark):
    t = spark.createDataFrame([("1", "p", "a"), ("2", "p", ""), ("3", "p", "c"), ("4", "p", "d")], "prompt_id string, prompt string, response string")
    s = spark.createDataFrame([("1", "x", 0), ("1", "y", 1), ("2", "z", 2), ("3", "", 3)], "prompt_id string, response string, position int")
    pairs, stats = transcripts.preference_pairs(t, s)
    assert [(r["prompt_id"], r["rejected"]) for r in pairs.collect()] == [("1", "y")]
    assert {r["status"]: r["n"] for r in stats.collect()} == {"written": 1, "invalid_teacher": 1, "invalid_student": 1, "missing_student": 1}


def test_bundle_round_trip(spark, tmp_path):
    records = spark.range(10).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt_id"), F.lit("t").alias("prompt_text"), F.lit("r").alias("teacher_response"),
        F.col("id").alias("order_index"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.lit("success").alias("query_status"),
    )
    attempts = records.select("query_id", F.lit("success").alias("status"))
    identity = {"prompt_pool_id": "pool", "prompt_pool_hash": "h", "prompt_ordering_hash": "o", "teacher_model_id": "m", "decode_config": {"strategy": "greedy"}, "seed": 1}
    ident = bundles.save_bundle(records, attempts, str(tmp_path), identity, 10, "now")
    loaded, manifest = bundles.load_bundle(spark, str(tmp_path), ident, identity, 4)
    assert loaded.count() == 4 and manifest.first()["successful_queries"] == 10
    with pytest.raises(rules.AuditRuleError, match="seed_differs"):
        bundles.load_bundle(spark, str(tmp_path), ident, identity | {"seed": 2})
    with pytest.raises(rules.AuditRuleError, match="budget_exceeds_records"):
        bundles.load_bundle(spark, str(tmp_path), ident, identity, 11)
    assert transcripts.bundle_violations(records, 10, "greedy").count() == 0
    assert {r["rule"] for r in transcripts.bundle_violations(records, 10, "beam", 3).collect()} == {"beam_width"}


def test_sinks(spark, tmp_path):
    df = spark.range(50).select("id", F.struct(F.lit(1).alias("b"), F.lit("é").alias("a")).alias("s"))
    first = sinks.write_canonical(df, f"{tmp_path}/c", "id", ["s", "id"]).first()
    lines = [line for name in sorted(os.listdir(f"{tmp_path}/c")) if name.startswith("part") for line in open(f"{tmp_path}/c/{name}", encoding="utf-8").read().splitlines()]
    assert lines[3] == '{"id":3,"s":{"a":"é","b":1}}' and len(lines) == 50
    assert sinks.write_canonical(df.repartition(3), f"{tmp_path}/d", "id", ["s", "id"]).first() == first
    sinks.append_valid(df, rules.row_rules(df, "id", [("negative", F.col("id") < 0)]), f"{tmp_path}/t")
    with pytest.raises(rules.AuditRuleError):
        sinks.append_valid(df, rules.row_rules(df, "id", [("small", F.col("id") < 1)]), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 50


def test_sample_files_and_logs(spark, tmp_path):
    put(f"{tmp_path}/s/samples_arc_2024-01-01T00.jsonl", "{}\n")
    time.sleep(0.02)
    newest = put(f"{tmp_path}/s/samples_arc_2024-02-01T00.jsonl", "{}\n")
    put(f"{tmp_path}/s/other.jsonl", "{}\n")
    found = catalog.latest_sample_files(catalog.list_files(spark, f"{tmp_path}/s")).collect()
    assert [(r["task"], catalog_path(r["path"])) for r in found] == [("arc", newest)]
    for name in ("lord/run1/teacher_raw.jsonl", "lord/run1/transcript.jsonl", "qedks/r 2/seed_teacher.jsonl", "qedks/r 2/template_teacher.jsonl", "gad/r3/attack_manifest.json", "gad/r3/seed_teacher.jsonl"):
        put(f"{tmp_path}/attacks/{name}", "{}\n")
    logs = {(r["attack"], r["run_id"], r["name"]) for r in catalog.discover_logs(catalog.list_files(spark, f"{tmp_path}/attacks"), f"{tmp_path}/attacks").collect()}
    assert logs == {
        ("lord", "run1", "teacher_raw.jsonl"), ("qedks", "r_2", "seed_teacher.jsonl"), ("qedks", "r_2", "template_teacher.jsonl"), ("gad", "r3", "attack_manifest.json"),
    }


def catalog_path(path):
    from urllib.parse import unquote

    return unquote(path.replace("file:", "")).replace("//", "/")


def test_run_catalog(spark, tmp_path):
    root = f"{tmp_path}/runs"
    put(f"{root}/seqkd/a/attack_manifest.json", json.dumps({"schema_version": "attack_manifest_v1", "result": {"attack": "seqkd", "budget": 100, "status": "completed", "run_id": "a", "artifacts": {"teacher_transcript": {"jsonl": "t.jsonl"}}}}))
    time.sleep(0.02)
    put(f"{root}/seqkd/b/attack_manifest.json", json.dumps({"run_config": {"attack": "seqkd", "budget": 100}, "status": "dry_run", "result": {"attack": "seqkd"}}))
    put(f"{root}/adfp/seqkd/b1000/x/detector_manifest.json", json.dumps({"detector": "adfp", "attack_run_id": "a"}))
    put(f"{root}/seqkd/a/t.jsonl", "{}\n")
    rows = catalog.run_catalog(spark, root)
    got = {r["run_id"]: (r["kind"], r["attack"], r["budget"], r["defense"]) for r in rows.collect()}
    assert got["a"][:3] == ("attack", "seqkd", 100) and got["adfp_seqkd_b1000_a"] == ("detector", "seqkd", 1000, "adfp")
    newest = {(r["attack"], r["budget"]): r["path"] for r in catalog.latest_run(rows.filter("kind = 'attack'")).collect()}
    assert newest[("seqkd", 100)].endswith("/seqkd/a/attack_manifest.json")
    logs = catalog.resolve_log(rows.filter("kind = 'attack'"), catalog.list_files(spark, root, "*.jsonl")).collect()
    assert [r["path"].endswith("/seqkd/a/t.jsonl") for r in logs] == [True]


def test_compatible_runs(spark):
    schema = "run_id string, created_at string, status string, budget int, student_model string, pool_hash string, ordering_identity string, ordering_hash string, transcript_path string, transcript_hash string, checkpoint string"
    df = spark.createDataFrame(
        [("a", "1", "completed", 5, "s", "p", "i", "h", "/t", "x", "/c"), ("b", "2", "completed", 5, "s", "p", None, "h", "/u", "x", "/c"), ("c", "3", "failed", 6, "s", "p", "j", "h", None, None, None)], schema
    )
    want = {"budget": 5, "student_model": "s", "pool_hash": "p", "ordering_identity": "i", "ordering_hash": "h", "transcript_path": "/t", "transcript_hash": "x"}
    newest, rejected = catalog.compatible_runs(df, want)
    assert newest.first()["run_id"] == "b"
    assert rejected.first()["reasons"] == "status=failed, budget=6, query ordering differs, teacher transcript missing, checkpoint missing or incomplete"


def test_follow_manifests(spark):
    comparisons = spark.createDataFrame([("r1", "adfp", "dipper", "clean", "/b1"), ("r2", "adfp", "translation", "clean", "/b2")], "comparison string, defense string, countermeasure string, condition string, baseline_path string")
    baselines = spark.createDataFrame([("/b1", "ok", "/r1"), ("/b2", "ok", "/r2")], "baseline_path string, status string, run_path string")
    runs = spark.createDataFrame([("/r1", "/c1"), ("/r2", "/c2")], "run_path string, checkpoint string")
    _, broken = catalog.follow_manifests(comparisons, baselines, runs)
    assert {r["rule"] for r in broken.collect()} == {"baseline_differs"}


def example_rows(spark, schema, *rows):
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumns({"split": F.lit("test"), "example_index": F.lit(0)})


def test_adapters(spark):
    arc = tasks.adapt(example_rows(spark, "id string, question string, choices struct<label:array<string>,text:array<string>>, answerKey string", ("x", " Q? ", (["a", "b"], ["one", " two"]), "b")), "arc_challenge").first()
    assert arc["gold_answer"] == "B" and arc["choice_scoring"]["continuations"] == [" one", " two"]
    assert arc["logical_prompt"] == "Question: Q?\nA. one\nB.  two" and arc["rendered_prompt"].endswith("using one of: A, B.")
    swag = tasks.adapt(example_rows(spark, "ctx string, ctx_a string, ctx_b string, endings array<string>, label string", ("", "A man [title] sits", "then", ["x", "y"], "1")), "hellaswag").first()
    assert swag["choice_scoring"]["prompt"] == "A man. sits Then" and swag["gold_answer"] == "B" and swag["example_id"].startswith("hellaswag:test:")
    wino = tasks.adapt(example_rows(spark, "sentence string, option1 string, option2 string, answer string", ("The _ ran.", "cat", "dog", "2")), "winogrande").first()
    assert wino["gold_answer"] == "B" and wino["choice_scoring"]["continuations"] == ["cat ran.", "dog ran."]
    truth = tasks.adapt(example_rows(spark, "question string, mc1_targets struct<choices:array<string>,labels:array<int>>", ("q", (["u", "v"], [0, 1]))), "truthfulqa").first()
    assert truth["gold_answer"] == "B"
    med = tasks.adapt(example_rows(spark, "question string, options array<struct<key:string,value:string>>, answer_idx string", ("q", [("a", "x"), (None, "y")], "b")), "medqa").first()
    assert med["labels"] == ["A", "B"] and med["normalized_gold_answer"] == "B"
    chem = tasks.adapt(example_rows(spark, "text string, label string", ("t\nu", "inhibitor")), "chemprot").first()
    assert chem["normalized_gold_answer"] == "B" and "t u" in chem["logical_prompt"]
    fpb = tasks.adapt(example_rows(spark, "sentence string, label string", ("s", "2")), "fpb").first()
    assert fpb["normalized_gold_answer"] == "positive"
    pub = tasks.adapt(example_rows(spark, "question string, contexts array<string>, final_decision string", ("q", ["c", "d"], "Maybe")), "pubmedqa").first()
    assert pub["normalized_gold_answer"] == "maybe" and "c\n\nd" in pub["logical_prompt"]
    head = tasks.adapt(example_rows(spark, "headline string, label string", ("h", "none")), "headline").first()
    assert head["normalized_gold_answer"] == "none"
    code = tasks.adapt(example_rows(spark, "task_id string, prompt string", ("T/1", "def f():")), "humaneval")
    assert code.first()["example_id"] == "T/1" and tasks.example_violations(code).count() == 0


def test_probe_examples(spark):
    df = spark.createDataFrame([("1", "cs", "Q", ["x", " y ", "", "N/A"], "1", 1)], "probe_id string, category string, question string, options array<string>, answer string, answer_index int")
    shots = spark.createDataFrame([("cs", i, f"E{i}", ["u", "v"], "v", "" if i else "think") for i in range(7)], "category string, position int, question string, options array<string>, answer string, cot_content string")
    row = probes.build_probes(df, ["cs"], shots).withColumn("p", probes.probe_prompt("question", "options", "few_shot_examples")).first()
    assert row["answer"] == "B" and len(row["few_shot_examples"]) == 5
    assert row["p"].startswith(probes.HEADER) and "Question:\nE0\nOptions:\nA. u\nB. v\nAnswer: Let's think step by step. think" in row["p"]
    assert "Answer: Let's think step by step. The answer is (B)." in row["p"] and row["p"].endswith("Question:\nQ\nOptions:\nA. x\nB. y\nAnswer: Let's think step by step.")
    assert probes.build_probes(df.drop("answer_index"), ["cs"]).first()["answer"] is None  # a text is no index
    assert probes.build_probes(df.withColumn("options", F.array(F.lit("x"), F.lit("N/A")))).count() == 0
    matches = spark.createDataFrame([("field_cs",), ("cs",), ("csx",)], "c string").select(probes.category_matches("c", ["CS"]).alias("v"))
    assert [r["v"] for r in matches.collect()] == [True, True, False]


def run_stream(spark, source, make, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", DEFAULTS["spark.sql.streaming.stateStore.providerClass"])
    out, state = f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state"
    q = make(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    schema = "entity_id string, query_index bigint, score double"
    folder = f"{tmp_path}/in"
    first = [("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.9), ("c", 1, 0.0)]
    second = [("a", 2, 0.2), ("a", 3, 0.95), ("a", 4, 0.99), ("b", 2, 0.9), ("c", 3, 0.1), ("c", 4, 0.2)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        out = run_stream(spark, source, lambda s: stream.monitor_stream(s, 0.9, "higher", 4), tmp_path, "m")
    got = {(r["entity_id"], r["kind"], r["query_index"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "detected", 3), ("a", "duplicate", 2), ("b", "detected", 1), ("c", "gap", 3), ("c", "censored", 4)}


def test_stream_windows_over_batches(spark, tmp_path):
    schema = "entity_id string, order bigint, item string, score double"
    folder = f"{tmp_path}/in"
    for low in (0, 4, 8):
        spark.createDataFrame([("e", i, f"i{i}", float(i)) for i in range(low, low + 4)], schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        out = run_stream(spark, source, lambda s: stream.batch_stream(s, 5), tmp_path, "w")
    got = sorted((r["batch"], r["slot"], r["item"]) for r in spark.read.parquet(out).collect())
    assert got == [(i // 5, i % 5, f"i{i}") for i in range(10)]


def test_pool_documents_hold_one_block(spark, tmp_path, monkeypatch):
    """A source larger than a block is written as several pools and read back in one numbering."""
    monkeypatch.setattr(checks, "POOL_BLOCK", 7, raising=False)
    monkeypatch.setattr(checks, "scratch", lambda _: str(tmp_path / "pools"))
    rows = [(k, f"text {k}", None if k % 10 == 9 else "big" if k % 10 else "small") for k in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.position, r.prompt_id, r.prompt_text) for r in checks.source_pool_rows(spark, str(tmp_path)).collect()}
    want = set()
    for source in ("big", "small", None):
        for position, (k, text, _) in enumerate(r for r in rows if r[2] == source):
            want.add((source, position, str(k) if k % 3 else f"row_{position:08d}", text))
    assert got == want
    sizes = [len(json.loads(line)["queries"]) for f in (tmp_path / "pools").rglob("part-*") for line in f.read_text().splitlines()]
    assert sum(sizes) == 100 and max(sizes) == 7
