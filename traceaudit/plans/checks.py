"""Record rules, small sinks and lineage helpers over the standard tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from traceaudit.functions import hashing
from traceaudit.operators import capability, cost, fidelity, provenance, quality
from traceaudit.operators import transcripts as X
from traceaudit.operators.ordering import running_totals
from traceaudit.operators.rules import row_rules
from traceaudit.operators.transcripts import pool_id, variant_fields
from traceaudit.plans.corpus import key_sql
from traceaudit.plans.registry import Catalog, table
from traceaudit.session import checkpoint_root, materialise
from traceaudit.sources import bundles, catalog, jsonl, large_pools, pools, sinks

CATALOG = Catalog()
query = CATALOG.query


def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/checks/{uuid.uuid4().hex}"


# Sources


@query(
    "source_jsonl_typed",
    """SELECT 'row' AS kind, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'not_valid_json', count(*)::BIGINT, NULL FROM documents WHERE doc_id % 7 = 0""",
)
def source_jsonl_typed(spark, sf_dir):
    """Documents as lines in which every seventh has a boolean for a number."""
    rows = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string")).otherwise("true")
    line = F.concat(F.lit('{"text": '), F.to_json(F.array("text")), F.lit(', "n_chars": '), number, F.lit("}"))
    path = scratch(spark)
    rows.select(line.alias("value")).write.text(path)
    good, broken = jsonl.read_jsonl(spark, path, "text array<string>, n_chars bigint", strict=False)
    counted = good.agg(F.lit("row").alias("kind"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    faults = broken.groupBy(F.col("rule").alias("kind")).agg(F.count("*").alias("n")).withColumn("chars", F.lit(None).cast("bigint"))
    return counted.unionByName(faults)


#: Not a number and the infinities as JSON lines write them, and separators that are no line ends in such files.
LINE_NUMBERS, LINE_MARKS = ("NaN", "Infinity", "-Infinity"), ("\u2028", "\u2029", "\x85", "\x1e")


@query(
    "source_jsonl_odd_lines",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE 'number' END AS score,
md5(coalesce(text, '') || [chr(8232), chr(8233), chr(133), chr(30)][doc_id % 4 + 1] || 'x') AS digest, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents""",
)
def source_jsonl_odd_lines(spark, sf_dir):
    """Whole texts with a separator behind them that Python would split at, and scores beyond the numbers, line by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    mark = F.get(F.array(*map(F.lit, LINE_MARKS)), kind.cast("int"))
    number = F.coalesce(F.get(F.array(*map(F.lit, LINE_NUMBERS)), kind.cast("int")), F.lit("0.5"))
    # JSON leaves these marks as they are; its own escapes stand for line feeds.
    body = F.to_json(F.struct("doc_id", F.concat(F.coalesce("text", F.lit("")), mark, F.lit("x")).alias("text")))
    line = F.concat(F.lit('{"score": '), number, F.lit(", "), F.substr(body, F.lit(2)))
    path = scratch(spark)
    docs.withColumn("value", line).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    rows, _ = jsonl.read_jsonl(spark, path, "doc_id bigint, score double, text string", numbered=True)
    score = F.when(F.isnan("score"), "nan").when(F.col("score") == float("inf"), "inf").when(F.col("score") == float("-inf"), "-inf").otherwise("number")
    # Texts are read once; only their digests are stored, counted and joined.
    rows = materialise(rows.select("file", "line_no", "doc_id", score.alias("score"), F.md5("text").alias("digest")))
    # Files follow each other by name, so lines of earlier files count.
    sizes = rows.groupBy("file").agg(F.max("line_no").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "file").select("doc_id", "score", "digest", (F.col("_before") + F.col("line_no")).alias("line_no"))


#: Documents of a source that one JSON pool holds at most, and bytes of text before its last one.
POOL_BLOCK, POOL_BYTES = 1024, 32 << 20

POOL = """WITH p AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents)"""


@query(
    "source_pool_rows",
    f"{POOL} SELECT source, position::BIGINT AS position, CASE WHEN doc_id % 3 = 0 THEN format('row_{{:08d}}', position) ELSE doc_id::VARCHAR END AS prompt_id, text AS prompt_text FROM p",
)
def source_pool_rows(spark, sf_dir):
    """JSON pools of a source, bounded in documents and in bytes, some records without id."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    # The key is never null, so documents without source are numbered too.
    keyed = docs.withColumn("_pool", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = keyed.withColumns({"_one": F.lit(1), "_bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    numbered = running_totals(sized, "doc_id", {"_one": "position", "_bytes": "_upto"}, by=["_pool"], sample_of=docs.select("doc_id"))
    record = F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("prompt"))
    path = scratch(spark)
    parts = (F.col("position") - 1) / POOL_BLOCK, (F.col("_upto") - F.col("_bytes")) / POOL_BYTES
    block = F.concat_ws("-", *[F.floor(part).cast("string") for part in parts])
    pool = numbered.groupBy("source", block.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", record.alias("r")))), lambda x: x["r"]).alias("queries"),
        (F.min("position") - 1).alias("first"),
    )
    meta = F.struct(F.col("source").alias("name"), "first")
    pool.select("source", "block", F.to_json(F.struct("queries", meta.alias("meta"))).alias("value")).write.partitionBy(
        "source", "block"
    ).option("lineSep", "\n").text(path)
    rows, meta = pools.read_pool(spark, path)
    named = meta.select(
        "path", F.try_variant_get("meta", "$.name", "string").alias("source"), F.try_variant_get("meta", "$.first", "bigint").alias("_first")
    )
    placed = rows.join(named, "path").withColumn("position", F.col("_first") + F.col("position"))
    # A record without id is named by its place in the source, not in its block.
    prompt_id = pool_id(variant_fields("raw"), "position")
    return placed.select("source", "position", prompt_id.alias("prompt_id"), "prompt_text")


#: What the records of the large pools hold beside their text: nothing in it is structure.
POOL_NOTE = '}],{"queries": [\\"[{,'


@query(
    "source_large_pool_rows",
    """SELECT doc_id::VARCHAR AS prompt_id, text AS prompt_text, lang AS note_lang, 'documents' AS pool, true AS in_place FROM documents""",
)
def source_large_pool_rows(spark, sf_dir):
    """All documents as JSON pools of any size, one per writing task, read by as many tasks as they have splits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    here = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    note = F.struct(F.lit(POOL_NOTE).alias("text"), F.array("lang").alias("langs"))
    record = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"), note.alias("note"), here.alias("at"))
    path = scratch(spark)
    large_pools.write_large_pool(docs.select(F.to_json(record).alias("record")), path, '{"name": "documents", "of": [1, {"a": "]"}]}')
    rows, meta = large_pools.read_large_pool(spark, path)
    names = meta.select("path", F.try_variant_get("meta", "$.name", "string").alias("pool"))
    at, lang = (F.try_variant_get("raw", p, k) for p, k in (("$.at", "bigint"), ("$.note.langs[0]", "string")))
    return rows.join(names, "path").select(
        "prompt_id", "prompt_text", lang.alias("note_lang"), "pool", (at == F.col("position")).alias("in_place")
    )


@query(
    "source_pool_violations",
    f"""SELECT 'empty_prompt' AS rule, count(*) FILTER (text = '')::BIGINT AS n FROM documents HAVING count(*) FILTER (text = '') > 0
UNION ALL SELECT 'duplicate_id', count(*)::BIGINT FROM (SELECT lang, doc_id % 50 AS k FROM documents GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_prompt', count(*)::BIGINT FROM (SELECT lang, {key_sql('text')} AS k FROM documents GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0""",
)
def source_pool_violations(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("path"), (F.col("doc_id") % 50).cast("string").alias("prompt_id"), F.col("text").alias("prompt_text")
    )
    return pools.pool_violations(pool).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "catalog_latest_samples",
    """WITH f AS (SELECT event_type || '_' || (user_id % 5) AS task, event_id, ts FROM events WHERE event_id % 11 <> 0)
SELECT task, '/runs/' || arg_max(event_id, (ts, '/runs/' || event_id)) AS folder FROM f GROUP BY 1""",
)
def catalog_latest_samples(spark, sf_dir):
    """Events as sample files; every eleventh has another name."""
    task = F.concat_ws("_", "event_type", (F.col("user_id") % 5).cast("string"))
    stem = F.when(F.col("event_id") % 11 == 0, F.lit("results_")).otherwise(F.lit("samples_"))
    name = F.concat(stem, task, F.lit("_2025-01-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("T10-00.jsonl"))
    files = table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.lit("/runs"), F.col("event_id").cast("string"), name).alias("path"), name.alias("name"), F.col("ts").alias("mtime")
    )
    found = catalog.latest_sample_files(files)
    return found.select("task", F.regexp_extract("path", "^(/runs/[0-9]+)/", 1).alias("folder"))


@query(
    "catalog_discovered_logs",
    """WITH f AS (SELECT user_id, event_type, event_id % 4 AS k FROM events), n AS (SELECT user_id, event_type, k, CASE k WHEN 0 THEN 'transcript.jsonl' WHEN 1 THEN 'seed_teacher.jsonl' WHEN 2 THEN 'attack_manifest.json' ELSE 'other.txt' END AS name FROM f GROUP BY 1, 2, 3),
g AS (SELECT user_id, event_type, bool_or(k = 0) AS whole, bool_or(k = 2) AS manifest FROM n GROUP BY 1, 2)
SELECT event_type AS attack, 'run' || user_id AS run_id, name FROM n JOIN g USING (user_id, event_type) WHERE k < 3 AND CASE WHEN whole THEN k = 0 WHEN manifest THEN k = 2 ELSE k = 1 END""",
)
def catalog_discovered_logs(spark, sf_dir):
    kind = F.col("event_id") % 4
    name = F.when(kind == 0, "transcript.jsonl").when(kind == 1, "seed_teacher.jsonl").when(kind == 2, "attack_manifest.json").otherwise("other.txt")
    run = F.concat(F.lit("run"), F.col("user_id").cast("string"))
    files = table(spark, sf_dir, "events").select(F.concat_ws("/", F.lit("/data/attacks"), "event_type", run, name).alias("path"), name.alias("name"))
    return catalog.discover_logs(files.distinct(), "/data").select("attack", "run_id", "name")


@query(
    "catalog_run_manifests",
    """SELECT event_type AS attack, max(user_id)::BIGINT AS budget, 'attack' AS kind, 'run_' || event_type AS run_id, 'completed' AS status FROM events GROUP BY 1""",
)
def catalog_run_manifests(spark, sf_dir):
    """A manifest per event type, written and read back."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("user_id").alias("budget"))
    inner = F.struct(
        F.col("event_type").alias("attack"), "budget", F.concat(F.lit("run_"), "event_type").alias("run_id"), F.lit("completed").alias("status")
    )
    path = scratch(spark)
    body = F.to_json(F.struct(F.lit("attack_manifest_v1").alias("schema_version"), inner.alias("result")))
    rows.select(body.alias("value"), "event_type").repartition("event_type").write.partitionBy("event_type").text(path)
    return catalog.run_catalog(spark, path, "*.txt").select("attack", "budget", "kind", "run_id", "status")


@query(
    "catalog_remapped_paths",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/new/outputs/p' || page_id WHEN page_id % 3 = 1 THEN '/old/outputs/p' || page_id END AS local FROM pages""",
)
def catalog_remapped_paths(spark, sf_dir):
    """Files of two thirds of the pages exist, below the new root or where they were."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/old/outputs/p"), F.col("page_id").cast("string")).alias("p"))
    moved = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("p", "^/old", "/new")).when(F.col("page_id") % 3 == 1, F.col("p"))
    files = pages.select(moved.alias("path")).filter("path is not null")
    return catalog.remap_paths(pages, "p", "/new", files).select("page_id", F.col("p_local").alias("local"))


@query(
    "catalog_followed_manifests",
    """SELECT rule, count(*)::BIGINT AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'baseline_incomplete' END AS rule FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT CASE WHEN user_id % 3 = 0 THEN 'run_not_found' END FROM (SELECT DISTINCT user_id FROM events)) WHERE rule IS NOT NULL GROUP BY 1""",
)
def catalog_followed_manifests(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    ident = F.col("user_id").cast("string")
    comparisons = users.select(
        ident.alias("comparison"), F.concat(F.lit("d"), ident).alias("defense"), F.lit("c").alias("countermeasure"),
        F.lit("attacked").alias("condition"), F.concat(F.lit("/b/"), ident).alias("baseline_path"),
    )
    baselines = users.select(
        F.concat(F.lit("/b/"), ident).alias("baseline_path"), F.when(F.col("user_id") % 5 == 0, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("/r/"), ident).alias("run_path"),
    )
    runs = users.filter("user_id % 3 <> 0").select(F.concat(F.lit("/r/"), ident).alias("run_path"), ident.alias("checkpoint"))
    _, broken = catalog.follow_manifests(comparisons, baselines, runs)
    return broken.groupBy("rule").agg(F.count("*").alias("n"))


# Sinks


@query("sink_append_valid", "SELECT doc_id, n_chars FROM documents")
def sink_append_valid(spark, sf_dir):
    """Two halves of the documents, appended one after the other behind a rule."""
    path, docs = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    for half in (docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")):
        sinks.append_valid(half, row_rules(half, "doc_id", [("negative", F.col("n_chars") < 0)]), path)
    return spark.read.parquet(path)


@query(
    "sink_capability_tables",
    """WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT 'matrix_long' AS name, source, n::BIGINT AS n FROM t UNION ALL SELECT 'pilot_matrix', source, n::BIGINT FROM t""",
)
def sink_capability_tables(spark, sf_dir):
    path = scratch(spark)
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    names = sinks.write_capability_tables({"matrix_long": counts}, path, pilot=True)
    read = [spark.read.option("header", True).csv(f"{path}/{n}").withColumn("name", F.lit(n)) for n in names]
    both = read[0]
    for part in read[1:]:
        both = both.unionByName(part)
    return both.select("name", "source", F.col("n").cast("bigint").alias("n"))


@query(
    "capability_run_markdown",
    """SELECT '# M1 Pilot Report' || chr(10) || chr(10) || '- Run ID: `r1`' || chr(10) || '- Status: `done`' || chr(10) || '- Prediction records: ' || count(*) || chr(10)
|| '- Request failures: ' || count(*) FILTER (value < 2) || chr(10) || '- Parse failures: ' || count(*) FILTER (value >= 2 AND value < 5) || chr(10)
|| '- Datasets with unavailable requested splits: 0' || chr(10) || chr(10) || 'These are pipeline-validation artifacts, not final benchmark results.' || chr(10) AS value FROM events""",
)
def capability_run_markdown(spark, sf_dir):
    counts = table(spark, sf_dir, "events").agg(
        F.count("*").alias("prediction_records"), F.count_if(F.col("value") < 2).alias("request_failures"),
        F.count_if((F.col("value") >= 2) & (F.col("value") < 5)).alias("parse_failures"),
    )
    return capability.run_markdown(counts, "r1", "pilot", "done", 0)


@query("sink_bundle_round_trip", "SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt_text, role AS teacher_response FROM conversations")
def sink_bundle_round_trip(spark, sf_dir):
    """Conversation turns as a transcript bundle, saved, checked against its manifest and loaded."""
    place = F.col("conv_id") * 1000 + F.col("turn")
    records = table(spark, sf_dir, "conversations").select(
        place.alias("order_index"), place.alias("prompt_id"), F.col("text").alias("prompt_text"), F.col("role").alias("teacher_response"),
        place.cast("string").alias("query_id"), F.lit("success").alias("query_status"),
    )
    attempts = records.select("query_id", F.lit("success").alias("status"))
    identity = {k: 7 if k == "seed" else k for k in bundles.IDENTITY}
    root = scratch(spark)
    ident = bundles.save_bundle(records, attempts, root, identity, 10, "2025-01-01")
    loaded, _ = bundles.load_bundle(spark, root, ident, identity)
    return loaded.select("prompt_id", "prompt_text", "teacher_response")


@query(
    "sink_result_rows",
    """SELECT doc_id, source AS attack, n_chars % 2 = 0 AND n_chars % 3 = 0 AS held_out_evaluation,
sha256('{"max_tokens":' || n_chars || ',"temperature":0}') AS evaluation_decode_config_hash FROM documents""",
)
def sink_result_rows(spark, sf_dir):
    """Runs made of documents: lineage with the hash of the decode settings."""
    metric = lambda held: F.struct(held.alias("held_out"))
    config = F.struct(F.lit(0).alias("temperature"), F.col("n_chars").alias("max_tokens"))
    row = sinks.result_row(
        F.col("source"), F.md5("text"), F.md5("lang"), F.col("lang"), F.lit("given"), config, config,
        {"M1": metric(F.col("n_chars") % 2 == 0), "M2": metric(F.col("n_chars") % 3 == 0), "M3": metric(F.lit(True)), "M6": metric(F.lit(True))},
    )
    found = table(spark, sf_dir, "documents").select("doc_id", row.alias("r"))
    return found.select("doc_id", "r.attack", "r.held_out_evaluation", "r.evaluation_decode_config_hash")


# Rules


@query(
    "capability_prediction_rules",
    """WITH c AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations), r AS (SELECT unnest([
  CASE WHEN turn % 3 = 0 THEN 'missing_fields' END, CASE WHEN turn % 2 = 1 THEN 'generation_config_not_object' END, CASE WHEN turn % 2 = 0 AND k = 4 THEN 'generation_config_missing_fields' END,
  CASE WHEN k = 0 THEN 'bad_request_status' END, CASE WHEN k = 1 THEN 'bad_parse_status' END, CASE WHEN k = 2 THEN 'failed_parse_with_prediction' END,
  CASE WHEN k = 3 AND turn % 3 <> 0 THEN 'code_record_missing_fields' END]) AS rule FROM c)
SELECT rule, count(*)::BIGINT AS n FROM r WHERE rule IS NOT NULL GROUP BY 1""",
)
def capability_prediction_rules(spark, sf_dir):
    """Turns as prediction records, by conversation and turn with one fault or another of each rule."""
    turn, kind = F.col("turn"), F.col("conv_id") % 5
    set_here = ("generation_config", "raw_response", "dataset", "request_status", "parse_status", "parsed_prediction")
    names = [f for f in capability.RECORD_FIELDS if f not in set_here]
    settings = [F.to_json(F.struct(*[F.lit(0).alias(f) for f in some])) for some in (capability.GENERATION_FIELDS, capability.GENERATION_FIELDS[1:])]
    fields = F.to_json(
        F.struct(
            F.col("text").alias("raw_response"), F.when(kind == 0, "lost").otherwise("completed").alias("request_status"),
            F.when(kind == 1, "odd").when(kind == 2, "failed").otherwise("success").alias("parse_status"), F.lit("p").alias("parsed_prediction"),
            *[F.lit(1).alias(f) for f in names],
        ),
        {"ignoreNullFields": "false"},
    )
    dataset = F.when(turn % 3 == 0, F.lit("")).when(kind == 3, F.lit('"dataset": "humaneval", ')).otherwise(F.lit('"dataset": "d", '))
    config = F.when(turn % 2 == 1, F.lit('"none"')).when(kind == 4, settings[1]).otherwise(settings[0])
    record = F.concat(F.lit("{"), dataset, F.lit('"generation_config": '), config, F.lit(", "), F.substr(fields, F.lit(2)))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row_key"), F.parse_json(record).alias("raw"))
    return capability.prediction_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "transcript_record_rules",
    """SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest([CASE WHEN turn % 2 = 0 THEN 'forbidden_fields' END, CASE WHEN turn % 3 = 0 THEN 'decode_config_not_object' END, CASE WHEN turn % 4 = 1 THEN 'missing_fields' END]) AS rule FROM conversations) WHERE rule IS NOT NULL GROUP BY 1""",
)
def transcript_record_rules(spark, sf_dir):
    names = [f for f in X.TRANSCRIPT_FIELDS if f not in ("decode_config", "created_at", "prompt_text")]
    fields = F.to_json(F.struct(F.col("text").alias("prompt_text"), *[F.lit(1).alias(f) for f in names]))
    config = F.when(F.col("turn") % 3 == 0, F.lit('"decode_config": "s"')).otherwise(F.lit('"decode_config": {"t": 0}'))
    logits = F.when(F.col("turn") % 2 == 0, F.lit(', "logits": [1]')).otherwise("")
    created = F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(F.lit(', "created_at": "now"'))
    record = F.concat(F.lit("{"), config, logits, created, F.lit(", "), F.substr(fields, F.lit(2)))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row_key"), F.parse_json(record).alias("raw"))
    return X.record_violations(rows, "raw", "row_key").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "provenance_cached_answers",
    """SELECT doc_id FROM documents WHERE doc_id % 3 = 0""",
)
def provenance_cached_answers(spark, sf_dir):
    """Stored choices that were changed after their answer had been read."""
    answer = F.concat("text", F.lit("\nThe answer is (B)."))
    stored = F.when(F.col("doc_id") % 3 == 0, "C").otherwise("B")
    rows = table(spark, sf_dir, "documents").select("doc_id", answer.alias("response"), stored.alias("choice"))
    found = provenance.cached_answer_violations(rows, "response", "choice", "doc_id")
    return found.select(F.col("row_key").cast("bigint").alias("doc_id"))


@query(
    "capability_suite_rules",
    """SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest([CASE WHEN value > 80 THEN 'missing_metric' END, CASE WHEN value <= 80 AND value > 50 THEN 'score_outside_unit_interval' END, CASE WHEN user_id % 4 = 0 THEN 'few_shot_differs' END]) AS rule FROM events) WHERE rule IS NOT NULL GROUP BY 1""",
)
def capability_suite_rules(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task"), F.lit("acc").alias("metric"), F.when(F.col("value") <= 80, F.col("value") / 50).alias("score"),
        F.when(F.col("user_id") % 4 == 0, 5).otherwise(0).alias("shots"), F.lit(0).alias("wanted_shots"),
    )
    return capability.suite_violations(scores).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "quality_text_rules",
    """SELECT 'missing_text' AS rule, count(*)::BIGINT AS n FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'duplicate_id', count(*)::BIGINT FROM (SELECT doc_id // 2 FROM documents GROUP BY 1 HAVING count(*) > 1)""",
)
def quality_text_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 2).alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text")
    )
    return quality.text_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "cost_job_rules",
    """SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest([CASE WHEN event_type = 'error' THEN 'job_not_completed' END, CASE WHEN user_id % 3 = 0 THEN 'no_gpu_allocation' END]) AS rule FROM events
UNION ALL SELECT 'duplicate_job' FROM (SELECT event_id // 3 FROM events GROUP BY 1 HAVING count(*) > 1)) WHERE rule IS NOT NULL GROUP BY 1""",
)
def cost_job_rules(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    tres = F.when(F.col("user_id") % 3 == 0, "cpu=4,mem=8").otherwise("cpu=4,gres/gpu=2")
    jobs = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("job_id"), state.alias("state"), tres.alias("tres"))
    return cost.job_violations(jobs).groupBy("rule").agg(F.count("*").alias("n"))


# Columns


@query(
    "transcript_prefix_rules_tokens",
    """SELECT doc_id, doc_id % 4 = 0 AS broken FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) > 3""",
)
def transcript_prefix_rules_tokens(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\x0B\f\r]+)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 3)
    prompt = F.when(F.col("doc_id") % 4 == 0, F.concat(F.slice("w", 1, 2), F.array(F.lit(" ")))).otherwise(F.slice("w", 1, 3))
    return rows.select("doc_id", X.prefix_mismatch(prompt, "w").alias("broken"))


@query(
    "transcript_completion_prompts",
    """SELECT conv_id, turn, text AS first, text || chr(10) || role AS joined FROM conversations""",
)
def transcript_completion_prompts(spark, sf_dir):
    prompts = F.array("text", "role")
    first, joined = X.completion_prompt(prompts, False), X.completion_prompt(prompts, True)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", first.alias("first"), joined.alias("joined"))


@query(
    "fidelity_sample_predictions",
    """WITH d AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'hellaswag' WHEN 1 THEN 'mmlu_x' ELSE 'gsm8k_cot' END AS task,
[-n_chars::DOUBLE, -2.0 * n_chars - 1.0] AS s, [1, 4] AS len FROM documents)
SELECT task, doc_id::VARCHAR AS doc_id, 'none' AS filter, 'lm-eval:' || lang AS signature, (CASE WHEN task = 'hellaswag' THEN CASE WHEN s[1] / 1 >= s[2] / 4 THEN 0 ELSE 1 END ELSE CASE WHEN s[1] >= s[2] THEN 0 ELSE 1 END END)::BIGINT AS prediction FROM d WHERE task <> 'gsm8k_cot'""",
)
def fidelity_sample_predictions(spark, sf_dir):
    kind = F.col("doc_id") % 3
    size = F.col("n_chars").cast("double")
    samples = table(spark, sf_dir, "documents").select(
        F.when(kind == 0, "hellaswag").when(kind == 1, "mmlu_x").otherwise("gsm8k_cot").alias("task"), "doc_id",
        F.lit(None).cast("string").alias("filter"), F.col("lang").alias("prompt_hash"), F.lit("{}").alias("arguments"),
        F.array(-size, -2.0 * size - 1.0).alias("scores"), F.array(F.lit("a"), F.lit("bbbb")).alias("continuations"),
    )
    return fidelity.sample_predictions(samples)


@query(
    "fidelity_external_scores",
    """SELECT conv_id, turn, round(CASE WHEN c = '' AND r = '' THEN 1.0 WHEN c = '' OR r = '' THEN 0.0 ELSE least(length(c), length(r))::DOUBLE / greatest(length(c), length(r)) END, 9) AS score
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS c, CASE WHEN turn % 2 = 0 THEN '' ELSE text || role END AS r FROM conversations)""",
)
def fidelity_external_scores(spark, sf_dir):
    """A scorer from outside (share of lengths) with the rules for blank texts."""

    def scorer(batches):
        for batch in batches:
            pairs = zip(batch.column("c").to_pylist(), batch.column("r").to_pylist())
            scores = [min(len(a), len(b)) / max(len(a), len(b), 1) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    pairs = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("c"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat("text", "role")).alias("r"),
    )
    scored = fidelity.score_pairs(pairs, scorer, "conv_id bigint, turn bigint, c string, r string, score double")
    return scored.select("conv_id", "turn", F.round(fidelity.with_empty_rules(F.col("score"), F.col("c"), F.col("r")), 9).alias("score"))


@query(
    "text_stable_hashes",
    """SELECT doc_id, sha256('{"a":' || n_chars || ',"b":"' || lang || '"}') AS digest, 'arguments-sha256:' || sha256('{"a":' || n_chars || ',"b":"' || lang || '"}') AS signature FROM documents""",
)
def text_stable_hashes(spark, sf_dir):
    """Hash of a settings text, whatever the order and spacing of its keys."""
    document = F.concat(F.lit('{ "b": "'), "lang", F.lit('",  "a": '), F.col("n_chars").cast("string"), F.lit(" }"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashing.stable_text_hash(document).alias("digest"), hashing.prompt_signature(F.lit(""), document).alias("signature")
    )


@provenance.register_scorer("length_share")
def length_share(rows):
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("label"), (F.col("n_chars") / 1000.0).alias("score"), F.lit("higher").alias("direction"))


@query(
    "provenance_registered_scorer",
    "SELECT doc_id::VARCHAR AS id, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS label, round(n_chars / 1000.0, 9) AS score, 'higher' AS direction FROM documents JOIN labels USING (doc_id)",
)
def provenance_registered_scorer(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found = provenance.run_scorer("length_share", rows)
    return found.select("id", "label", F.round("score", 9).alias("score"), "direction")
