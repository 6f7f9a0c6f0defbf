"""Sources, sinks, probes, benchmark adapters and run-catalogue joins on data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traceaudit.operators import probes as B
from traceaudit.operators import transcripts as X
from traceaudit.plans.registry import Catalog, table
from traceaudit.session import checkpoint_root
from traceaudit.sources import catalog as G
from traceaudit.sources import jsonl, sinks, tasks

CATALOG = Catalog()
query = CATALOG.query


def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/exchange/{uuid.uuid4().hex}"


@query(
    "source_jsonl_round_trip",
    "SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, sum(length(text))::BIGINT AS text_chars FROM documents GROUP BY 1",
)
def source_jsonl_round_trip(spark, sf_dir):
    path = scratch(spark)
    jsonl.write_jsonl(table(spark, sf_dir, "documents"), path)
    rows, _ = jsonl.read_jsonl(spark, path, "doc_id bigint, text string, lang string, n_chars bigint", strict=False)
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum(F.char_length("text")).alias("text_chars")
    )


@query(
    "source_jsonl_violations",
    "SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'not_an_object' AS rule FROM events WHERE event_type = 'view' UNION ALL SELECT 'not_valid_json' FROM events WHERE event_type = 'error') GROUP BY 1",
)
def source_jsonl_violations(spark, sf_dir):
    path = scratch(spark)
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"value": true, "id": '), F.col("event_id").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "signup", F.lit("   "))
        .otherwise(F.to_json(F.struct("value", F.col("event_id").alias("id"))))
    )
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    _, broken = jsonl.read_jsonl(spark, path, "id bigint, value double", strict=False)
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "sink_canonical_lines",
    """WITH l AS (SELECT doc_id AS p, '{"doc_id":' || doc_id || ',"source":' || to_json(source)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS value FROM documents),
r AS (SELECT p, sha256('{"value":' || to_json(value)::VARCHAR || '}') AS h FROM l), a AS (SELECT p // 65536 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, count(*) AS n FROM r GROUP BY p // 65536),
b AS (SELECT p // 65536 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY p // 65536)
SELECT 'block-sha256/65536' AS scheme, sum(n)::BIGINT AS row_count, sha256(string_agg(h, chr(10) ORDER BY p)) AS ordering_hash FROM b""",
)
def sink_canonical_lines(spark, sf_dir):
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    return sinks.write_canonical(docs, path, "doc_id", ["source", "doc_id", "text"])


@query("sink_csv_round_trip", "SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS user_id, NULL::VARCHAR AS missing FROM events")
def sink_csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    sinks.write_csv(table(spark, sf_dir, "events"), path, ["event_type", "event_id", "missing", "user_id"])
    return spark.read.option("header", True).csv(path)


@query("sink_report_json", "SELECT source, n::BIGINT AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def sink_report_json(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sinks.report_json(counts).select(F.from_json("value", "source string, n bigint").alias("r")).select("r.*")


@query(
    "sink_tagged_outputs",
    "SELECT label, count(*)::BIGINT AS n FROM (SELECT 'user' AS label FROM conversations WHERE role = 'user' UNION ALL SELECT 'assistant' FROM conversations WHERE role = 'assistant') GROUP BY 1",
)
def sink_tagged_outputs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    parts = {role: turns.filter(F.col("role") == role).select("conv_id", "text") for role in ("user", "assistant")}
    return sinks.tag_outputs(parts).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Documents as raw probes: words of the source name as options. Even rows give the answer as an index, others as text;
# the text "1" is neither a letter nor an option.
@query(
    "probe_prompts",
    """WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN [lang, source] ELSE [lang, source, 'none of these'] END AS o FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 < len(o) THEN chr((65 + doc_id % 4)::INTEGER) END WHEN doc_id % 6 <> 1 THEN 'B' END AS answer, 'Which? ' || source || chr(10) || chr(10) || 'A. ' || o[1] || chr(10) || 'B. ' || o[2] || CASE WHEN len(o) = 3 THEN chr(10) || 'C. none of these' ELSE '' END
 || chr(10) || chr(10) || 'Answer with only one letter from: ' || CASE WHEN len(o) = 3 THEN 'A, B, C' ELSE 'A, B' END || '.' AS prompt FROM d""",
)
def probe_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 3 == 0, F.lit("N/A")).otherwise("none of these")
    raw = docs.select(
        "doc_id",
        F.concat(F.lit("field_"), "lang").alias("category"),
        F.concat(F.lit(" Which? "), "source").alias("question"),
        F.array(F.col("lang"), F.concat(F.lit(" "), "source"), extra, F.lit("")).alias("options"),
        F.when(F.col("doc_id") % 6 == 1, "1").when(F.col("doc_id") % 6 == 3, "b").otherwise(F.col("source")).alias("answer"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 4).alias("answer_index"),
    )
    found = B.build_probes(raw, ["en", "fr", "de"])
    return found.select("doc_id", "answer", B.probe_prompt("question", "options").alias("prompt"))


@query(
    "probe_few_shot_counts",
    "SELECT lang AS category, count(*)::BIGINT AS probes, least((SELECT count(*) FROM documents x WHERE x.lang = d.lang AND source = 'src0'), 5)::BIGINT AS examples FROM documents d GROUP BY 1",
)
def probe_few_shot_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("category"), F.col("source").alias("question"), F.array("lang", "source").alias("options"),
        F.lit("A").alias("answer"), F.col("doc_id").alias("position"), F.lit("").alias("cot_content"), "source",
    )
    found = B.build_probes(docs.drop("position", "cot_content"), None, docs.filter("source = 'src0'").drop("source"))
    sized = found.withColumn("k", F.coalesce(F.size("few_shot_examples"), F.lit(0)))
    return sized.groupBy("category").agg(F.count(F.lit(1)).alias("probes"), F.max("k").cast("bigint").alias("examples"))


# Events as word problems and documents as classification and choice tasks.
@query(
    "adapter_gsm8k",
    "SELECT event_id::VARCHAR AS example_id, 'Math word problem: ' || event_type AS logical_prompt, floor(value)::BIGINT::VARCHAR AS normalized_gold_answer FROM events",
)
def adapter_gsm8k(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("question"),
        F.concat(F.lit("steps\n#### $"), F.floor("value").cast("string"), F.lit(".00")).alias("answer"),
        F.lit("test").alias("split"), F.col("event_id").alias("example_index"),
    )
    return tasks.adapt(rows, "gsm8k").select("example_id", "logical_prompt", "normalized_gold_answer")


@query(
    "adapter_mmlu",
    """SELECT doc_id::VARCHAR AS example_id, chr((65 + doc_id % 3)::INTEGER) AS gold, 'Question: Subject: ' || lang || ' text' || chr(10) || 'Who?' || chr(10) || 'A. ' || source || chr(10) || 'B. ' || lang || chr(10) || 'C. both' AS logical_prompt, ' A| B| C' AS continuations FROM documents""",
)
def adapter_mmlu(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat("lang", F.lit("_text")).alias("subject"), F.lit("Who?").alias("question"),
        F.array("source", "lang", F.lit("both")).alias("choices"), (F.col("doc_id") % 3).alias("answer"),
        F.lit("test").alias("split"), F.col("doc_id").alias("example_index"),
    )
    found = tasks.adapt(rows, "mmlu")
    return found.select(
        "example_id", F.col("gold_answer").alias("gold"), "logical_prompt", F.array_join("choice_scoring.continuations", "|").alias("continuations")
    )


@query(
    "adapter_unusable_gold",
    "SELECT 'unusable_gold' AS rule, count(*)::BIGINT AS broken FROM documents WHERE lang NOT IN ('de', 'en', 'fr')",
)
def adapter_unusable_gold(spark, sf_dir):
    stance = F.when(F.col("lang") == "de", "Hawkish").when(F.col("lang") == "en", "neutral").when(F.col("lang") == "fr", "DOVISH").otherwise("unclear")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("Rate this.").alias("instruction"), "text", stance.alias("label"),
        F.lit("test").alias("split"), F.col("doc_id").alias("example_index"),
    )
    return tasks.example_violations(tasks.adapt(rows, "fomc")).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


# Orders as runs: catalogue joins without files.
def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/runs/"), F.col("o_orderkey").cast("string"), F.lit("/attack_manifest.json")).alias("path"),
        F.col("o_orderpriority").alias("attack"),
        (F.col("o_custkey") % 5).alias("budget"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "dry_run").otherwise("failed").alias("status"),
        F.col("o_orderkey").alias("run_id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
    )


@query(
    "catalog_latest_run",
    """SELECT o_orderpriority AS attack, o_custkey % 5 AS budget, arg_max('/runs/' || o_orderkey || '/attack_manifest.json', (epoch_us(o_orderdate), '/runs/' || o_orderkey || '/attack_manifest.json')) AS path FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
)
def catalog_latest_run(spark, sf_dir):
    return G.latest_run(runs(spark, sf_dir), ["completed"])


@query(
    "catalog_identity_rules",
    "SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'attack_differs' AS rule FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'budget_differs' FROM orders WHERE o_custkey % 5 <> 3) GROUP BY 1",
)
def catalog_identity_rules(spark, sf_dir):
    return G.check_identity(runs(spark, sf_dir), "1-URGENT", 3).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "catalog_resolved_logs",
    """WITH f AS (SELECT '/logs/' || o_orderkey AS p FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT o_orderkey, o_custkey, '/logs/' || o_custkey AS a, '/logs/' || o_orderkey AS b FROM orders)
SELECT o_orderkey AS run_id, CASE WHEN a IN (SELECT p FROM f) THEN a ELSE b END AS path FROM c WHERE a IN (SELECT p FROM f) OR b IN (SELECT p FROM f)""",
)
def catalog_resolved_logs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def log(column):
        return F.concat(F.lit("/logs/"), F.col(column).cast("string"))

    files = orders.filter("o_orderstatus = 'F'").select(log("o_orderkey").alias("path"))
    wanted = orders.select(F.col("o_orderkey").alias("run_id"), F.array(F.lit(None).cast("string"), log("o_custkey"), log("o_orderkey")).alias("candidates"))
    return G.first_existing(wanted, files, ["run_id"])


@query(
    "catalog_rejected_runs",
    """SELECT reasons, count(*)::BIGINT AS runs FROM (SELECT concat_ws(', ', CASE WHEN o_orderstatus <> 'F' THEN 'status=' || CASE WHEN o_orderstatus = 'O' THEN 'dry_run' ELSE 'failed' END END,
 CASE WHEN o_custkey % 5 <> 2 THEN 'budget=' || (o_custkey % 5) END, CASE WHEN o_custkey % 2 = 1 THEN 'query pool differs' END, CASE WHEN o_custkey % 3 = 0 THEN 'checkpoint missing or incomplete' END) AS reasons FROM orders) WHERE reasons <> '' GROUP BY 1""",
)
def catalog_rejected_runs(spark, sf_dir):
    odd = F.col("o_custkey") % 2 == 1
    listed = runs(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey"), "run_id")
    rows = listed.select(
        "run_id", F.col("mtime").cast("string").alias("created_at"), "status", "budget", F.lit("s").alias("student_model"),
        F.when(odd, "other").otherwise("pool").alias("pool_hash"), F.lit("i").alias("ordering_identity"), F.lit("h").alias("ordering_hash"),
        F.lit("/t").alias("transcript_path"), F.lit("th").alias("transcript_hash"),
        F.when(F.col("o_custkey") % 3 != 0, "/c").alias("checkpoint"),
    )
    want = {"budget": 2, "student_model": "s", "pool_hash": "pool", "ordering_identity": "i", "transcript_path": "/t"}
    _, rejected = G.compatible_runs(rows, want)
    return rejected.groupBy("reasons").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "catalog_allowed_combinations",
    """SELECT o_orderkey FROM orders WHERE o_custkey % 3 < 2 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def catalog_allowed_combinations(spark, sf_dir):
    names = F.array(F.lit("dipper"), F.lit("translation"), F.lit("rewrite"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.get(names, (F.col("o_custkey") % 3).cast("int")).alias("adaptive"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "adfp").when(F.col("o_orderpriority") == "2-HIGH", "ginsew").otherwise("mmd").alias("defense"),
        F.when(F.col("o_orderstatus") == "F", 1000).otherwise(10000).alias("budget"),
    )
    return G.allowed_combinations(rows).select("o_orderkey")


@query(
    "catalog_condition_table",
    """WITH s AS (SELECT event_type AS model, avg(value) AS acc FROM events GROUP BY 1), d AS (SELECT event_type AS countermeasure, count(*) AS hits FROM events GROUP BY 1)
SELECT c.t AS countermeasure, s.model, round(acc, 6) AS acc, hits::BIGINT AS hits FROM (SELECT DISTINCT event_type AS t FROM events) c JOIN s ON s.model = c.t JOIN d ON d.countermeasure = c.t""",
)
def catalog_condition_table(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kinds = events.select(F.col("event_type").alias("countermeasure")).distinct()
    conditions = kinds.select(F.lit("adfp").alias("defense"), "countermeasure", F.lit("counter").alias("condition"), F.col("countermeasure").alias("model"))
    scores = events.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("acc"))
    detector = events.groupBy(F.lit("adfp").alias("defense"), F.col("event_type").alias("countermeasure"), F.lit("counter").alias("condition")).agg(F.count(F.lit(1)).alias("hits"))
    found = G.compare_conditions(conditions, scores, detector)
    return found.select("countermeasure", "model", F.round("acc", 6).alias("acc"), "hits")


@query(
    "catalog_shared_baselines",
    "SELECT count(*)::BIGINT AS differing FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1)",
)
def catalog_shared_baselines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("defense"), F.lit("clean").alias("condition"), F.col("event_type").alias("report"))
    return G.shared_baseline_violations(rows).agg(F.count(F.lit(1)).alias("differing"))


@query(
    "catalog_detector_columns",
    "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id ELSE event_id END::VARCHAR AS score FROM events",
)
def catalog_detector_columns(spark, sf_dir):
    own = F.to_json(F.struct(F.array(F.struct(F.col("user_id").alias("score"))).alias("students"), F.col("event_id").alias("score")))
    flat = F.to_json(F.struct(F.col("event_id").alias("score")))
    raw = F.parse_json(F.when(F.col("user_id") % 2 == 0, own).otherwise(flat))
    return G.detector_stats(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), ["score"])


@query(
    "catalog_merged_summaries",
    """WITH e AS (SELECT event_type AS attack, round(avg(value), 9) AS score FROM events GROUP BY 1)
SELECT 'merged' AS kind, attack, score FROM e UNION ALL SELECT 'unexpected_method', attack, NULL FROM e WHERE attack NOT IN ('click', 'view', 'lord', 'gad')
UNION ALL SELECT 'missing', m, NULL FROM (VALUES ('click'), ('view'), ('lord'), ('gad')) AS w(m) WHERE m NOT IN (SELECT attack FROM e)""",
)
def catalog_merged_summaries(spark, sf_dir):
    """One worker summary for each event type, against a list that names some of them and some that no worker has."""
    events = table(spark, sf_dir, "events")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    parts = [
        events.filter(F.col("event_type") == t).groupBy(F.col("event_type").alias("attack")).agg(F.avg("value").alias("score"))
        for t in kinds
    ]
    merged, broken, missing = G.merge_summaries(parts, ["click", "view", "lord", "gad"])
    nothing = F.lit(None).cast("double").alias("score")
    return (
        merged.select(F.lit("merged").alias("kind"), "attack", F.round("score", 9).alias("score"))
        .unionByName(broken.select(F.col("rule").alias("kind"), F.col("row_key").alias("attack"), nothing))
        .unionByName(missing.select(F.lit("missing").alias("kind"), "attack", nothing))
    )


@query(
    "catalog_protocol_rules",
    "SELECT 'temperature_differs' AS rule, count(*)::BIGINT AS broken FROM events WHERE value >= 20",
)
def catalog_protocol_rules(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stored = events.select("event_id", F.when(F.col("value") < 20, 0.0).otherwise(0.7).alias("temperature"), F.lit(5).alias("seed"))
    wanted = events.select("event_id", F.lit(0.0).alias("temperature"), F.lit(5).alias("seed"))
    return G.protocol_violations(stored, wanted, ["event_id"]).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "catalog_rebuilt_query_logs",
    """WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id FROM documents), m AS (SELECT event_type, count(DISTINCT user_id) AS b FROM events GROUP BY 1)
SELECT event_type AS attack, count(*)::BIGINT AS queries, max(doc_id)::BIGINT AS last_id FROM m JOIN p ON i < b GROUP BY 1""",
)
def catalog_rebuilt_query_logs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pool = X.positions(docs.select("doc_id", F.col("text").alias("prompt_text")), ["doc_id"]).select(
        (F.col("position") - 1).alias("order_index"), F.col("doc_id").alias("prompt_id"), "prompt_text"
    )
    manifests = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("attack")).agg(F.count_distinct("user_id").alias("budget"))
    plans = manifests.select("attack", F.col("attack").alias("run_id"), F.col("attack").alias("path"), "budget")
    rows, _ = G.log_from_manifest(plans, pool)
    return rows.groupBy("attack").agg(F.count(F.lit(1)).alias("queries"), F.max("id").alias("last_id"))
