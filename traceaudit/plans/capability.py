"""Accuracy tables over prediction rows read from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.hashing import typed_eq
from traceaudit.functions.parsing import parse_number
from traceaudit.operators import capability as A
from traceaudit.operators.ordering import hash_fraction
from traceaudit.plans.corpus import draw_sql
from traceaudit.plans.registry import Catalog, table
from traceaudit.session import materialise

CATALOG = Catalog()
query = CATALOG.query

TASKS = ", ".join(f"'{t}'" for t in A.DATASET_ORDER)

# An event is one prediction: type = model, the props number picks the dataset,
# the user is the example, the day is the timestamp (so rewrites tie).
RECORDS = f"""
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
records AS (
  SELECT event_type AS model_key, ([{TASKS}])[(k % 13) + 1] AS dataset, 'test' AS split, user_id::VARCHAR AS example_id, event_id AS seq,
    (epoch_us(ts) // 86400000000)::VARCHAR AS timestamp_utc,
    CASE WHEN value < 2 THEN 'failed' ELSE 'completed' END AS request_status,
    CASE WHEN value < 2 THEN 'not_attempted' WHEN value < 5 THEN 'failed' ELSE 'success' END AS parse_status,
    value >= 5 AND floor(value)::BIGINT % 2 = 0 AS correct,
    CASE WHEN value <= 100 THEN value / 10 END AS latency_seconds, k AS input_tokens
  FROM raw),
latest AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY model_key, dataset, split, example_id ORDER BY timestamp_utc DESC, seq DESC) = 1)"""


def records(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_key"),
        F.get(F.array(*map(F.lit, A.DATASET_ORDER)), (k % 13).cast("int")).alias("dataset"),
        F.lit("test").alias("split"),
        F.col("user_id").cast("string").alias("example_id"),
        F.col("event_id").alias("seq"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).cast("string").alias("timestamp_utc"),
        F.when(value < 2, "failed").otherwise("completed").alias("request_status"),
        F.when(value < 2, "not_attempted").when(value < 5, "failed").otherwise("success").alias("parse_status"),
        ((value >= 5) & (F.floor(value) % 2 == 0)).alias("correct"),
        F.when(value <= 100, value / 10).alias("latency_seconds"),
        k.alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
        F.lit(None).cast("bigint").alias("total_tokens"),
        F.lit(False).alias("execution_enabled"),
    )


def newest_records(spark, sf_dir):
    return materialise(A.latest(records(spark, sf_dir), "seq"))


@query("capability_latest", f"WITH {RECORDS} SELECT model_key, dataset, example_id, seq, correct FROM latest")
def capability_latest(spark, sf_dir):
    return A.latest(records(spark, sf_dir), "seq").select("model_key", "dataset", "example_id", "seq", "correct")


SUMMARY = """SELECT model_key, dataset, {split} CASE WHEN dataset = 'humaneval' THEN 'completion_extraction_rate' ELSE 'M1 rollout accuracy' END AS metric_name,
 round(CASE WHEN dataset = 'humaneval' THEN count(*) FILTER (parse_status = 'success') ELSE count(*) FILTER (correct) END::DOUBLE / count(*), 9) AS score,
 count(*)::BIGINT AS evaluated_count, count(*) FILTER (request_status = 'completed')::BIGINT AS completed_request_count, count(*) FILTER (correct)::BIGINT AS correct_count,
 count(*) FILTER (parse_status = 'failed')::BIGINT AS parse_failure_count, round(count(*) FILTER (parse_status = 'failed')::DOUBLE / count(*), 9) AS parse_failure_rate,
 count(*) FILTER (request_status = 'failed')::BIGINT AS failed_request_count, round(count(*) FILTER (request_status = 'failed')::DOUBLE / count(*), 9) AS failed_request_rate,
 round(avg(coalesce(latency_seconds, 0.0)), 9) AS mean_latency_seconds, round(median(coalesce(latency_seconds, 0.0)), 9) AS median_latency_seconds,
 (CASE WHEN dataset = 'humaneval' THEN count(*) FILTER (request_status = 'completed') END)::BIGINT AS generated_completion_count,
 (CASE WHEN dataset = 'humaneval' THEN count(*) FILTER (parse_status = 'success') END)::BIGINT AS completion_extraction_success_count,
 CASE WHEN dataset = 'humaneval' THEN false END AS code_execution_enabled FROM latest GROUP BY {split} model_key, dataset"""


def rounded(df):
    return df.withColumns(
        {
            **{c: F.round(c, 9) for c in ("score", "parse_failure_rate", "failed_request_rate")},
            **{c: F.round(c, 9) for c in ("mean_latency_seconds", "median_latency_seconds")},
        }
    )


@query("capability_per_dataset", f"WITH {RECORDS} {SUMMARY.format(split='split,')}")
def capability_per_dataset(spark, sf_dir):
    return rounded(A.summary(newest_records(spark, sf_dir)))


@query(
    "capability_per_model",
    f"""WITH {RECORDS} SELECT model_key, count(*)::BIGINT AS attempted_count, count(*) FILTER (request_status = 'completed')::BIGINT AS completed_request_count,
count(*) FILTER (request_status = 'failed')::BIGINT AS request_failure_count, count(*) FILTER (parse_status = 'failed')::BIGINT AS parse_failure_count,
round(avg(coalesce(latency_seconds, 0.0)), 9) AS mean_latency_seconds FROM latest GROUP BY 1""",
)
def capability_per_model(spark, sf_dir):
    found = A.per_model(A.latest(records(spark, sf_dir), "seq"))
    return found.withColumn("mean_latency_seconds", F.round("mean_latency_seconds", 9))


@query(
    "capability_matrix",
    f"""WITH {RECORDS}, s AS ({SUMMARY.format(split='')})
SELECT model_key, {', '.join(f"max(CASE WHEN dataset = '{t}' THEN score END) AS {t}" for t in A.DATASET_ORDER)} FROM s GROUP BY 1""",
)
def capability_matrix(spark, sf_dir):
    cells = A.summary(newest_records(spark, sf_dir), ("model_key", "dataset"))
    return A.matrix(cells.withColumn("score", F.round("score", 9)))


# Models without any record, one beside each with records, leave empty cells.
@query(
    "capability_dense_grid",
    f"""WITH {RECORDS}, s AS (SELECT model_key, dataset, count(*) AS evaluated_count, CASE WHEN dataset = 'humaneval' THEN round(count(*) FILTER (parse_status = 'success')::DOUBLE / count(*), 9) ELSE round(count(*) FILTER (correct)::DOUBLE / count(*), 9) END AS score FROM latest GROUP BY 1, 2),
t AS (SELECT DISTINCT event_type AS m FROM events), g AS (SELECT model_key, d.dataset FROM (SELECT m AS model_key FROM t UNION ALL SELECT m || '-next' FROM t), (SELECT unnest([{TASKS}]) AS dataset) d)
SELECT model_key, dataset, CASE WHEN s.score IS NOT NULL AND dataset = 'humaneval' THEN 'completion_extraction_rate' WHEN dataset = 'humaneval' THEN 'pass@1' ELSE 'M1 rollout accuracy' END AS metric_name,
s.score, coalesce(evaluated_count, 0)::BIGINT AS evaluated_count FROM g LEFT JOIN s USING (model_key, dataset)""",
)
def capability_dense_grid(spark, sf_dir):
    known = table(spark, sf_dir, "events").select(F.col("event_type").alias("model_key")).distinct()
    models = known.unionByName(known.select(F.concat("model_key", F.lit("-next")).alias("model_key")))
    grid = A.dense_grid(A.summary(newest_records(spark, sf_dir), ("model_key", "dataset")), models)
    return grid.select("model_key", "dataset", "metric_name", F.round("score", 9).alias("score"), "evaluated_count")


@query(
    "capability_run_counts",
    f"""WITH {RECORDS} SELECT count(*)::BIGINT AS prediction_records, count(*) FILTER (request_status = 'failed')::BIGINT AS request_failures,
count(*) FILTER (parse_status = 'failed')::BIGINT AS parse_failures FROM latest""",
)
def capability_run_counts(spark, sf_dir):
    return A.run_counts(records(spark, sf_dir), "seq")


@query(
    "capability_macro_accuracy",
    f"""WITH {RECORDS}, t AS (SELECT model_key, dataset, avg(correct::INT) AS a, count(*) FILTER (dataset = 'gsm8k' AND parse_status = 'failed') AS f, count(*) AS n FROM latest GROUP BY 1, 2)
SELECT model_key, round(avg(a), 9) AS macro_accuracy, sum(f)::BIGINT AS generative_parse_failures, sum(n)::BIGINT AS examples FROM t GROUP BY 1""",
)
def capability_macro_accuracy(spark, sf_dir):
    newest = A.latest(records(spark, sf_dir), "seq").withColumnRenamed("dataset", "task")
    found = A.macro_accuracy(newest, ["model_key"], "gsm8k")
    return found.withColumn("macro_accuracy", F.round("macro_accuracy", 9))


@query(
    "capability_deltas",
    f"""WITH {RECORDS}, t AS (SELECT model_key, dataset, avg(correct::INT) AS a FROM latest GROUP BY 1, 2), m AS (SELECT model_key, avg(a) AS v FROM t GROUP BY 1)
SELECT model_key, round(v, 9) AS macro_accuracy, round(v - (SELECT v FROM m WHERE model_key = 'click'), 9) AS gain_over_base, round((SELECT v FROM m WHERE model_key = 'view') - v, 9) AS drop_from_clean FROM m""",
)
def capability_deltas(spark, sf_dir):
    newest = A.latest(records(spark, sf_dir), "seq").withColumnRenamed("dataset", "task")
    rates = A.macro_accuracy(newest, ["model_key"], "gsm8k").select("model_key", "macro_accuracy")
    found = A.deltas(rates, "model_key", "macro_accuracy", "click", "view")
    return found.select("model_key", *[F.round(c, 9).alias(c) for c in ("macro_accuracy", "gain_over_base", "drop_from_clean")])


# Labels as JSON scalars: the target is a number, or the text "1" that must not
# equal the number 1.
def labelled(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    target = F.when(F.col("toxic") == 1, F.lit('"1"')).when(F.col("doc_id") % 5 == 0, F.lit("true")).otherwise(F.lit("1.0"))
    return joined.select(
        F.col("lang").alias("task"),
        F.parse_json(F.col("quality").cast("string")).alias("prediction"),
        F.parse_json(target).alias("target"),
    )


@query(
    "capability_typed_accuracy",
    """WITH r AS (SELECT lang AS task, quality = 1 AND toxic <> 1 AND doc_id % 5 <> 0 AS ok FROM labels JOIN documents USING (doc_id))
SELECT task, round(avg(ok::INT), 9) AS accuracy, count(*) FILTER (ok)::BIGINT AS correct, count(*)::BIGINT AS n FROM r GROUP BY ROLLUP (task)""",
)
def capability_typed_accuracy(spark, sf_dir):
    return A.accuracy(labelled(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


DOMAIN = f"""
d AS (SELECT ([{', '.join(f"'{t}'" for t in A.DOMAIN_TASKS)}])[(CAST(json_extract_string(props, '$.k') AS BIGINT) % 6) + 1] AS task, floor(value)::BIGINT % 3 = user_id % 3 AS ok FROM events)"""


@query(
    "capability_domain_report",
    f"""WITH {DOMAIN}, t AS (SELECT task, avg(ok::INT) AS a FROM d GROUP BY 1)
SELECT round((SELECT avg(ok::INT) FROM d), 9) AS domain_micro_accuracy, round(avg(a), 9) AS domain_macro_accuracy, (SELECT count(*) FROM d)::BIGINT AS n FROM t""",
)
def capability_domain_report(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").select(
        F.get(F.array(*map(F.lit, A.DOMAIN_TASKS)), (k % 6).cast("int")).alias("task"),
        F.parse_json((F.floor("value") % 3).cast("string")).alias("prediction"),
        F.parse_json((F.col("user_id") % 3).cast("string")).alias("target"),
    )
    found = A.domain_report(rows)
    return found.withColumns({c: F.round(c, 9) for c in ("domain_micro_accuracy", "domain_macro_accuracy")})


@query(
    "capability_task_coverage",
    "SELECT rule, row_key FROM (SELECT 'missing_task' AS rule, t AS row_key FROM (VALUES ('de'), ('en'), ('it')) AS r(t) WHERE t NOT IN (SELECT lang FROM documents) UNION ALL SELECT DISTINCT 'extra_task', lang FROM documents WHERE lang NOT IN ('de', 'en', 'it'))",
)
def capability_task_coverage(spark, sf_dir):
    found = A.coverage_violations(table(spark, sf_dir, "documents"), ["de", "en", "it"], "lang")
    return found.select("rule", "row_key")


# One nested result document per event; the average is over its six tasks.
@query(
    "capability_suite_average",
    """WITH e AS (SELECT event_type, event_id, value / 500 AS v FROM events)
SELECT event_type, event_id, round((v + v / 2 + v / 3 + v / 4 + v / 5 + v / 6) / 6, 9) AS average, 6::BIGINT AS n_tasks FROM e""",
)
def capability_suite_average(spark, sf_dir):
    value = F.col("value") / 500
    scores = [
        F.struct((value / (i + 1)).alias(metric)).alias(task) for i, (task, metric, _) in enumerate(A.SUITE_CONTRACT)
    ]
    shots = [F.lit(k).alias(task) for task, _, k in A.SUITE_CONTRACT]
    document = F.to_json(F.struct(F.struct(*scores).alias("results"), F.struct(*shots).alias("n-shot")))
    docs = table(spark, sf_dir, "events").select("event_type", "event_id", F.parse_json(document).alias("raw"))
    found = A.suite_average(A.suite_scores(docs), "event_type", "event_id")
    return found.withColumn("average", F.round("average", 9))


@query(
    "capability_scored_predictions",
    """SELECT event_id, CASE WHEN value < 2 THEN 'not_attempted' WHEN value < 5 THEN 'failed' ELSE 'success' END AS parse_status,
CASE WHEN value >= 5 THEN floor(value)::BIGINT::VARCHAR END AS normalized_prediction, value >= 5 AND floor(value)::BIGINT = user_id AS correct FROM events""",
)
def capability_scored_predictions(spark, sf_dir):
    value = F.col("value")
    response = F.when(value < 5, "I cannot tell.").otherwise(
        F.concat(F.lit("It may be 3, but the final answer is $"), F.floor(value).cast("string"), F.lit(".00 exactly"))
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("gsm8k").alias("dataset"),
        F.when(value < 2, "failed").otherwise("completed").alias("request_status"),
        parse_number(response).alias("parse"),
        F.col("user_id").cast("string").alias("normalized_gold_answer"),
    )
    return A.score_predictions(rows).select("event_id", "parse_status", "normalized_prediction", "correct")


@query(
    "capability_heldout_classification",
    """WITH o AS (SELECT event_type AS system, user_id, floor(arg_max(value, event_id))::BIGINT % 4 AS c, user_id % 3 AS l FROM events GROUP BY 1, 2, 4),
t AS (SELECT user_id, c FROM o WHERE system = 'click')
SELECT system, count(*)::BIGINT AS n, count(*) FILTER (o.c = o.l)::BIGINT AS correct, count(*) FILTER (o.c < 3 AND o.c = t.c)::BIGINT AS agreeing,
round(count(*) FILTER (o.c = o.l)::DOUBLE / count(*), 9) AS accuracy, round(count(*) FILTER (o.c < 3 AND o.c = t.c)::DOUBLE / count(*), 9) AS teacher_agreement
FROM o LEFT JOIN t USING (user_id) GROUP BY 1""",
)
def capability_heldout_classification(spark, sf_dir):
    words = [F.lit(w) for w in ("alpha", "beta", "gamma")]
    spoken = [F.lit(w) for w in ("I choose Alpha.", "(beta)", "gamma, surely", "alphabet or betamax")]
    choice = F.floor(F.max_by("value", "event_id")) % 4
    outputs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system"), F.col("user_id").alias("prompt_id")).agg(
        F.get(F.array(*spoken), choice.cast("int")).alias("output")
    )
    rows = outputs.select(
        "system", "prompt_id", "output", F.array(*words).alias("choices"),
        F.get(F.array(*words), (F.col("prompt_id") % 3).cast("int")).alias("label"),
    )
    found = A.heldout_classification(rows, teacher="click")
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "teacher_agreement")})


@query(
    "capability_typed_equality",
    """SELECT doc_id, false AS number_text, quality = toxic AS number_number, false AS number_boolean FROM labels""",
)
def capability_typed_equality(spark, sf_dir):
    def variant(c):
        return F.parse_json(c)

    quality, toxic = F.col("quality").cast("string"), F.col("toxic").cast("string")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        typed_eq(variant(quality), variant(F.concat(F.lit('"'), quality, F.lit('"')))).alias("number_text"),
        typed_eq(variant(quality), variant(F.concat(toxic, F.lit(".0")))).alias("number_number"),
        typed_eq(variant(quality), variant(F.when(F.col("quality") == 1, "true").otherwise("false"))).alias("number_boolean"),
    )


@query(
    "capability_unit_rules",
    "SELECT event_type AS row_key, count(*)::BIGINT AS broken FROM events WHERE value / 300 > 1 GROUP BY 1",
)
def capability_unit_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 300).alias("score"))
    return A.unit_violations(rows, "event_type", "score").groupBy("row_key").agg(F.count(F.lit(1)).alias("broken"))


# Sources as datasets; a split exists where a document was drawn into it.
@query(
    "capability_split_rows",
    f"""WITH s AS (SELECT DISTINCT source AS dataset, CASE WHEN {draw_sql('doc_id', 5)} < 0.02 THEN 'validation' WHEN {draw_sql('doc_id', 5)} < 0.05 THEN 'train' ELSE 'test' END AS split FROM documents),
a AS (SELECT dataset, string_agg(split, '|' ORDER BY split) AS available_splits, bool_or(split = 'train') AS t, bool_or(split = 'validation') AS v FROM s GROUP BY 1)
SELECT dataset, available_splits, CASE WHEN t THEN 'available' ELSE 'unavailable' END AS train_status, CASE WHEN v THEN 'available' ELSE 'unavailable' END AS validation_status,
false AS fallback_used, 'train: ' || CASE WHEN t THEN 'available' ELSE 'unavailable' END || '; validation: ' || CASE WHEN v THEN 'available' ELSE 'unavailable' END AS notes FROM a""",
)
def capability_split_rows(spark, sf_dir):
    draw = hash_fraction("doc_id", 5)
    split = F.when(draw < 0.02, "validation").when(draw < 0.05, "train").otherwise("test")
    splits = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), split.alias("split"))
    # At most three split names per dataset.
    available = splits.groupBy("dataset").agg(F.array_sort(F.collect_set("split")).alias("available_splits"))
    requested = available.withColumn("r", F.explode(F.array(*[F.struct(F.lit(i).alias("selection_order"), F.lit(n).alias("requested_split")) for i, n in enumerate(("train", "validation"))])))
    status = F.when(F.array_contains("available_splits", F.col("r.requested_split")), "available").otherwise("unavailable")
    selections = requested.select("dataset", "available_splits", "r.*", status.alias("status"), F.lit(False).alias("fallback_used"))
    return A.split_rows(selections.withColumn("note", F.concat_ws(": ", "requested_split", "status")))
