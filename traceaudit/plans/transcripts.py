"""Transcript normalisation and pairs over conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.hashing import context_seed, ordered_hash
from traceaudit.functions.stats import sequence_score
from traceaudit.functions.text import split_words, with_leading_space
from traceaudit.operators import transcripts as X
from traceaudit.plans.corpus import key_sql
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


# Conversation turns as raw JSON log rows with differing field names.
def raw_log(spark, sf_dir):
    turn = F.col("turn")
    message = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    record = (
        F.when(turn % 4 == 0, F.to_json(F.struct("conv_id", F.col("text").alias("prompt"))))
        .when(turn % 4 == 1, F.to_json(F.struct(F.col("turn").alias("id"), F.lit("  ").alias("prompt"), F.col("text").alias("question"))))
        .when(turn % 4 == 2, F.to_json(F.struct(F.array(message).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("instruction")).alias("request"))))
    )
    return conversations(spark, sf_dir).select(
        "conv_id", "turn", F.parse_json(record).alias("raw"), (F.col("conv_id") * 100 + turn).alias("source_index"), F.lit("log").alias("source_path")
    )


STRIP = r"regexp_replace(text, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"


@query(
    "transcript_query_log",
    f"""SELECT CASE WHEN turn % 4 = 1 THEN turn::VARCHAR ELSE format('teacher_query_{{:06d}}', conv_id * 100 + turn) END AS id, {STRIP} AS query, (conv_id * 100 + turn)::BIGINT AS source_index FROM conversations WHERE trim(text) <> ''""",
)
def transcript_query_log(spark, sf_dir):
    kept, _ = X.normalize_query_log(raw_log(spark, sf_dir), "raw", "source_index", "source_path")
    return kept.select("id", "query", "source_index")


@query(
    "transcript_query_log_counts",
    "SELECT count(*) FILTER (trim(text) <> '')::BIGINT AS num_queries, count(*) FILTER (trim(text) = '')::BIGINT AS skipped_records FROM conversations",
)
def transcript_query_log_counts(spark, sf_dir):
    return X.normalize_query_log(raw_log(spark, sf_dir), "raw", "source_index", "source_path")[1]


@query(
    "transcript_first_user_turn",
    f"SELECT conv_id, arg_min({STRIP}, turn) AS query FROM conversations WHERE role IN ('user', 'human') AND trim(text) <> '' GROUP BY 1",
)
def transcript_first_user_turn(spark, sf_dir):
    return X.first_user_turn(conversations(spark, sf_dir))


@query("transcript_last_user_turn", "SELECT conv_id, arg_max(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1")
def transcript_last_user_turn(spark, sf_dir):
    return X.last_user_turn(conversations(spark, sf_dir))


@query(
    "transcript_chat_prompts",
    "SELECT conv_id, turn, role || ': ' || text AS prompt FROM conversations",
)
def transcript_chat_prompts(spark, sf_dir):
    def message(role, *parts):
        return F.struct(role.alias("role"), F.array(*parts).alias("content"))

    request = F.array(
        message(F.lit("user"), F.lit("earlier")),
        message(F.lit("user"), F.lit(""), F.concat_ws(": ", "role", "text")),
        message(F.lit("assistant"), F.lit("later")),
    )
    return conversations(spark, sf_dir).select("conv_id", "turn", X.chat_prompt(request).alias("prompt"))


SIDES = """
t AS (SELECT conv_id, arg_min(text, turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY 1),
u AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT conv_id, arg_max(text, turn) AS r FROM conversations WHERE turn > 1 AND role = 'assistant' GROUP BY 1)"""


def sides(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    assistant, user = turns.filter("role = 'assistant'"), turns.filter("role = 'user'")
    answers = assistant.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"))
    prompts = user.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    later = assistant.filter("turn > 1").groupBy("conv_id").agg(F.max_by("text", "turn").alias("r"))
    return prompts, answers, later


@query("transcript_pairs", f"WITH {SIDES} SELECT conv_id AS id, q AS prompt, a AS teacher_text, r AS student_text FROM u JOIN t USING (conv_id) JOIN s USING (conv_id)")
def transcript_pairs(spark, sf_dir):
    prompts, answers, later = sides(spark, sf_dir)
    teacher = prompts.join(answers, "conv_id").select(
        F.col("conv_id").alias("id"), F.col("q").alias("prompt"), F.col("a").alias("teacher_text"), F.lit(0).alias("position")
    )
    student = later.select(F.col("conv_id").alias("id"), F.lit("").alias("prompt"), F.col("r").alias("student_text"))
    return X.build_pairs(student, teacher)


def preference_sides(spark, sf_dir):
    prompts, answers, later = sides(spark, sf_dir)
    teacher = prompts.join(answers, "conv_id", "left").select(
        F.col("conv_id").alias("prompt_id"), F.col("q").alias("prompt"), F.col("a").alias("response")
    )
    student = later.select(F.col("conv_id").alias("prompt_id"), F.col("r").alias("response"), F.lit(0).alias("position"))
    return teacher, student


@query(
    "transcript_preference_pairs",
    f"WITH {SIDES} SELECT conv_id AS prompt_id, q AS prompt, a AS chosen, r AS rejected FROM u JOIN t USING (conv_id) JOIN s USING (conv_id) WHERE a <> '' AND r <> ''",
)
def transcript_preference_pairs(spark, sf_dir):
    return X.preference_pairs(*preference_sides(spark, sf_dir))[0].select("prompt_id", "prompt", "chosen", "rejected")


@query(
    "transcript_preference_stats",
    f"""WITH {SIDES} SELECT CASE WHEN s.conv_id IS NULL THEN 'missing_student' WHEN coalesce(a, '') = '' THEN 'invalid_teacher' WHEN r = '' THEN 'invalid_student' ELSE 'written' END AS status, count(*)::BIGINT AS n
FROM u LEFT JOIN t USING (conv_id) LEFT JOIN s USING (conv_id) GROUP BY 1""",
)
def transcript_preference_stats(spark, sf_dir):
    return X.preference_pairs(*preference_sides(spark, sf_dir))[1]


@query(
    "transcript_coverage_gap",
    f"WITH {SIDES} SELECT count(*)::BIGINT AS target_ids, count(s.conv_id)::BIGINT AS covered_ids, (count(*) - count(s.conv_id))::BIGINT AS missing_ids FROM u LEFT JOIN s USING (conv_id)",
)
def transcript_coverage_gap(spark, sf_dir):
    prompts, _, later = sides(spark, sf_dir)
    return X.coverage_gap(prompts, later, "conv_id")


@query(
    "transcript_import",
    """WITH o AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS order_index FROM conversations)
SELECT format('external_{:06d}', conv_id * 1000 + turn) AS query_id, order_index::BIGINT AS order_index, text AS prompt_text, role || '/' || text AS teacher_response FROM o WHERE order_index < 60""",
)
def transcript_import(spark, sf_dir):
    rows = conversations(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row"), F.col("text").alias("prompt"), F.concat_ws("/", "role", "text").alias("output")
    )
    found = X.import_transcript(rows, X.column_fields(rows), "row", 60)
    return found.select("query_id", "order_index", "prompt_text", "teacher_response")


@query(
    "transcript_received_queries",
    "SELECT CASE WHEN turn = 0 THEN format('offline_{:06d}', conv_id) ELSE turn::VARCHAR END AS query_id, coalesce(text, '') AS query FROM conversations",
)
def transcript_received_queries(spark, sf_dir):
    rows = conversations(spark, sf_dir).select(F.col("turn").alias("id"), F.col("text").alias("prompt_text"), "conv_id")
    return X.query_log(rows, X.column_fields(rows), "conv_id").select("query_id", "query")


@query(
    "transcript_pool_records",
    "SELECT CASE WHEN doc_id = 0 THEN 'row_00000000' ELSE doc_id::VARCHAR END AS prompt_id, CASE WHEN n_chars < 500 THEN source ELSE text END AS prompt_text FROM documents",
)
def transcript_pool_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 500, "").otherwise(F.col("text")).alias("prompt"), F.col("source").alias("query")
    )
    get = X.column_fields(rows)
    return rows.select(X.pool_id(get, "id").alias("prompt_id"), X.pool_text(get).alias("prompt_text"))


@query(
    "transcript_record_fields",
    "SELECT doc_id::VARCHAR AS prompt_id, CASE WHEN n_chars < 500 THEN lang ELSE source END AS prompt, text AS response FROM documents",
)
def transcript_record_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"),
        F.when(F.col("n_chars") < 500, "").otherwise(F.col("source")).alias("prompt"),
        F.col("lang").alias("instruction"),
        F.lit("").alias("student_response"),
        F.col("text").alias("output"),
    )
    get = X.column_fields(rows)
    return rows.select(
        X.record_id(get, "example_id").alias("prompt_id"),
        X.record_prompt(get).alias("prompt"),
        X.record_response(get, "student_response").alias("response"),
    )


@query(
    "transcript_normalised_triples",
    "SELECT conv_id::VARCHAR AS query_id, CASE WHEN turn % 2 = 0 THEN role ELSE text END AS query, text AS response FROM conversations",
)
def transcript_normalised_triples(spark, sf_dir):
    rows = conversations(spark, sf_dir).select(
        F.col("conv_id").alias("qid"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("rendered_prompt"),
        F.col("text").alias("w_wm_output"), F.col("text").alias("input"), "turn",
    )
    return X.normalize_transcript(rows, X.column_fields(rows), "turn").select("query_id", "query", "response")


@query(
    "transcript_normalised_queries",
    "SELECT CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE conv_id::VARCHAR END AS query_id, text AS query FROM conversations",
)
def transcript_normalised_queries(spark, sf_dir):
    rows = conversations(spark, sf_dir).select(
        F.when(F.col("turn") % 2 == 1, F.col("conv_id")).alias("uid"), F.lit(None).cast("string").alias("query"), F.col("text").alias("problem"), "turn"
    )
    return X.normalize_query(rows, X.column_fields(rows), "turn").select("query_id", "query")


@query(
    "transcript_dialogues",
    """SELECT conv_id, turn, 'User: ' || role || chr(10) || 'Assistant: ' || text AS plain, '### User:' || chr(10) || text || chr(10) || chr(10) || '### Assistant:' || chr(10) AS headed,
CASE WHEN turn = 0 THEN text ELSE role || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' END AS framed FROM conversations""",
)
def transcript_dialogues(spark, sf_dir):
    return conversations(spark, sf_dir).select(
        "conv_id",
        "turn",
        X.render_dialogue("role", "text", "plain").alias("plain"),
        X.render_dialogue("text", style="headed").alias("headed"),
        X.render_dialogue("text", style="system", system=F.when(F.col("turn") > 0, F.col("role"))).alias("framed"),
    )


# Answers wrapped in JSON, with and without noise around it.
CLEANED = """
c AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'kept' WHEN 'view' THEN CASE WHEN value < 10 THEN 'rejected_or_unsure' ELSE 'kept' END
 WHEN 'error' THEN 'json_parse_failed' WHEN 'signup' THEN 'empty_response' ELSE 'rejected_or_unsure' END AS reason FROM events)"""


def answers(spark, sf_dir):
    value = F.col("value").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"answer": "'), value, F.lit('", "sentence": " because "}')))
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit('Sure: {"answer": "'), F.when(F.col("value") < 10, "n/a").otherwise(value), F.lit('"} hope it helps')),
        )
        .when(F.col("event_type") == "error", F.concat(F.lit("{broken "), value, F.lit("}")))
        .when(F.col("event_type") == "signup", F.lit("   "))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", "value", raw.alias("raw_response"))


@query("transcript_clean_outcomes", f"WITH {CLEANED} SELECT reason, count(*)::BIGINT AS n FROM c GROUP BY ROLLUP (reason)")
def transcript_clean_outcomes(spark, sf_dir):
    return X.clean_responses(answers(spark, sf_dir), "raw_response")[2].select("reason", "n")


@query(
    "transcript_clean_kept",
    f"WITH {CLEANED} SELECT event_id, CASE WHEN event_type = 'click' THEN 'because' ELSE '' END AS supporting_sentence FROM c WHERE reason = 'kept'",
)
def transcript_clean_kept(spark, sf_dir):
    return X.clean_responses(answers(spark, sf_dir), "raw_response")[0].select("event_id", "supporting_sentence")


@query(
    "transcript_training_pairs",
    "SELECT event_id AS prompt_id, CASE WHEN value < 5 THEN props ELSE event_type END AS prompt, value::VARCHAR IS NOT NULL AS has_response, user_id AS query_id FROM events",
)
def transcript_training_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("prompt_id"),
        F.when(F.col("value") < 5, "").otherwise(F.col("event_type")).alias("source_prompt"),
        F.col("props").alias("templated_query"),
        F.col("value").cast("string").alias("response"),
        F.col("user_id").alias("query_id"),
        F.lit("").alias("supporting_sentence"),
    )
    found = X.to_pairs(rows, "model_leeching", "json_answer_v1")
    return found.select("prompt_id", "prompt", F.col("response").isNotNull().alias("has_response"), "metadata.query_id")


@query(
    "transcript_ledger",
    """SELECT user_id, count(*) FILTER (event_type <> 'error')::BIGINT AS successful_queries, count(*)::BIGINT AS api_attempts, count(*) FILTER (event_type = 'error')::BIGINT AS failed_attempts FROM events GROUP BY 1""",
)
def transcript_ledger(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return X.ledger(table(spark, sf_dir, "events").select("user_id", status.alias("status")), ["user_id"])


@query(
    "transcript_completion",
    """WITH s AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 60) AS ok, count(*) AS n FROM events WHERE value > 40 GROUP BY 1),
d AS (SELECT count(*) AS n, sum(('0x' || substr(md5('1:' || user_id), 1, 15))::BIGINT::HUGEINT) % (1::HUGEINT << 60) AS a, sum(('0x' || substr(md5('2:' || user_id), 1, 15))::BIGINT::HUGEINT) % (1::HUGEINT << 60) AS b FROM s WHERE ok)
SELECT (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS prompt_count, count(*) FILTER (ok)::BIGINT AS completed_count, count(*) FILTER (NOT ok)::BIGINT AS failed_count, sum(s.n)::BIGINT AS written_rows,
(SELECT sha256(n || ':' || coalesce(a, 0) || ':' || coalesce(b, 0)) FROM d) AS completed_id_hash FROM s""",
)
def transcript_completion(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    outputs = events.filter("value > 40").select("user_id", F.when(done, "success").otherwise("failed").alias("status"))
    return X.completion(events, outputs, "user_id")


@query(
    "transcript_bundle_rules",
    """WITH o AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'duplicate_query_id' AS rule FROM (SELECT source FROM o GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'row_count' WHERE (SELECT count(*) FROM documents) <> 77 UNION ALL SELECT 'query_not_successful' WHERE (SELECT count(*) FROM documents WHERE n_chars < 300) > 0) GROUP BY 1""",
)
def transcript_bundle_rules(spark, sf_dir):
    rows = X.positions(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["doc_id"])
    records = rows.select(
        F.col("doc_id").alias("prompt_id"),
        F.col("source").alias("query_id"),
        (F.col("position") - 1).alias("order_index"),
        F.when(F.col("n_chars") < 300, "failed").otherwise("success").alias("query_status"),
    )
    return X.bundle_violations(records, 77, "greedy").groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "transcript_prefix_rules",
    """SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'id_differs' AS rule FROM documents WHERE lang = 'de' UNION ALL SELECT 'source_text_differs' FROM documents WHERE n_chars % 10 = 0) GROUP BY 1""",
)
def transcript_prefix_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    source = docs.select(F.col("doc_id").alias("position"), F.col("source").alias("query_id"), F.col("text").alias("response"))
    output = docs.select(
        F.col("doc_id").alias("position"),
        F.when(F.col("lang") == "de", "x").otherwise(F.col("source")).alias("query_id"),
        F.when(F.col("n_chars") % 10 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")).alias("source_response"),
    )
    return X.prefix_violations(output, source).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "transcript_reused_outputs",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def transcript_reused_outputs(spark, sf_dir):
    return X.reuse_outputs(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


# Row hashes, hashed in blocks of 64 and blocks of blocks.
@query(
    "transcript_ordering_hash",
    """WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, sha256('{"doc_id":' || doc_id || ',"text":' || to_json(text)::VARCHAR || '}') AS h FROM documents),
a AS (SELECT p // 64 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, count(*) AS n FROM r GROUP BY p // 64), b AS (SELECT p // 64 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY p // 64)
SELECT 'block-sha256/64' AS scheme, sum(n)::BIGINT AS row_count, sha256(string_agg(h, chr(10) ORDER BY p)) AS ordering_hash FROM b""",
)
def transcript_ordering_hash(spark, sf_dir):
    ordered = X.positions(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return ordered_hash(ordered, "position", ["doc_id", "text"], block=64)


# Word lengths stand in for token ids.
def token_ids(spark, sf_dir):
    words = split_words("text")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.transform(words, lambda w: F.char_length(w)).alias("ids"))


IDS = f"ids AS (SELECT doc_id, lang, [len(w) FOR w IN string_split(trim(regexp_replace(text, '[\\s\\v\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), ' ') IF w <> ''] AS ids FROM documents)"


@query(
    "transcript_length_stats",
    f"""WITH {IDS}, p AS (SELECT lang, len(ids) AS n, least(len(ids), 40) AS k FROM ids)
SELECT lang, count(*)::BIGINT AS total_records, count(*) FILTER (k < 300 AND least(n, 300) > k)::BIGINT AS valid_records, count(*) FILTER (NOT (k < 300 AND least(n, 300) > k))::BIGINT AS skipped_records,
count(*) FILTER (k < 300 AND n > 300)::BIGINT AS truncated_records FROM p GROUP BY 1""",
)
def transcript_length_stats(spark, sf_dir):
    rows = token_ids(spark, sf_dir).withColumn("prompt", F.slice("ids", 1, 40))
    return X.length_stats(rows, "prompt", "ids", 300, ["lang"])


@query(
    "transcript_loss_mask",
    f"""WITH {IDS} SELECT doc_id, list_sum([x FOR x, i IN ids[1:50] IF i > 10])::BIGINT AS label_sum, (50 - len(ids[1:50]))::BIGINT AS padding, len(ids[1:50])::BIGINT AS attended FROM ids""",
)
def transcript_loss_mask(spark, sf_dir):
    rows = token_ids(spark, sf_dir).select("doc_id", X.loss_mask("ids", F.lit(10), 50).alias("m"))
    total = F.aggregate(F.filter("m.labels", lambda v: v != -100), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    attended = F.aggregate("m.attention_mask", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return rows.select(
        "doc_id", F.when(F.exists("m.labels", lambda v: v != -100), total).alias("label_sum"), (50 - attended).alias("padding"), attended.alias("attended")
    )


@query("transcript_head_tokens", f"WITH {IDS} SELECT doc_id, array_to_string(ids[1:8], ',') AS head FROM ids")
def transcript_head_tokens(spark, sf_dir):
    rows = token_ids(spark, sf_dir)
    return rows.select("doc_id", F.array_join(X.head_tokens("ids", 8).cast("array<string>"), ",").alias("head"))


@query(
    "transcript_context_seeds",
    f"WITH {IDS} SELECT doc_id, (('0x' || substr(sha256('secret|' || array_to_string(ids[-4:], ',')), 1, 16))::UBIGINT % 9223372036854775807)::BIGINT AS seed FROM ids",
)
def transcript_context_seeds(spark, sf_dir):
    return token_ids(spark, sf_dir).select("doc_id", context_seed("secret", "ids", 4).alias("seed"))


@query(
    "transcript_sequence_scores",
    """WITH e AS (SELECT vec_id, [x::DOUBLE FOR x, i IN embedding IF i % 3 <> 0] AS kept FROM embeddings)
SELECT vec_id, round(list_sum(kept), 6) AS sum_log_prob, round(list_sum(kept) / len(kept), 6) AS mean_log_prob, round(exp(list_sum(kept) / len(kept)), 6) AS geometric_mean_prob, len(kept)::BIGINT AS scored_tokens FROM e""",
)
def transcript_sequence_scores(spark, sf_dir):
    log_probs = F.transform("embedding", lambda x: x.cast("double"))
    mask = F.transform("embedding", lambda _, i: ((i + 1) % 3 != 0).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sequence_score(log_probs, mask).alias("s"))
    rounded = ("sum_log_prob", "mean_log_prob", "geometric_mean_prob")
    return rows.select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in rounded], "s.scored_tokens")


@query(
    "transcript_path_identity",
    """SELECT event_id, event_type AS attack, 'd' || (user_id % 3) AS defense, user_id AS budget FROM events""",
)
def transcript_path_identity(spark, sf_dir):
    path = F.concat(F.lit("/data/outputs/d"), (F.col("user_id") % 3).cast("string"), F.lit("/"), F.col("event_type"), F.lit("/b"), F.col("user_id").cast("string"), F.lit("/run/manifest.json"))
    rows = table(spark, sf_dir, "events").select("event_id", X.path_identity(path).alias("p"))
    return rows.select("event_id", "p.attack", "p.defense", "p.budget")


@query(
    "transcript_safe_names",
    "SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.=-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)",
)
def transcript_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_component("url").alias("name"))


@query("transcript_choice_continuations", "SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\s]') THEN text ELSE ' ' || text END AS continuation FROM documents")
def transcript_choice_continuations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", with_leading_space(F.col("text")).alias("continuation"))


@query(
    "transcript_key_changes",
    f"SELECT count(*) FILTER ({key_sql('text')} <> text)::BIGINT AS changed, count(*)::BIGINT AS n FROM benchmark",
)
def transcript_key_changes(spark, sf_dir):
    from traceaudit.functions.text import norm_key

    rows = table(spark, sf_dir, "benchmark")
    return rows.agg(F.count_if(norm_key("text") != F.col("text")).alias("changed"), F.count(F.lit(1)).alias("n"))
