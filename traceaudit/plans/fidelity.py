"""Teacher and student agreement over documents, conversations, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import fidelity as D
from traceaudit.plans.corpus import key_sql
from traceaudit.plans.registry import Catalog, table
from traceaudit.plans.text import WS

CATALOG = Catalog()
query = CATALOG.query


# Teacher samples are all documents, student samples those with labels.
def sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("task"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("none").alias("filter"),
        F.md5("text").alias("signature"),
        (F.col("n_chars") % 2).cast("bigint").alias("prediction"),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("bigint").alias("p"))
    student = docs.drop("prediction").join(labels, "doc_id").withColumnRenamed("p", "prediction")
    return docs, student


@query(
    "fidelity_agreement",
    """SELECT lang AS task, round(avg((n_chars % 2 = quality)::INT), 9) AS agreement_rate, count(*) FILTER (n_chars % 2 = quality)::BIGINT AS matched, count(*)::BIGINT AS n
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""",
)
def fidelity_agreement(spark, sf_dir):
    rates, _ = D.agreement(*sides(spark, sf_dir), allow_partial=True)
    return rates.withColumn("agreement_rate", F.round("agreement_rate", 9))


@query(
    "fidelity_agreement_coverage",
    "SELECT count(*) FILTER (l.doc_id IS NULL)::BIGINT AS teacher_only, 0::BIGINT AS student_only, count(l.doc_id)::BIGINT AS n FROM documents LEFT JOIN labels l USING (doc_id)",
)
def fidelity_agreement_coverage(spark, sf_dir):
    return D.agreement(*sides(spark, sf_dir), allow_partial=True)[1]


@query("fidelity_sample_rules", "SELECT 'duplicate_sample' AS rule, count(*)::BIGINT AS broken FROM (SELECT lang, source FROM documents GROUP BY 1, 2 HAVING count(*) > 1)")
def fidelity_sample_rules(spark, sf_dir):
    found = D.sample_violations(table(spark, sf_dir, "documents"), ["lang", "source"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "fidelity_choose",
    """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS choice,
 (list_position(n, list_max(n)) - 1)::BIGINT AS per_byte FROM (SELECT vec_id, embedding, [x::DOUBLE / ((i - 1) % 5 + 1) FOR x, i IN embedding] AS n FROM embeddings)""",
)
def fidelity_choose(spark, sf_dir):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    continuations = F.transform("embedding", lambda x, i: F.repeat(F.lit("x"), i % 5 + 1))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", D.choose(scores).alias("choice"), D.choose(scores, continuations).alias("per_byte")
    )


@query(
    "fidelity_perplexity",
    """WITH t AS (SELECT event_type, value / 100 AS nll, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS tok FROM events)
SELECT event_type, sum(tok)::BIGINT AS scored_token_count, count(*)::BIGINT AS scored_text_count, round(avg(exp(nll)), 6) AS macro_mean_perplexity,
 round(sum(nll * tok) / sum(tok), 6) AS corpus_mean_nll, round(exp(sum(nll * tok) / sum(tok)), 6) AS corpus_perplexity FROM t GROUP BY 1""",
)
def fidelity_perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("value") / 100).alias("mean_nll"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("scored_tokens"),
    )
    found = D.perplexity_report(rows, ["event_type"])
    rounded = ("macro_mean_perplexity", "corpus_mean_nll", "corpus_perplexity")
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "fidelity_perplexity_overflow",
    "SELECT count(*) FILTER (value * 4 > 709.782712893384)::BIGINT AS overflowing, count(*)::BIGINT AS texts FROM events",
)
def fidelity_perplexity_overflow(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(D.safe_exp(F.col("value") * 4).alias("ppl"))
    return rows.agg(F.count_if(F.col("ppl").isNull()).alias("overflowing"), F.count(F.lit(1)).alias("texts"))


@query(
    "fidelity_cross_perplexity",
    """WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, user_id % 4 AS ta, user_id % 2 AS tb FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN ta = tb THEN sqrt(a * b) END, 6) AS symmetric, CASE WHEN a IS NULL OR b IS NULL THEN 'At least one perplexity overflowed the finite JSON range.'
 WHEN ta <> tb THEN 'The two PPL directions use different tokenizer vocabularies.' END AS reason FROM u""",
)
def fidelity_cross_perplexity(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"),
    )
    cross = D.cross_perplexity(F.col("a"), F.col("b"), F.col("user_id") % 4, F.col("user_id") % 2)
    return users.withColumn("c", cross).select(
        "user_id", F.round("c.value", 6).alias("symmetric"), F.col("c.reason").alias("reason")
    )


# The first user turn and the first answer of a conversation form a pair.
def pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")

    def first(role):
        return F.min_by("text", F.when(F.col("role") == role, F.col("turn")))

    return turns.groupBy(F.col("conv_id").alias("id")).agg(
        first("user").alias("teacher_text"), first("assistant").alias("student_text")
    )


# The table of common subsequences, row by row for all pairs: a row is the running maximum of the one before it, and of
# its left neighbour plus one where tokens agree.
ROUGE_SQL = rf"""WITH RECURSIVE f AS (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS t, arg_min(text, turn) FILTER (role = 'assistant') AS s FROM conversations GROUP BY 1),
c AS (SELECT id, t, s FROM f WHERE t IS NOT NULL AND s IS NOT NULL), tk AS (SELECT id, {{left}} AS a, {{right}} AS b FROM c),
ta AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM tk), tb AS (SELECT id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS y FROM tk),
dp AS (SELECT id, 0::BIGINT AS i, j, 0::BIGINT AS v FROM tb UNION ALL
  SELECT id, i + 1, j, max(u) OVER (PARTITION BY id ORDER BY j) FROM (SELECT dp.id, dp.i, dp.j, CASE WHEN x = y THEN coalesce(lag(v) OVER (PARTITION BY dp.id ORDER BY dp.j), 0) + 1 ELSE v END AS u
  FROM dp JOIN ta ON ta.id = dp.id AND ta.i = dp.i + 1 JOIN tb ON tb.id = dp.id AND tb.j = dp.j)),
l AS (SELECT id, max(v) AS n FROM dp GROUP BY 1),
r AS (SELECT tk.id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (len(a) + len(b)) END AS f1, a, b FROM tk LEFT JOIN l USING (id))"""


def rouge_tokens_sql(column: str) -> str:
    return rf"[lower(x) FOR x IN regexp_extract_all({column}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*|[^{WS}]')]"


def key_words_sql(column: str) -> str:
    return f"CASE WHEN {key_sql(column)} = '' THEN [] ELSE string_split({key_sql(column)}, ' ') END"


@query(
    "fidelity_rouge",
    f"""{ROUGE_SQL.format(left=rouge_tokens_sql('t'), right=rouge_tokens_sql('s'))},
base AS (SELECT avg(CASE WHEN list_contains(a, 'the') THEN 2.0 / (len(a) + 1) ELSE 0.0 END) AS v FROM tk)
SELECT round(avg(f1), 9) AS rouge_l_f1, count(*)::BIGINT AS n, round(any_value(v), 9) AS base_rouge_l_f1, round(avg(f1) - any_value(v), 9) AS gain_over_base FROM r, base""",
)
def fidelity_rouge(spark, sf_dir):
    complete = pairs(spark, sf_dir).dropna()
    base = complete.withColumn("student_text", F.lit("the"))
    found = D.rouge_report(complete, base)
    return found.withColumns({c: F.round(c, 9) for c in ("rouge_l_f1", "base_rouge_l_f1", "gain_over_base")})


@query(
    "fidelity_heldout_text",
    f"""{ROUGE_SQL.format(left=key_words_sql('t'), right=key_words_sql('s'))}
SELECT count(*)::BIGINT AS n, round(avg(({key_sql('t')} = {key_sql('s')})::INT), 9) AS agreement_rate, round(avg(f1), 9) AS rouge_l FROM r JOIN c USING (id)""",
)
def fidelity_heldout_text(spark, sf_dir):
    found = D.heldout_fidelity(pairs(spark, sf_dir).dropna())
    return found.withColumns({c: F.round(c, 9) for c in ("agreement_rate", "rouge_l")})


# Students repeat even documents with extra blanks and change odd ones.
@query(
    "fidelity_normalised_agreement",
    f"""WITH p AS (SELECT text AS t, CASE WHEN doc_id % 2 = 0 THEN '  ' || replace(text, ' ', '  ') ELSE text || ' x' END AS s FROM documents)
SELECT count(*)::BIGINT AS n, count(*) FILTER ({key_sql('t')} = {key_sql('s')})::BIGINT AS equal, round(avg(({key_sql('t')} = {key_sql('s')})::INT), 9) AS agreement_rate FROM p""",
)
def fidelity_normalised_agreement(spark, sf_dir):
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))
    student = F.when(F.col("doc_id") % 2 == 0, spaced).otherwise(F.concat("text", F.lit(" x")))
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("teacher_text"), student.alias("student_text"))
    return D.normalised_agreement(rows).withColumn("agreement_rate", F.round("agreement_rate", 9))


@query(
    "fidelity_pair_rules",
    """WITH p AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u, arg_min(text, turn) FILTER (role = 'assistant') AS a, arg_min(text, turn) FILTER (role = 'system') AS s FROM conversations GROUP BY 1)
SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'missing_teacher_text' AS rule FROM p WHERE u IS NULL UNION ALL SELECT 'missing_student_text' FROM p WHERE a IS NULL
UNION ALL SELECT 'blank_prompt' FROM p WHERE coalesce(trim(s), '') = '') GROUP BY 1""",
)
def fidelity_pair_rules(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    system = turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.min_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("prompt")
    )
    found = D.text_pair_violations(pairs(spark, sf_dir).join(system, "id"), require_prompt=True)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "fidelity_aligned_rules",
    """WITH d AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS other FROM documents)
SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'only_first' AS rule FROM d WHERE lang = 'es' UNION ALL SELECT 'teacher_text_differs' FROM d WHERE lang <> 'es' AND doc_id % 7 = 0) GROUP BY 1""",
)
def fidelity_aligned_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("prompt"), F.col("text").alias("teacher_text"), "lang"
    )
    changed = F.when(F.col("id") % 7 == 0, F.concat("teacher_text", F.lit("!"))).otherwise(F.col("teacher_text"))
    other = docs.filter("lang <> 'es'").withColumn("teacher_text", changed)
    return D.aligned_violations(docs, other).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "fidelity_reference_rules",
    """WITH p AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u FROM conversations GROUP BY 1),
t AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1 HAVING count(*) > 2)
SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'missing_teacher' AS rule FROM p WHERE conv_id NOT IN (SELECT conv_id FROM t)
UNION ALL SELECT 'blank_answer' FROM t WHERE coalesce(trim(a), '') = '') GROUP BY 1""",
)
def fidelity_reference_rules(spark, sf_dir):
    prompts = pairs(spark, sf_dir).select("id", F.col("teacher_text").alias("prompt"))
    long = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("turns")).filter("turns > 2")
    teacher = pairs(spark, sf_dir).join(long, "id", "left_semi").select(
        "id", F.col("teacher_text").alias("prompt"), F.col("student_text").alias("response")
    )
    return D.reference_violations(prompts, teacher).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


# Token offsets of four characters each; the boundary is the length of the source name.
@query(
    "fidelity_score_mask",
    """WITH d AS (SELECT doc_id, n_chars, length(source) AS b, [i * 4 FOR i IN range(0, n_chars // 4)] AS starts FROM documents)
SELECT doc_id, len([s FOR s IN starts IF s >= b])::BIGINT AS scored_tokens, len([s FOR s IN starts IF s < b AND b < s + 4]) > 0 AS splits_token FROM d""",
)
def fidelity_score_mask(spark, sf_dir):
    count = F.floor(F.col("n_chars") / 4).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.transform(starts, lambda i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("end"))).alias("offsets"),
        F.length("source").alias("boundary"),
    )
    mask = D.score_mask(F.col("offsets"), F.col("boundary"))
    broken = D.boundary_violations(rows, "doc_id", "offsets", "boundary").filter("rule = 'boundary_splits_token'")
    splits = broken.select(F.col("row_key").cast("bigint").alias("doc_id"), F.lit(True).alias("splits_token"))
    scored = rows.select("doc_id", F.size(F.filter(mask, lambda m: m)).cast("bigint").alias("scored_tokens"))
    return scored.join(splits, "doc_id", "left").fillna(False, ["splits_token"])
