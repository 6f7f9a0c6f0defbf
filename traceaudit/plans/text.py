"""Answer parsers and text functions over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions import parsing as A
from traceaudit.functions import text as S
from traceaudit.functions.stats import clip
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

WS = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


NUMBER = rf"[-+]?[{WS}]*[$€£¥]?[{WS}]*(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?"


@query(
    "text_parse_number",
    rf"""WITH m AS (SELECT doc_id, list_last(regexp_extract_all(text, '(?i)(?:####|(?:final[{WS}]+answer|answer)[{WS}]*(?:is|:|=)?)[{WS}]*({NUMBER})', 1)) AS marked, list_last(regexp_extract_all(text, '{NUMBER}')) AS lone FROM documents),
r AS (SELECT doc_id, regexp_replace(coalesce(marked, lone), '[$€£¥,{WS}]', '', 'g') AS b FROM m),
p AS (SELECT doc_id, b, regexp_extract(b, '^[-+]?0*([0-9]*)', 1) AS w, rtrim(regexp_extract(b, '\.([0-9]*)$', 1), '0') AS f FROM r),
d AS (SELECT doc_id, b, CASE WHEN w = '' THEN '0' ELSE w END || CASE WHEN f = '' THEN '' ELSE '.' || f END AS n FROM p)
SELECT doc_id, CASE WHEN b IS NULL THEN NULL WHEN b[1] = '-' AND n <> '0' THEN '-' || n ELSE n END AS normalized, CASE WHEN b IS NULL THEN 'failed' ELSE 'success' END AS status FROM d""",
)
def text_parse_number(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", A.parse_number("text").alias("p"))
    return rows.select("doc_id", "p.normalized", "p.status")


@query(
    "text_parse_label",
    r"""WITH t AS (SELECT conv_id, turn, list_last(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\1\1', 'g'), '(?i)(?:^|[^A-Za-z0-9])(the|and|und|les|la)(?:$|[^A-Za-z0-9])', 1)) AS raw FROM conversations)
SELECT conv_id, turn, raw AS parsed, CASE lower(raw) WHEN 'und' THEN 'and' ELSE lower(raw) END AS normalized, CASE WHEN raw IS NULL THEN 'failed' ELSE 'success' END AS status FROM t""",
)
def text_parse_label(spark, sf_dir):
    parsed = A.parse_label("text", ["the", "and", "les", "la"], {"und": "and"})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parsed.alias("p"))
    return rows.select("conv_id", "turn", "p.parsed", "p.normalized", "p.status")


@query(
    "text_parse_choice",
    """SELECT event_id, CASE event_type WHEN 'click' THEN chr((65 + floor(value)::BIGINT % 4)::INTEGER) WHEN 'view' THEN chr((65 + user_id % 4)::INTEGER) WHEN 'signup' THEN chr((65 + floor(value)::BIGINT % 4)::INTEGER) WHEN 'purchase' THEN 'B' END AS normalized,
CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events""",
)
def text_parse_choice(spark, sf_dir):
    letter = F.char(F.floor("value").cast("bigint") % 4 + 65)
    other = F.char(F.col("user_id") % 4 + 65)
    response = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("The answer is "), other, F.lit(".\nWait.\nFinal answer: ("), letter, F.lit(")")))
        .when(F.col("event_type") == "view", F.concat(F.lit(" ("), F.lower(other), F.lit("). ")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Let me see.\nOption ("), letter, F.lit(")\n\n")))
        .when(F.col("event_type") == "purchase", F.lit("Answer: C. Hmm, therefore the right option is B"))
        .otherwise(F.lit("Either A or B"))
    )
    parsed = A.parse_choice(response, ["A", "B", "C", "D"])
    rows = table(spark, sf_dir, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", "p.normalized", "p.status")


# Whole documents with an answer behind them, whatever markers their own text holds.
@query(
    "text_parse_choice_marked",
    "SELECT doc_id, chr((65 + doc_id % 5)::INTEGER) AS normalized, 'success' AS status FROM documents",
)
def text_parse_choice_marked(spark, sf_dir):
    letter = F.char(F.col("doc_id") % 5 + 65)
    answered = F.concat("text", F.lit("\nFinal answer: ("), F.lower(letter), F.lit(")"))
    rows = documents(spark, sf_dir).select("doc_id", A.parse_choice(answered, ["A", "B", "C", "D", "E"]).alias("p"))
    return rows.select("doc_id", "p.normalized", "p.status")


@query("text_probe_choice_marked", "SELECT doc_id, chr((65 + doc_id % 5)::INTEGER) AS choice FROM documents")
def text_probe_choice_marked(spark, sf_dir):
    letter = F.char(F.col("doc_id") % 5 + 65)
    answered = F.concat("text", F.lit("\nThe answer is ("), letter, F.lit(")."))
    return documents(spark, sf_dir).select("doc_id", A.probe_choice(answered).alias("choice"))


@query("text_parse_choice_documents")
def text_parse_choice_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("lang", A.parse_choice("text", ["A", "B", "C", "D", "E"]).alias("p"))
    return rows.groupBy("lang", "p.normalized", "p.status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_parse_code",
    rf"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'x = ' || conv_id ELSE nullif(regexp_replace(coalesce(text, ''), '[{WS}]+$', ''), '') END AS completion FROM conversations""",
)
def text_parse_code(spark, sf_dir):
    """Whole texts, every other one with two fenced blocks behind it."""
    text = F.coalesce("text", F.lit(""))
    fenced = F.concat(text, F.lit("\nfirst ```python\ny = 1\n``` then ```\nx = "), F.col("conv_id").cast("string"), F.lit("\n\n``` end"))
    response = F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.concat(text, F.lit("  \n")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", A.parse_code(response).alias("p"))
    return rows.select("conv_id", "turn", F.col("p.normalized").alias("completion"))


@query(
    "text_probe_choice",
    """SELECT event_id, CASE event_type WHEN 'click' THEN chr((65 + user_id % 5)::INTEGER) WHEN 'view' THEN CASE WHEN user_id % 5 < 4 THEN chr((65 + user_id % 5)::INTEGER) END END AS choice FROM events""",
)
def text_probe_choice(spark, sf_dir):
    letter = F.char(F.col("user_id") % 5 + 65)
    response = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(" ("), F.lower(letter), F.lit(").")))
        .when(F.col("event_type") == "view", F.concat(F.lit("You are a test. The final answer is ["), letter, F.lit("] ok")))
        .otherwise(F.lit("You are a test of B"))
    )
    allowed = F.when(F.col("event_type") == "click", A.probe_choice(response)).otherwise(A.probe_choice(response, "ABCD"))
    return table(spark, sf_dir, "events").select("event_id", allowed.alias("choice"))


@query(
    "text_rouge_tokens",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*|[^{WS}]') AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS tokens, lower(t[1]) AS first_token, lower(t[-1]) AS last_token FROM t""",
)
def text_rouge_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.rouge_tokens("text").alias("t"))
    return rows.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token")
    )


@query(
    "text_quality_tokens",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{2fa1f}}]|[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*|[^{WS}]'))::BIGINT AS tokens FROM documents""",
)
def text_quality_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.quality_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("tokens"))


@query(
    "text_sentences",
    rf"""WITH p AS (SELECT doc_id, [x FOR x IN [regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g') FOR s IN string_split(regexp_replace(regexp_replace(text, '([.!?])[{WS}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))] IF x <> ''] AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS sentences, s[1] AS first_sentence, s[-1] AS last_sentence FROM p""",
)
def text_sentences(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.sentences("text").alias("s"))
    return rows.select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"), F.try_element_at("s", F.lit(-1)).alias("last_sentence")
    )


@query(
    "text_sentence_chunks",
    rf"""WITH p AS (SELECT doc_id, [regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g') FOR s IN string_split(regexp_replace(text, '([.!?])[{WS}]+', '\1' || chr(1), 'g'), chr(1))] AS s FROM documents),
c AS (SELECT doc_id, [x FOR x IN s IF len([w FOR w IN string_split_regex(x, '[{WS}]+') IF w <> '']) >= 6][1:4] AS c FROM p)
SELECT doc_id, len(c)::BIGINT AS chunks, array_to_string(c, '|') AS joined FROM c""",
)
def text_sentence_chunks(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.sentence_chunks("text").alias("c"))
    return rows.select("doc_id", F.size("c").cast("bigint").alias("chunks"), F.array_join("c", "|").alias("joined"))


@query("text_phrases")
def text_phrases(spark, sf_dir):
    rows = documents(spark, sf_dir).select("lang", F.size(S.phrases("text")).alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("phrases"), F.max("n").alias("most"))


@query(
    "text_template_queries",
    """SELECT source, lang, t.id AS template_id, replace(t.t, '{entity}', source || ' in ' || lang) AS query FROM (SELECT DISTINCT source, lang FROM documents),
(VALUES ('DEF', 'What is {entity}? Give a precise definition and explain why it is important.'), ('CAT', 'What category does {entity} belong to, and what are closely related concepts?'),
 ('FUN', 'What is the function or role of {entity} in its domain?'), ('PART', 'What are the main components, subtypes, or parts of {entity}?')) AS t(id, t)""",
)
def text_template_queries(spark, sf_dir):
    entities = documents(spark, sf_dir).select("source", "lang").distinct()
    named = entities.withColumn("entity", F.concat_ws(" in ", "source", "lang"))
    return S.expand_templates(named, "entity").select("source", "lang", "template_id", "query")


@query("text_rendered_prompts", "SELECT doc_id, 'Answer in JSON {\"answer\"}: ' || text || ' [' || lang || ']' AS prompt FROM documents")
def text_rendered_prompts(spark, sf_dir):
    prompt = S.render('Answer in JSON {"answer"}: {prompt} [{lang}]', prompt="text", lang="lang")
    return documents(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


@query(
    "text_clean_task_text",
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace('  ' || coalesce(text, '') || '  [title] ' || lang || chr(10), '\s*\[title\]\s*', '. ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')) AS context FROM documents""",
)
def text_clean_task_text(spark, sf_dir):
    """Whole texts with a title marker behind them."""
    marked = F.concat(F.lit("  "), F.coalesce("text", F.lit("")), F.lit("  [title] "), F.col("lang"), F.lit("\n"))
    return documents(spark, sf_dir).select("doc_id", F.md5(S.clean_task_text(marked)).alias("context"))


@query(
    "text_gold_after_marker",
    rf"""WITH s AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '#### ' || doc_id || ' ' || chr(10) || 'rest' END AS x FROM documents)
SELECT doc_id, md5(regexp_replace(CASE WHEN regexp_extract(x, '####\s*([^\n]+)', 1) <> '' THEN regexp_extract(x, '####\s*([^\n]+)', 1) ELSE x END, '^[{WS}]+|[{WS}]+$', '', 'g')) AS gold FROM s""",
)
def text_gold_after_marker(spark, sf_dir):
    """Whole texts as solutions, two of three with a marked answer behind them."""
    answer = F.concat(F.lit("\n#### "), F.col("doc_id").cast("string"), F.lit(" \nrest"))
    solution = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(answer))
    return documents(spark, sf_dir).select("doc_id", F.md5(A.gold_after_marker(solution)).alias("gold"))


@query("text_clipped", "SELECT event_id, round(least(greatest(value / 50, 0.5), 1.5), 6) AS ratio, round(least(greatest(ln(value / 50), ln(0.8)), ln(1.2)), 6) AS log_ratio FROM events")
def text_clipped(spark, sf_dir):
    import math

    value = F.col("value") / 50
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(clip(value, 0.5, 1.5), 6).alias("ratio"),
        F.round(clip(F.ln(value), math.log(0.8), math.log(1.2)), 6).alias("log_ratio"),
    )


@query(
    "text_ws_tokens",
    rf"""SELECT doc_id, len([w FOR w IN string_split_regex(replace(lower(text), 'ß', 'ss'), '[{WS}]+') IF w <> ''])::BIGINT AS tokens FROM documents""",
)
def text_ws_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.ws_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("tokens"))
