"""Watermark tests over word tokens of the documents and over event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.text import split_words
from traceaudit.operators import watermark as W
from traceaudit.plans.registry import Catalog, table
from traceaudit.plans.text import WS

CATALOG = Catalog()
query = CATALOG.query

GAMMA = 0.25
WORDS = rf"w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[{WS}]+') IF x <> ''] AS t FROM documents)"
SCORED = f"""{WORDS},
s AS (SELECT doc_id, i, t[i - 1] AS context, t[i] AS token FROM (SELECT doc_id, t, unnest(range(3, len(t) + 1)) AS i FROM w))"""
GREEN = "('0x' || substr(md5('key|' || context || '|' || token), 1, 8))::BIGINT < 0.25 * 4294967296"


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", split_words("text").alias("tokens"), F.octet_length("text").alias("size"))


def counted(found):
    return found.select(
        "scored_tokens", "green_score", "num_samples", "total_tokens", F.round("green_rate", 9).alias("green_rate"), F.round("z_score", 6).alias("z_score")
    )


def green_sql(source: str) -> str:
    return f"""WITH {SCORED}, u AS ({source}), c AS (SELECT count(*) AS n, count(*) FILTER ({GREEN}) AS g FROM u)
SELECT n::BIGINT AS scored_tokens, g::BIGINT AS green_score, (SELECT count(*) FROM w)::BIGINT AS num_samples, (SELECT sum(len(t)) FROM w)::BIGINT AS total_tokens,
round(g::DOUBLE / greatest(n, 1), 9) AS green_rate, round((g - 0.25 * n) / sqrt(n * 0.25 * 0.75), 6) AS z_score FROM c"""


@query("watermark_green_test", green_sql("SELECT context, token FROM s"))
def watermark_green_test(spark, sf_dir):
    return counted(W.green_test(words(spark, sf_dir), "doc_id", "tokens", 1, GAMMA, key="key"))


@query("watermark_green_first_context", green_sql("SELECT context, arg_min(token, (doc_id, i)) AS token FROM s GROUP BY 1"))
def watermark_green_first_context(spark, sf_dir):
    return counted(W.green_test(words(spark, sf_dir), "doc_id", "tokens", 1, GAMMA, key="key", mode="v1"))


@query("watermark_green_unique_pairs", green_sql("SELECT DISTINCT context, token FROM s"))
def watermark_green_unique_pairs(spark, sf_dir):
    return counted(W.green_test(words(spark, sf_dir), "doc_id", "tokens", 1, GAMMA, key="key", mode="v2", size="size"))


# Known contexts and green pairs taken from the benchmark texts.
@query(
    "watermark_green_membership",
    rf"""WITH {SCORED}, b AS (SELECT [x FOR x IN string_split_regex(text, '[{WS}]+') IF x <> ''] AS t FROM benchmark), m AS (SELECT DISTINCT t[i - 1] AS context, t[i] AS token FROM (SELECT t, unnest(range(3, len(t) + 1)) AS i FROM b)),
u AS (SELECT s.context, s.token, m.token IS NOT NULL AS green FROM s LEFT JOIN m ON s.context = m.context AND s.token = m.token WHERE s.context IN (SELECT context FROM m))
SELECT count(*)::BIGINT AS scored_tokens, count(*) FILTER (green)::BIGINT AS green_score FROM u""",
)
def watermark_green_membership(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select("item_id", split_words("text").alias("tokens"))
    pairs = W.scored_positions(known, "item_id", "tokens", 1).select("context", "token")
    found = W.green_test(words(spark, sf_dir), "doc_id", "tokens", 1, GAMMA, membership=pairs, contexts=pairs)
    return found.select("scored_tokens", "green_score")


def normal_cdf_sql(x: str) -> str:
    """Normal distribution function by Simpson's rule between 0 and the value."""
    weight = "CASE WHEN j = 0 OR j = 600 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + ({x}) / 1800.0 / sqrt(2 * pi()) * list_sum([({weight}) * exp(-0.5 * (j * ({x}) / 600.0) * (j * ({x}) / 600.0)) FOR j IN range(0, 601)]))"


# Contexts of two words, each (context, token) pair once; the binomial tail is a sum of its terms.
@query(
    "watermark_p_values",
    f"""WITH {WORDS}, s AS (SELECT doc_id, i, t[i - 2] || ' ' || t[i - 1] AS context, t[i] AS token FROM (SELECT doc_id, t, unnest(range(4, len(t) + 1)) AS i FROM w)),
u AS (SELECT DISTINCT context, token FROM s), c AS (SELECT count(*) AS n, count(*) FILTER ({GREEN}) AS g FROM u), z AS (SELECT n, g, (g - 0.25 * n) / sqrt(n * 0.25 * 0.75) AS z FROM c)
SELECT round(1 - {normal_cdf_sql('z')}, 7) AS p_value_z, round(z, 6) AS z_score,
round(list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.25) + (n - j) * ln(0.75)) FOR j IN range(g, n + 1)]), 6) AS p_value_binomial FROM z""",
)
def watermark_p_values(spark, sf_dir):
    found = W.green_test(words(spark, sf_dir), "doc_id", "tokens", 2, GAMMA, key="key", mode="v2", size="size")
    places = {"p_value_z": 7, "p_value_binomial": 6, "z_score": 6}
    return found.select(*[F.round(c, p).alias(c) for c, p in places.items()])


@query(
    "watermark_mask_test",
    f"""WITH {WORDS}, x AS (SELECT unnest(t) AS token FROM w), m AS (SELECT token, (('0x' || substr(md5('m' || token), 1, 8))::BIGINT < 2147483648) AS green FROM (SELECT DISTINCT token FROM x) WHERE length(token) <= 12),
c AS (SELECT count(*) AS n, count(*) FILTER (green) AS g FROM x JOIN m USING (token))
SELECT n::BIGINT AS num_tokens, g::BIGINT AS green_hits, round(g::DOUBLE / n, 9) AS green_rate, round((g::DOUBLE / n - 0.5) / sqrt(0.25 / n), 6) AS z_score FROM c""",
)
def watermark_mask_test(spark, sf_dir):
    docs = words(spark, sf_dir)
    vocabulary = docs.select(F.explode("tokens").alias("token")).distinct().filter(F.char_length("token") <= 12)
    green = W.hash_point(F.md5(F.concat(F.lit("m"), F.col("token")))) < 2147483648
    found = W.mask_test(docs, "tokens", vocabulary.withColumn("green", green), 0.5)
    return found.withColumns({"green_rate": F.round("green_rate", 9), "z_score": F.round("z_score", 6)})


@query(
    "watermark_ngram_counts",
    f"""WITH {WORDS}, g AS (SELECT t[i] || ' ' || t[i + 1] AS ngram FROM (SELECT t, unnest(range(1, len(t))) AS i FROM w)) SELECT n AS occurrences, count(*)::BIGINT AS ngrams FROM (SELECT count(*) AS n FROM g GROUP BY ngram) GROUP BY 1""",
)
def watermark_ngram_counts(spark, sf_dir):
    counts = W.ngram_counts(words(spark, sf_dir), "tokens", 2)
    return counts.groupBy(F.col("n").alias("occurrences")).agg(F.count(F.lit(1)).alias("ngrams"))


@query(
    "watermark_top_ngrams",
    f"""WITH {WORDS}, g AS (SELECT t[i] || ' ' || t[i + 1] AS ngram FROM (SELECT t, unnest(range(1, len(t))) AS i FROM w)) SELECT ngram, count(*)::BIGINT AS n FROM g GROUP BY 1 ORDER BY n DESC, ngram LIMIT 25""",
)
def watermark_top_ngrams(spark, sf_dir):
    return W.top_ngrams(words(spark, sf_dir), "tokens", 2, 25)


GRID = ", ".join(f"{w!r}" for w in [16.0, *W.noise_grid(16.0)])


@query(
    "watermark_periodic_snr",
    f"""WITH p AS (SELECT value / 500 AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS q FROM events), y AS (SELECT t, q - (SELECT avg(q) FROM p) AS y FROM p),
f AS (SELECT unnest([{GRID}])::DOUBLE AS w),
s AS (SELECT w, count(*) AS n, sum(y * y) AS yy, sum(sin(2 * w * t)) AS s2, sum(cos(2 * w * t)) AS c2, sum(y * cos(w * t)) AS yc, sum(y * sin(w * t)) AS ys FROM y, f GROUP BY 1),
a AS (SELECT *, atan2(s2, c2) / 2 AS ph FROM s), b AS (SELECT *, 0.5 * (n + c2 * cos(2 * ph) + s2 * sin(2 * ph)) AS cc FROM a),
d AS (SELECT w, n, 0.5 * (power(yc * cos(ph) + ys * sin(ph), 2) / cc + power(ys * cos(ph) - yc * sin(ph), 2) / (n - cc)) * 2 / yy AS pw FROM b)
SELECT max(n)::BIGINT AS num_pairs, round(max(pw) FILTER (w = 16.0) / (avg(pw) FILTER (w <> 16.0) + 1e-12), 6) AS snr FROM d""",
)
def watermark_periodic_snr(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        (F.col("value") / 500).alias("t"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("q")
    )
    return W.periodic_snr(rows, "t", "q", 16.0).withColumn("snr", F.round("snr", 6))


@query(
    "watermark_context_mass",
    """WITH f AS (SELECT user_id, event_type, arg_min(value / 500, event_id) AS m FROM events GROUP BY 1, 2), a AS (SELECT avg(m) AS g, count(*) AS n FROM f), e AS (SELECT *, greatest(g - 0.03, 0.0) AS x FROM a)
SELECT round(g, 9) AS gtp, n::BIGINT AS num_contexts, round(-2.0 * n * x * x, 6) AS log_p_value, round(2.0 * n * x * x / ln(10.0), 6) AS neg_log10_p FROM e""",
)
def watermark_context_mass(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") / 500).alias("mass"))
    found = W.context_mass(rows, ["user_id", "event_type"], ["event_id"], "mass", 0.03)
    return found.select(
        F.round("gtp", 9).alias("gtp"), "num_contexts", F.round("log_p_value", 6).alias("log_p_value"), F.round("neg_log10_p", 6).alias("neg_log10_p")
    )


PHASE_KEY = [((i * 37) % 19 - 9) / 9.0 for i in range(64)]


@query(
    "watermark_phase_table",
    f"""WITH p AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], {PHASE_KEY}::DOUBLE[]) / sqrt(64 / 3.0) AS x FROM embeddings)
SELECT vec_id, round({normal_cdf_sql('x')}, 7) AS phase FROM p""",
)
def watermark_phase_table(spark, sf_dir):
    found = W.phase_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PHASE_KEY)
    return found.withColumn("phase", F.round("phase", 7))
