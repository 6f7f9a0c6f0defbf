"""Traffic detectors over the embeddings table: labels 0-6 are benign, 7-9 observed."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.operators import history as H
from traceaudit.operators import traffic as T
from traceaudit.operators.corpus import split_by_ratio
from traceaudit.plans.corpus import digest_sql, draw_sql
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

SIZE = T.BATCH_SIZE
SEED = 20260701


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def benign(spark, sf_dir):
    return embeddings(spark, sf_dir).filter("label < 7")


def observed(spark, sf_dir):
    return embeddings(spark, sf_dir).filter("label >= 7")


CUT = """
cut AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (row_number() OVER (ORDER BY vec_id) - 1) // {size} AS w, (row_number() OVER (ORDER BY vec_id) - 1) % {size} AS slot FROM embeddings {where})"""


PREV_DISTANCE = """SELECT a.vec_id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS min_distance
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id < a.vec_id {on} GROUP BY 1"""


def _prev_distance(spark, sf_dir, **options):
    found = H.nearest_earlier_distance(embeddings(spark, sf_dir), ["vec_id"], **options)
    return found.select("vec_id", F.round("min_distance", 6).alias("min_distance"))


@query("traffic_min_prev_distance", PREV_DISTANCE.format(on=""))
def traffic_min_prev_distance(spark, sf_dir):
    return _prev_distance(spark, sf_dir)


@query("traffic_prev_distance_in_rings", PREV_DISTANCE.format(on=""))
def traffic_prev_distance_in_rings(spark, sf_dir):
    """The same with blocks so small that short histories go through cells and rings too."""
    return _prev_distance(spark, sf_dir, pivots=8, rings=4, block_rows=64)


@query("traffic_account_prev_distance", PREV_DISTANCE.format(on="AND a.label = b.label"))
def traffic_account_prev_distance(spark, sf_dir):
    return _prev_distance(spark, sf_dir, by=["label"], block_rows=32)


@query(
    "traffic_account_prev_cosine",
    """SELECT a.vec_id, round(min(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS min_distance
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id < a.vec_id AND a.label = b.label GROUP BY 1""",
)
def traffic_account_prev_cosine(spark, sf_dir):
    return _prev_distance(spark, sf_dir, by=["label"], metric="cosine")


SIMILAR = """
full_windows AS (SELECT w FROM cut GROUP BY 1 HAVING count(*) = {size}),
pairs AS (SELECT a.w, list_cosine_similarity(a.e, b.e) AS s FROM cut a JOIN cut b ON a.w = b.w AND a.slot < b.slot WHERE a.w IN (SELECT w FROM full_windows))"""


@query(
    "traffic_similar_pair_share",
    f"""WITH {CUT.format(size=SIZE, where='')}, {SIMILAR.format(size=SIZE)} SELECT w::BIGINT AS "window", {SIZE}::BIGINT AS queries,
round(count(*) FILTER (s >= 0.3)::DOUBLE / count(*), 9) AS score FROM pairs GROUP BY 1""",
)
def traffic_similar_pair_share(spark, sf_dir):
    cut = T.windows(embeddings(spark, sf_dir), "vec_id", SIZE)
    return T.seat(cut, 0.3).withColumn("score", F.round("score", 9))


@query(
    "traffic_similar_pair_count",
    f"""WITH {CUT.format(size=SIZE, where='')}, {SIMILAR.format(size=SIZE)} SELECT w::BIGINT AS "window", {SIZE}::BIGINT AS queries,
count(*) FILTER (s >= 0.3)::DOUBLE AS score FROM pairs GROUP BY 1""",
)
def traffic_similar_pair_count(spark, sf_dir):
    return T.seat(T.windows(embeddings(spark, sf_dir), "vec_id", SIZE), 0.3, mode="count")


@query(
    "traffic_null_decision",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label >= 7 THEN 'observed' WHEN {draw_sql('vec_id', SEED)} < 0.8 THEN 'train' ELSE 'benign' END AS role FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM e),
cut AS (SELECT role, i // {SIZE} AS w, i % {SIZE} AS slot, e FROM p WHERE role <> 'train' OR i // {SIZE} < n // {SIZE}),
s AS (SELECT a.role, a.w, count(*) FILTER (list_cosine_similarity(a.e, b.e) >= 0.3)::DOUBLE / count(*) AS score FROM cut a JOIN cut b ON a.role = b.role AND a.w = b.w AND a.slot < b.slot GROUP BY 1, 2),
al AS (SELECT DISTINCT role, w FROM cut), sc AS (SELECT role, coalesce(score, 0.0) AS score FROM al LEFT JOIN s USING (role, w)),
t AS (SELECT quantile_cont(score, 0.95) AS t FROM sc WHERE role = 'train')
SELECT role, round(t, 9) AS threshold, count(*)::BIGINT AS windows, count(*) FILTER (score > t)::BIGINT AS detected_windows, round(count(*) FILTER (score > t)::DOUBLE / count(*), 9) AS detection_rate
FROM sc, t WHERE role <> 'train' GROUP BY role, t""",
)
def traffic_null_decision(spark, sf_dir):
    """The bound comes from all count windows of the training part; the rest of the benign log and the observed log are rated."""
    train, held_out = T.held_out_split(benign(spark, sf_dir), "vec_id", SEED)
    null = T.seat(T.windows(train, "vec_id", SIZE), 0.3)
    threshold = T.exact_percentile(null, "score", T.THRESHOLD_PERCENTILE)
    rated = None
    for role, rows in (("benign", held_out), ("observed", observed(spark, sf_dir))):
        part = T.seat(T.windows(rows, "vec_id", SIZE, keep_last=True), 0.3).withColumn("role", F.lit(role))
        rated = part if rated is None else rated.unionByName(part)
    rate = T.detection_rate(T.flag_windows(rated, threshold), "role")
    return rate.withColumn("detection_rate", F.round("detection_rate", 9)).withColumn("threshold", F.round(F.lit(threshold), 9))


def _report(spark, sf_dir, score, tail):
    """Null windows of the training part of the benign log, rates on its held-out part and on the observed log."""
    train, held_out = T.held_out_split(benign(spark, sf_dir), "vec_id", SEED)
    bounds = T.null_bounds(score(T.null_windows(train, "vec_id", T.NULL_SAMPLES, T.BATCH_SIZE, SEED)), tail=tail)
    scored = None
    for role, rows in (("benign", held_out), ("observed", observed(spark, sf_dir))):
        cut = T.windows(rows, "vec_id", T.BATCH_SIZE, keep_last=True)
        part = score(cut).withColumn("role", F.lit(role))
        scored = part if scored is None else scored.unionByName(part)
    low, high = (F.lit(b).cast("double") for b in bounds)
    return T.detection_rate(T.flag_outside(scored, bounds), "role").withColumns({"low": low, "high": high})


# Draws are digests, so SQL repeats them.
def _draws_sql(name, samples, size, seed):
    """Positions that ``null_windows`` draws: ``name``(window, slot, e)."""
    base = digest_sql("id", seed + 1)
    return f"""{name} AS (SELECT id // {size} AS w, id % {size} AS slot, e FROM
(SELECT i AS id, (('0x' || substr({base.replace('id', 'i')}, 1, 15))::BIGINT % n) + 1 AS pos FROM range({samples * size}) AS r(i), n) JOIN
(SELECT e, row_number() OVER (ORDER BY {digest_sql('vec_id', seed)}, vec_id) AS p FROM b) ON p = pos)"""


# Distances of distinct rows are taken once; drawn windows hold ids.
_POINTS_SQL = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
b AS (SELECT vec_id, vec_id AS e FROM e WHERE label < 7 AND {draw_sql('vec_id', SEED)} < 0.8), n AS (SELECT count(*) AS n FROM b),
{_draws_sql('nl', T.NULL_SAMPLES, T.BATCH_SIZE, SEED)},
ev AS (SELECT role, (p - 1) // {T.BATCH_SIZE} AS w, (p - 1) % {T.BATCH_SIZE} AS slot, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY vec_id) AS p FROM
(SELECT vec_id, CASE WHEN label < 7 THEN 'benign' ELSE 'observed' END AS role FROM e WHERE label >= 7 OR {draw_sql('vec_id', SEED)} >= 0.8))),
win AS (SELECT 'null' AS role, w, slot, e AS vec_id FROM nl UNION ALL SELECT * FROM ev),
gap AS MATERIALIZED (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.e, y.e) AS d FROM e x, e y)"""
_REPORT_SQL = """bd AS (SELECT quantile_cont(score, 0.95) AS high FROM sc WHERE role = 'null')
SELECT role, count(*)::BIGINT AS windows, count(*) FILTER (score > high)::BIGINT AS detected_windows, round(count(*) FILTER (score > high)::DOUBLE / count(*), 9) AS detection_rate,
NULL::DOUBLE AS low, round(high, 7) AS high FROM sc, bd WHERE role <> 'null' GROUP BY role, high"""


def _rounded_report(found):
    return found.withColumns({c: F.round(c, d) for c, d in (("detection_rate", 9), ("low", 7), ("high", 7))})


@query(
    "traffic_kernel_test",
    f"""{_POINTS_SQL}, {_draws_sql('rf', T.REFERENCE_REPEATS, T.BATCH_SIZE, SEED + 5)},
bw AS (SELECT median(d) AS s FROM rf x JOIN rf y ON x.w = 0 AND y.w = 0 AND x.slot < y.slot JOIN gap ON i = x.e AND j = y.e WHERE d > 0),
k AS MATERIALIZED (SELECT i, j, exp(-d * d / (2 * s * s)) AS k FROM gap, bw),
cross_ AS (SELECT i, sum(k * c) / (SELECT count(*) FROM rf) AS m FROM k JOIN (SELECT e, count(*) AS c FROM rf GROUP BY 1) ON j = e GROUP BY 1),
inside_r AS (SELECT avg(v) AS v FROM (SELECT x.w, sum(k) / ({T.BATCH_SIZE} * {T.BATCH_SIZE - 1}) AS v FROM rf x JOIN rf y ON x.w = y.w AND x.slot <> y.slot JOIN k ON i = x.e AND j = y.e GROUP BY 1)),
inside_w AS (SELECT x.role, x.w, avg(k) AS v FROM win x JOIN win y ON x.role = y.role AND x.w = y.w AND x.slot <> y.slot JOIN k ON i = x.vec_id AND j = y.vec_id GROUP BY 1, 2),
cw AS (SELECT role, w, avg(m) AS m FROM win JOIN cross_ ON i = vec_id GROUP BY 1, 2),
sc AS (SELECT cw.role, inside_w.v + inside_r.v - 2 * m AS score FROM cw LEFT JOIN inside_w USING (role, w), inside_r), {_REPORT_SQL}""",
)
def traffic_kernel_test(spark, sf_dir):
    train, _ = T.held_out_split(benign(spark, sf_dir), "vec_id", SEED)
    reference = T.kernel_reference(train, "vec_id", SEED + 5)
    return _rounded_report(_report(spark, sf_dir, lambda cut: T.mmd(cut, reference), "upper"))


# One entry per number of distances that a window can have, by the published rule.
_WEIGHTS_SQL = ", ".join(f"({n}, {T.shapiro_weights(n).tolist()})" for n in range(3, T.BATCH_SIZE))


@query(
    "traffic_distance_normality",
    f"""{_POINTS_SQL}, weight(n, a) AS (VALUES {_WEIGHTS_SQL}),
near AS (SELECT x.role, x.w, x.slot, min(d) AS d FROM win x JOIN win y ON x.role = y.role AND x.w = y.w AND y.slot < x.slot JOIN gap ON i = x.vec_id AND j = y.vec_id GROUP BY 1, 2, 3),
lists AS (SELECT role, w, list(d ORDER BY d) AS x, var_pop(d) * count(*) AS total FROM near GROUP BY 1, 2),
sc AS (SELECT role, w, CASE WHEN total > 0 AND a IS NOT NULL THEN least(1.0, pow(list_dot_product(a::DOUBLE[], x), 2) / total) ELSE 1.0 END AS score
  FROM (SELECT DISTINCT role, w FROM win) LEFT JOIN lists USING (role, w) LEFT JOIN weight ON n = len(x)), {_REPORT_SQL}""",
)
def traffic_distance_normality(spark, sf_dir):
    return _rounded_report(_report(spark, sf_dir, T.prada, "upper"))


def _pairs_sql(source):
    return f"""SELECT a.role, a.w, count(*) FILTER (list_cosine_similarity(a.e, b.e) >= t)::DOUBLE / count(*) AS score
FROM {source} a JOIN {source} b ON a.role = b.role AND a.w = b.w AND a.slot < b.slot, th GROUP BY 1, 2"""


@query(
    "traffic_pair_similarity",
    f"""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 7 AND {draw_sql('vec_id', SEED)} < 0.8),
n AS (SELECT count(*) AS n FROM b), {_draws_sql('pr', T.PAIR_SAMPLE_SIZE, 2, SEED + 9)}, {_draws_sql('nl', T.NULL_SAMPLES, T.BATCH_SIZE, SEED)},
th AS (SELECT quantile_cont(list_cosine_similarity(x.e, y.e), 0.99) - 1e-9 AS t FROM pr x JOIN pr y ON x.w = y.w AND x.slot = 0 AND y.slot = 1),
nr AS (SELECT 'null' AS role, * FROM nl), ns AS ({_pairs_sql('nr')}),
bd AS (SELECT quantile_cont(score, 0.025) AS low, quantile_cont(score, 0.975) AS high FROM ns),
ev AS (SELECT role, (p - 1) // 100 AS w, (p - 1) % 100 AS slot, e FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY vec_id) AS p FROM
(SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label < 7 THEN 'benign' ELSE 'observed' END AS role FROM embeddings WHERE label >= 7 OR {draw_sql('vec_id', SEED)} >= 0.8))),
sc AS ({_pairs_sql('ev')}), al AS (SELECT DISTINCT role, w FROM ev), fl AS (SELECT al.role, coalesce(score, 0.0) AS score FROM al LEFT JOIN sc USING (role, w))
SELECT role, count(*)::BIGINT AS windows, count(*) FILTER (score < low OR score > high)::BIGINT AS detected_windows,
round(count(*) FILTER (score < low OR score > high)::DOUBLE / count(*), 9) AS detection_rate, round(low, 6) AS low, round(high, 6) AS high FROM fl, bd GROUP BY role, low, high""",
)
def traffic_pair_similarity(spark, sf_dir):
    train, _ = T.held_out_split(benign(spark, sf_dir), "vec_id", SEED)
    # The percentile is the similarity of some pair: a hair below it, rounding can't turn that pair around.
    threshold = T.pair_threshold(train, "vec_id", SEED + 9) - 1e-9
    found = _report(spark, sf_dir, lambda cut: T.seat(cut, threshold), "two-sided")
    return found.withColumns({c: F.round(c, d) for c, d in (("detection_rate", 9), ("low", 6), ("high", 6))})


@query(
    "traffic_mixed_windows",
    f"""WITH o AS (SELECT vec_id, label >= 7 AS obs, row_number() OVER (PARTITION BY label >= 7 ORDER BY {digest_sql('vec_id', 5)}, vec_id) AS p FROM embeddings),
n AS (SELECT count(*) FILTER (obs) AS no, count(*) FILTER (NOT obs) AS nb FROM o), r AS (SELECT ratio, take, no // take AS k, least(no // take, nb // ({SIZE} - take)) AS windows FROM (VALUES (0.1, {SIZE // 10}), (0.5, {SIZE // 2})) AS v(ratio, take), n)
SELECT ratio::DOUBLE AS ratio, ((p - 1) // CASE WHEN obs THEN take ELSE {SIZE} - take END)::BIGINT AS "window", vec_id, CASE WHEN obs THEN 'observed' ELSE 'benign' END AS role
FROM o, r WHERE (p - 1) // CASE WHEN obs THEN take ELSE {SIZE} - take END < windows""",
)
def traffic_mixed_windows(spark, sf_dir):
    return T.mixed_batches(benign(spark, sf_dir), observed(spark, sf_dir), "vec_id", [0.1, 0.5], SIZE, 5)


@query(
    "traffic_benign_split",
    f"SELECT vec_id, CASE WHEN {draw_sql('vec_id', 77)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM embeddings WHERE label < 7",
)
def traffic_benign_split(spark, sf_dir):
    return split_by_ratio(benign(spark, sf_dir).select("vec_id"), "vec_id", T.NORMAL_TRAIN_RATIO, 77)


@query(
    "traffic_headline",
    """WITH e AS (SELECT event_type, avg((value > 50)::INT) FILTER (user_id < 75) AS a, avg((value > 30)::INT) FILTER (value > 20) AS t FROM events GROUP BY 1)
SELECT event_type, round(coalesce(CASE WHEN event_type <> 'click' THEN a END, CASE WHEN event_type <> 'view' THEN t END), 9) AS score FROM e""",
)
def traffic_headline(spark, sf_dir):
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg(F.when(F.col("user_id") < 75, (F.col("value") > 50).cast("int"))).alias("a"),
        F.avg(F.when(F.col("value") > 20, (F.col("value") > 30).cast("int"))).alias("t"),
    )
    summary = rates.select(
        "event_type",
        F.when(F.col("event_type") != "click", F.col("a")).alias("attacker_detection_rate"),
        F.when(F.col("event_type") != "view", F.col("t")).alias("tpr"),
    )
    return T.traffic_headline(summary).select("event_type", F.round("score", 9).alias("score"))
