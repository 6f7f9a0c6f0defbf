"""Itemised costs over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.stats import mul_known, seconds_to_hours
from traceaudit.operators import cost as K
from traceaudit.plans.registry import Catalog, table

CATALOG = Catalog()
query = CATALOG.query

# A line is a stage cost: the return flag picks the billing mode, some prices
# are unknown.
ITEMS = """
items AS (SELECT l_orderkey || '/' || l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'per_query' WHEN 'N' THEN 'tokens' ELSE 'unknown' END AS api_billing,
  l_quantity AS query_count, CASE WHEN l_returnflag = 'A' THEN l_discount END AS price_per_query, l_partkey AS input_tokens, l_suppkey AS output_tokens,
  CASE WHEN l_returnflag = 'N' THEN l_tax END AS pin, CASE WHEN l_returnflag = 'N' THEN l_discount END AS pout,
  CASE WHEN l_linestatus = 'O' THEN l_quantity / 10 END AS gpu_hours, CASE WHEN l_linestatus = 'O' THEN 2.5 END AS gpu_price, l_extendedprice AS data_cost FROM lineitem)"""


def items(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return line.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"),
        F.lit("attack").alias("stage"),
        F.lit("USD").alias("currency"),
        F.lit("2026-07-01").alias("price_as_of"),
        F.when(flag == "A", "per_query").when(flag == "N", "tokens").otherwise("unknown").alias("api_billing"),
        F.col("l_quantity").alias("query_count"),
        F.when(flag == "A", F.col("l_discount")).alias("price_per_query"),
        F.col("l_partkey").alias("input_tokens"),
        F.col("l_suppkey").alias("output_tokens"),
        F.when(flag == "N", F.col("l_tax")).alias("input_price_per_million_tokens"),
        F.when(flag == "N", F.col("l_discount")).alias("output_price_per_million_tokens"),
        F.when(status == "O", F.col("l_quantity") / 10).alias("gpu_hours"),
        F.when(status == "O", F.lit(2.5)).alias("gpu_price_per_hour"),
        F.col("l_extendedprice").alias("data_cost"),
        F.lit(None).cast("double").alias("human_cost"),
        F.lit(0.0).alias("other_cost"),
        F.lit(None).cast("double").alias("wall_clock_hours"),
        F.lit(None).cast("bigint").alias("sample_count"),
        F.lit(None).cast("bigint").alias("budget_cap"),
    )


@query(
    "cost_records",
    f"""WITH {ITEMS}, c AS (SELECT *, CASE api_billing WHEN 'per_query' THEN query_count * price_per_query WHEN 'tokens' THEN input_tokens * pin / 1e6 + output_tokens * pout / 1e6 END AS api_cost, gpu_hours * gpu_price AS gpu_cost FROM items)
SELECT id, round(api_cost, 10) AS api_cost, round(gpu_cost, 6) AS gpu_cost, round(coalesce(api_cost, 0) + coalesce(gpu_cost, 0) + coalesce(data_cost, 0), 8) AS known_subtotal, false AS complete,
 concat_ws(',', CASE WHEN api_cost IS NULL THEN 'api_cost' END, CASE WHEN gpu_cost IS NULL THEN 'gpu_cost' END, 'human_cost') AS unknown_components,
 concat_ws(',', 'queries', 'tokens', CASE WHEN gpu_hours IS NOT NULL THEN 'gpu_hours' END, 'money') AS dimensions FROM c""",
)
def cost_records(spark, sf_dir):
    found = K.cost_records(items(spark, sf_dir))
    return found.select(
        "id", F.round("api_cost", 10).alias("api_cost"), F.round("gpu_cost", 6).alias("gpu_cost"),
        F.round("known_subtotal", 8).alias("known_subtotal"), "complete",
        F.array_join("unknown_components", ",").alias("unknown_components"),
        F.array_join("reported_cost_dimensions", ",").alias("dimensions"),
    )


@query(
    "cost_rules",
    f"""WITH {ITEMS} SELECT rule, count(*)::BIGINT AS broken FROM (SELECT 'per_query_with_token_prices' AS rule FROM items WHERE api_billing = 'per_query' AND output_tokens % 2 = 0
UNION ALL SELECT 'bad_data_cost' FROM items WHERE data_cost < 2000 UNION ALL SELECT 'duplicate_id' FROM (SELECT id FROM items GROUP BY id HAVING count(*) > 1)) GROUP BY 1""",
)
def cost_rules(spark, sf_dir):
    mixed = (F.col("api_billing") == "per_query") & (F.col("output_tokens") % 2 == 0)
    rows = items(spark, sf_dir).withColumns(
        {
            "input_price_per_million_tokens": F.when(mixed, 1.0).otherwise(F.col("input_price_per_million_tokens")),
            "data_cost": F.when(F.col("data_cost") < 2000, -1.0).otherwise(F.col("data_cost")),
        }
    )
    return K.cost_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))


@query(
    "cost_merged",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, CASE WHEN l_tax > 0 THEN l_partkey END AS q, l_suppkey AS g, 'm' || (l_partkey % 3) AS m FROM lineitem),
f AS (SELECT l_orderkey, m, min(l_linenumber) AS o FROM s GROUP BY 1, 2), ms AS (SELECT l_orderkey, string_agg(m, ',' ORDER BY o, m) AS models FROM f GROUP BY 1)
SELECT l_orderkey, round(sum(w), 3) AS wall_seconds, sum(coalesce(q, 0))::BIGINT AS num_queries, sum(g)::BIGINT AS tokens_generated, count(*)::BIGINT AS parts, any_value(models) AS models FROM s JOIN ms USING (l_orderkey) GROUP BY 1""",
)
def cost_merged(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("wall_seconds"),
        F.when(F.col("l_tax") > 0, F.col("l_partkey")).alias("num_queries"),
        F.col("l_suppkey").alias("tokens_generated"),
        F.lit(None).cast("bigint").alias("tokens_scored"),
        F.array(F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string"))).alias("models"),
    )
    found = K.merge_costs(line, ["l_orderkey"], "l_linenumber")
    return found.select("l_orderkey", "wall_seconds", "num_queries", "tokens_generated", "parts", F.array_join("models", ",").alias("models"))


@query(
    "cost_from_runs",
    """SELECT 'a' || o_orderpriority || ':' || o_orderkey || ':attack' AS id, (CASE WHEN o_custkey % 3 = 0 AND o_custkey <> 0 THEN o_custkey ELSE 1000 END)::BIGINT AS query_count, round(o_totalprice / 3600.0, 9) AS wall_clock_hours FROM orders""",
)
def cost_from_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), "o_orderpriority").alias("attack"),
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(0).alias("successful_queries"),
        F.lit(None).cast("bigint").alias("query_attempts"),
        F.lit(1000).cast("bigint").alias("budget"),
        F.col("o_totalprice").alias("wall_clock_seconds"),
        F.lit(None).cast("double").alias("gpu_hours"),
    )
    return K.costs_from_runs(runs).select("id", "query_count", F.round("wall_clock_hours", 9).alias("wall_clock_hours"))


@query(
    "cost_gpu_hours",
    """SELECT o_orderpriority, round(sum(floor(o_totalprice) * (o_custkey % 4 + 1)) / 3600.0, 6) AS gpu_hours, count(*)::BIGINT AS jobs FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def cost_gpu_hours(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("state"),
        F.floor("o_totalprice").alias("elapsed_seconds"),
        F.concat(F.lit("cpu=8,mem=64G,gres/gpu="), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit(",gres/gpu:b200=1")).alias("tres"),
    )
    return K.gpu_hours(jobs, ["o_orderpriority"]).withColumn("gpu_hours", F.round("gpu_hours", 6))


@query(
    "cost_queries_to_target",
    """WITH p AS (SELECT l_suppkey::VARCHAR AS method, l_partkey AS budget, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
m AS (SELECT method, min(budget) FILTER (budget <= 150 AND value >= 45) AS f, max(budget) FILTER (budget <= 150) AS last, count(*) FILTER (budget <= 150) AS n FROM p GROUP BY 1)
SELECT method, f::BIGINT AS queries_to_target, last IS NOT NULL AND f IS NULL AS censored, (CASE WHEN last IS NOT NULL AND f IS NULL THEN last END)::BIGINT AS censor_at,
CASE WHEN last IS NULL THEN 'unavailable' WHEN f IS NULL THEN '>' || last ELSE f::VARCHAR END AS display, CASE WHEN last IS NULL THEN 'unavailable' WHEN f IS NULL THEN 'censored' ELSE 'reached' END AS status,
n::BIGINT AS points_used, coalesce(last = 150, false) AS observed_at_budget_cap FROM m""",
)
def cost_queries_to_target(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("method"), F.col("l_partkey").alias("budget")
    ).agg(F.max("l_quantity").alias("value"))
    return K.queries_to_target(points, 45.0, 150, True)


@query(
    "cost_known_products",
    "SELECT l_returnflag, count(*) FILTER (l_tax > 0)::BIGINT AS known, round(sum(CASE WHEN l_tax > 0 THEN l_quantity * l_tax / 1000 END), 4) AS total FROM lineitem GROUP BY 1",
)
def cost_known_products(spark, sf_dir):
    price = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", mul_known("l_quantity", price, 1000.0).alias("p"))
    return rows.groupBy("l_returnflag").agg(F.count("p").alias("known"), F.round(F.sum("p"), 4).alias("total"))


@query("cost_hours", "SELECT o_orderkey, round(round(o_totalprice, 3) / 3600.0, 6) AS hours FROM orders")
def cost_hours(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds_to_hours("o_totalprice").alias("hours"))


@query(
    "cost_curve_rules",
    "SELECT 'duplicate_point' AS rule, count(*)::BIGINT AS broken FROM (SELECT l_suppkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0",
)
def cost_curve_rules(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("method"), F.col("l_linenumber").alias("budget"), F.col("l_tax").alias("value"),
        F.lit("M2").alias("effect_family"), F.lit("rouge").alias("metric"), F.lit("f1").alias("unit"),
    )
    return K.curve_violations(points).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"))
