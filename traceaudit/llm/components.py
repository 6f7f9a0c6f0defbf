"""Connected components of a table of links, as joins and groupings that end after a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours, beside each of its pairs."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link to another; the component is its smallest node.

    Alternating large and small stars: neighbours move to the least node next to them, until every component is a star
    around its smallest node. Rounds grow with the logarithm of the longest chain. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most. A node with very many links is grouped
    with partial sums and its join is an ordinary one that Spark may split.
    """
    pairs = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    pairs = materialise(
        pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # In a large star every pair points to a smaller node; a small star joins those to the least of them.
        stars = _toward_least(large)
        small = stars.select("u", F.col("m").alias("v")).unionByName(stars.select(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = materialise(small.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
