"""Prompt-corpus preparation: dedup, decontamination, order, budgets, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.functions.text import as_column, norm_key, strip
from traceaudit.operators import rules
from traceaudit.operators.ordering import hash_fraction, positions, seeded_positions

# Published pool sizes and the fallback id of a pool row.
POOL_TIERS = (100, 1000, 10000, 50000, 100000)
DEFAULT_BUDGETS = (100, 1000, 10000)


def key_digest(text: Column | str) -> Column:
    """Digest of the comparison key: texts may be long, digests shuffle cheaply.

    Never null, so joins on it add no null filter that would evaluate the key
    twice; a null text has a key of its own.
    """
    return F.coalesce(F.sha2(norm_key(text), 256), F.lit(""))


def dedup(df: DataFrame, text: str, position: str) -> DataFrame:
    """Keep the first row of every comparison key.

    The minimum position per key combines before the shuffle, so a text that
    fills a third of the table reaches the reducer as a few rows; the rows
    themselves are then matched on their unique position.
    """
    first = df.select(key_digest(text).alias("_key"), position).groupBy("_key").agg(F.min(position).alias(position))
    return df.join(first.select(position), position, "left_semi")


def deleted_ids(before: DataFrame, after: DataFrame, ident: str) -> DataFrame:
    return before.select(ident).join(after.select(ident), ident, "left_anti")


def decontaminate(df: DataFrame, evaluation: DataFrame, text: str, evaluation_text: str | None = None) -> DataFrame:
    """Drop rows whose comparison key equals that of an evaluation text."""
    seen = evaluation.select(key_digest(evaluation_text or text).alias("_key")).distinct()
    return df.withColumn("_key", key_digest(text)).join(seen, "_key", "left_anti").drop("_key")


def clean_rows(df: DataFrame, evaluation: DataFrame, text: str, position: str, keep: Sequence[str]) -> DataFrame:
    """Unique, uncontaminated rows as a narrow table ``(position, *keep)``.

    Dedup and decontamination are one aggregate over the keys of both tables: it
    keeps the first row of each key and whether evaluation holds it. Each text
    is read once, copies collapse before the only shuffle, and there is no join
    that a frequent key could skew. Join the result with the corpus where the
    texts themselves are needed.
    """
    fields = F.struct(*[F.col(c) for c in (position, *keep)])
    rows = df.select(key_digest(text).alias("_key"), fields.alias("_row"), F.lit(False).alias("_seen"))
    held_out = evaluation.select(
        key_digest(text).alias("_key"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_seen")
    )
    keys = rows.unionByName(held_out).groupBy("_key").agg(F.min("_row").alias("_row"), F.max("_seen").alias("_seen"))
    return keys.filter(F.col("_row").isNotNull() & ~F.col("_seen")).select("_row.*")


def held_out_violations(evaluation: DataFrame, training: DataFrame, text: str) -> DataFrame:
    """Evaluation keys that also occur in training."""
    return rules.overlap_rule(
        evaluation.select(key_digest(text).alias("key")),
        training.select(key_digest(text).alias("key")),
        ["key"],
        "held_out_overlap",
    )


def exclude(df: DataFrame, other: DataFrame, ident: str, prompt: str) -> DataFrame:
    """Drop rows whose id or trimmed prompt occurs in the other table.

    Ids and prompt digests decide; texts cross the network once, with the rows that are left to keep.
    """
    digest = F.sha2(strip(prompt), 256)
    marked = df.withColumn("_prompt", digest)
    seen = other.select(ident, digest.alias("_prompt"))
    keys = marked.select(ident, "_prompt").distinct()
    keys = keys.join(seen.select(ident).distinct(), ident, "left_anti").join(seen.select("_prompt").distinct(), "_prompt", "left_anti")
    keys = keys.select(F.col(ident).alias("_ident"), F.col("_prompt").alias("_digest"))
    same = F.col(ident).eqNullSafe(F.col("_ident")) & F.col("_prompt").eqNullSafe(F.col("_digest"))
    return marked.join(keys, same, "left_semi").drop("_prompt")


def budget_members(ordered: DataFrame, budgets: Sequence[int], position: str = "position") -> DataFrame:
    """One row per (budget, row inside that prefix); prefixes nest by construction."""
    limits = F.array(*[F.lit(int(b)) for b in sorted(budgets)])
    inside = ordered.filter(F.col(position) <= max(budgets))
    return inside.withColumn("budget", F.explode(F.filter(limits, lambda b: b >= F.col(position))))


def budget_prefixes(ordered: DataFrame, budgets: Sequence[int], position: str = "position") -> DataFrame:
    """Requested and actual size of each prefix, with a flag for short data."""
    found = ordered.agg(
        *[F.count_if(F.col(position) <= int(b)).alias(str(b)) for b in sorted(budgets)]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(int(b)).alias("requested"), F.col(f"`{b}`").alias("actual")) for b in sorted(budgets)])
    )
    return found.select(rows.alias("r")).select(
        "r.requested", "r.actual", (F.col("r.actual") < F.col("r.requested")).alias("insufficient_data")
    )


def holdout_blocks(
    ordered: DataFrame, train: int, size: int, blocks: Sequence[int], position: str = "position"
) -> DataFrame:
    """Rows of whole blocks that lie after the training prefix (positions from 1)."""
    for block in blocks:
        if block < 0 or block * size < train:
            raise ValueError(f"block {block} overlaps the training prefix of {train} rows")
    block_id = F.floor((F.col(position) - 1) / F.lit(size))
    return ordered.withColumn("block_id", block_id).filter(F.col("block_id").isin(*[int(b) for b in blocks]))


def block_violations(
    selected: DataFrame, ordered: DataFrame, train: int, size: int, blocks: Sequence[int], ident: str, text: str,
    position: str = "position",
) -> DataFrame:
    """Incomplete blocks, ids that recur in the training prefix, empty prompts."""
    wanted = selected.sparkSession.createDataFrame([(int(b),) for b in blocks], "block_id bigint")
    have = selected.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    short = (
        wanted.join(have, "block_id", "left")
        .filter(F.coalesce("n", F.lit(0)) < size)
        .select(
            F.lit("incomplete_block").alias("rule"),
            F.col("block_id").cast("string").alias("row_key"),
            F.concat(F.coalesce("n", F.lit(0)), F.lit(f" of {size} rows")).alias("detail"),
        )
    )
    trained = ordered.filter(F.col(position) <= train)
    overlap = rules.overlap_rule(selected, trained, [ident], "overlaps_training")
    empty = rules.row_rules(selected, ident, [("empty_prompt", F.coalesce(F.length(text), F.lit(0)) == 0)])
    return rules.all_violations([short, overlap, empty])


def slice_after(ordered: DataFrame, budget: int, size: int, position: str = "position") -> DataFrame:
    """The rows directly behind a budget prefix; refused where the table ends before."""
    return require_rows(ordered.filter(F.col(position).between(budget + 1, budget + size)), size, "slice behind the budget")


def require_rows(df: DataFrame, wanted: int, what: str) -> DataFrame:
    """Raise if the table holds fewer rows than asked for."""
    have = df.limit(wanted).count()
    if have < wanted:
        raise rules.AuditRuleError(f"{what}: {have} rows, need {wanted}")
    return df


def limit_rows(df: DataFrame, n: int, position: str) -> DataFrame:
    """First n rows in the order of an explicit position column."""
    return df.orderBy(position).limit(n)


def seeded_order(df: DataFrame, ident: str, seed: int) -> DataFrame:
    """Pseudo-random order that does not depend on partitioning or engine."""
    return seeded_positions(df, ident, seed)


def seeded_sample(df: DataFrame, ident: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows (or all), chosen by seeded order."""
    return seeded_positions(df, ident, seed).filter(F.col("position") <= size).drop("position")


def split_by_ratio(df: DataFrame, ident: str, ratio: float, seed: int) -> DataFrame:
    """Column ``part``: train for a seeded share of the ids, test for the rest."""
    return df.withColumn("part", F.when(hash_fraction(ident, seed) < ratio, "train").otherwise("test"))


def mix_quotas(n_general: int, n_special: int, ratio: float) -> tuple[int, int]:
    """Rows to take from each side so the scarcer one limits the total."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must lie in [0, 1]")
    if not n_general or not n_special:
        return n_general, n_special
    limits = [int(n / share) for n, share in ((n_general, ratio), (n_special, 1.0 - ratio)) if share]
    whole = [n for n, share in ((n_special, ratio), (n_general, 1.0 - ratio)) if not share]
    total = max(1, min(limits + whole))
    general = min(n_general, round(total * ratio))
    return general, min(n_special, total - general)


def mix(general: DataFrame, special: DataFrame, ratio: float, order: str) -> DataFrame:
    """First rows of two sources at a target ratio, tagged by ``mix_side``."""
    g, s = mix_quotas(general.count(), special.count(), ratio)
    parts = [
        positions(df, [order]).filter(F.col("position") <= quota).withColumn("mix_side", F.lit(side)).drop("position")
        for df, quota, side in ((general, g, "general"), (special, s, "special"))
    ]
    return parts[0].unionByName(parts[1])


def largest_remainder(weights: DataFrame, total: int, key: str = "stratum", weight: str = "weight") -> DataFrame:
    """Allocate ``total`` over strata in proportion to their weights.

    One row per stratum goes in, so the leftover ranking is over the strata
    table, not over data rows. Ties: remainder, weight, key, all descending.
    """
    share = F.lit(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy(F.lit(0)))
    base = weights.select(key, weight, share.alias("share")).withColumn("floor_count", F.floor("share"))
    ranked = Window.partitionBy(F.lit(0)).orderBy(
        (F.col("share") - F.col("floor_count")).desc(), F.col(weight).desc(), F.col(key).desc()
    )
    leftover = F.lit(total) - F.sum("floor_count").over(Window.partitionBy(F.lit(0)))
    extra = F.when(F.row_number().over(ranked) <= leftover, 1).otherwise(0)
    return base.select(key, weight, (F.col("floor_count") + extra).cast("bigint").alias("quota"))


def matched_sample(
    candidates: DataFrame, reference: DataFrame, size: int, seed: int, stratum: str, ident: str
) -> tuple[DataFrame, DataFrame]:
    """Sample candidates with the stratum mix of a reference; returns (rows, shortfalls)."""
    weights = reference.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("weight"))
    quotas = largest_remainder(weights, size)
    ranked = seeded_positions(candidates.withColumn("stratum", F.col(stratum)), ident, seed, by=["stratum"])
    chosen = ranked.join(quotas.select("stratum", "quota"), "stratum").filter("position <= quota")
    have = candidates.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("have"))
    short = (
        quotas.join(have, "stratum", "left")
        .withColumn("shortfall", F.col("quota") - F.coalesce("have", F.lit(0)))
        .filter("shortfall > 0")
        .select("stratum", "quota", "shortfall")
    )
    return chosen.drop("stratum", "position", "quota"), short


def select_by_order(pool: DataFrame, ordering: DataFrame, budget: int, ident: str) -> DataFrame:
    """Pool rows in the order of an (order_index, id) table, the first ``budget`` that exist.

    A pool id that repeats counts once, its last row (by ``pool_position``) wins.
    """
    last = pool.groupBy(ident).agg(F.max("pool_position").alias("pool_position"))
    present = positions(ordering.join(last, ident), ["order_index"]).filter(F.col("position") <= budget)
    return present.join(pool, [ident, "pool_position"])


def source_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def tier_for(budget: Column | str) -> Column:
    """Smallest published pool that covers a budget; null beyond the largest."""
    budget = as_column(budget)
    fits = [F.when(budget <= t, F.lit(t)) for t in POOL_TIERS]
    return F.when(budget > 0, F.coalesce(*fits))


def take_user_traffic(
    stream: DataFrame, excluded: DataFrame, wanted: int, max_scan: int, position: str = "position", text: str = "query"
) -> DataFrame:
    """First ``wanted`` usable rows among the first ``max_scan`` of the stream; refused where these hold fewer.

    Rows without text count as scanned. Both sides are compared by a digest of the stripped text.
    """
    digest = F.sha2(strip(text), 256)
    scanned = stream.filter((F.col(position) <= max_scan) & (F.length(strip(text)) > 0)).withColumn("_digest", digest)
    banned = excluded.select(digest.alias("_digest")).distinct()
    usable = scanned.join(banned, "_digest", "left_anti").drop("_digest")
    return require_rows(usable.orderBy(position).limit(wanted), wanted, f"user traffic in {max_scan} rows")


def concat_limit(parts: Sequence[DataFrame], limit: int, position: str) -> DataFrame:
    """Stage tables one after the other, cut to a limit."""
    tagged = [df.withColumn("stage", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).orderBy("stage", position).limit(limit)


def budget_shares(total: Column | str) -> Column:
    """Shares of a query budget for the seed, template and follow-up stages."""
    total = as_column(total).cast("bigint")
    seed = F.least(F.lit(3), total)
    rest = total - seed
    template = F.when(rest == 1, 1).otherwise(F.floor(rest / 2)).cast("bigint")
    return F.struct(
        seed.cast("bigint").alias("seed"), template.alias("template"), (rest - template).alias("followup")
    )


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows that have no finished row yet."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unique_ids(df: DataFrame, ident: str, row_index: str, name: str = "unique_id") -> DataFrame:
    """Append ``::row-<index>`` to ids that occur more than once."""
    repeated = df.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = df.join(repeated.withColumn("_repeated", F.lit(True)), ident, "left")
    suffixed = F.concat(F.col(ident).cast("string"), F.lit("::row-"), F.col(row_index).cast("string"))
    plain = F.col(ident).cast("string")
    return marked.withColumn(name, F.when(F.col("_repeated"), suffixed).otherwise(plain)).drop("_repeated")


def schedule(df: DataFrame, scores: DataFrame, ident: str, score: str, priority: str) -> DataFrame:
    """Rows with their place in the plan: highest score first, unscored last, then priority."""
    ranked = df.join(scores.select(ident, score), ident, "left").withColumn(score, F.coalesce(score, F.lit(-1.0)))
    return positions(
        ranked.withColumn("_rank", -F.col(score)), ["_rank", priority, ident], name="schedule_position"
    ).drop("_rank")


def mode_count(available: Column | str, mode: str, smoke: int, pilot: int) -> Column:
    """Examples to run per split in a mode."""
    available = as_column(available)
    if mode in ("smoke", "dry-run"):
        return F.least(available, F.lit(smoke))
    return F.least(available, F.lit(pilot)) if mode == "pilot" else available


def pick_split(df: DataFrame, by: Sequence[str], split: str = "split") -> DataFrame:
    """One split per dataset: validation, else train, else test, else the first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("validation", "train", "test"))), F.col(split)), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    return df.groupBy(*by).agg(F.min_by(F.col(split), F.struct(rank, F.col(split))).alias(split))


def distinct_counts(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Number of distinct non-null values of each column, as one row.

    Each value is kept once per task before it is shuffled by column and value, so a column of few values costs few rows
    and one of many is spread; several columns need one pass.
    """
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    pairs = df.select(F.inline(values)).filter("v is not null").distinct()
    counts = [F.count_if(F.col("i") == i).alias(n) for i, n in enumerate(names or columns)]
    return pairs.agg(*counts)
