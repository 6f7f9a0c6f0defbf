"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree over block quotas.

The documents of a source, in the order of a seeded hash, are one stream of words, which the mix may read up to
``most_repeats`` times. What it takes is the stream up to the source's target, in blocks of one size: that is the
source's quota, exact to the word. A binary tree deals the quotas to the output shards: each node draws, from a
multivariate hypergeometric distribution, which of its blocks go left, so every shard gets the mix it would get from a
random deal of all blocks, though only counts are handled. A keyed permutation of each source's blocks then gives the
shards disjoint runs of blocks, and rows of a shard are put in random order where they are.

All of it is DataFrame functions. Sums per source and hash slice are the only grouping, so a source that owns most
rows is spread over all slices.

Defined results: a null ``source`` is a source of its own, last in order; null or blank texts have size 0, and nothing
of them is taken; null or repeated ``doc_id`` are rows like others, in the order of size and a hash of the text, so rows
that agree in these are taken alike whichever comes first; texts of any length count whole; one document of a source may
be taken in part, where the quota ends. An empty table gives an empty mix. Other columns are kept, whatever their names,
but ``_size``, ``_source_size``, ``_target`` and ``_takes``, which ``mix`` adds and so refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_REPEATS, BLOCKS_PER_SHARD, SEED = (5, 2, 1), 3, 256, 17
#: Words of an output shard; their number is the power of two that gives each shard no more.
WORDS_PER_SHARD = 1 << 22
#: Rounds of the permutation of a source's blocks, and how often a number beyond the blocks is permuted again. Of n
#: blocks at most the root of n numbers lie beyond, so fewer steps suffice for some thousand blocks, and with more
#: blocks a step leaves one in forty open.
_ROUNDS, _WALK = 4, 40
#: Draws farther than this many standard deviations from the mean have a chance below 1e-20 and are left out.
_REACH = 10.0
_OWN = ("_size", "_source_size", "_target", "_takes")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size`` with ``index``, ``target`` and ``words``, those of all sources; one row per source.

    A target is the source's weight times a common level, or ``most_repeats`` times its size where that is less. The
    level is the one at which targets add up to all words: if sources are capped in the order in which they reach
    their cap, it is the largest level that comes up.
    """
    by_source = Window.orderBy(F.asc_nulls_last("source"))
    rows = totals.withColumn("index", (F.row_number().over(by_source) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("index") % len(weights) + 1)
    rows = rows.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most_repeats)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "index")
    everywhere = Window.partitionBy()
    capped = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("words", F.sum("source_size").over(everywhere))
    rows = rows.withColumn("_level", (F.col("words") - capped) / rest)
    level = F.max("_level").over(everywhere)
    return rows.withColumn("target", F.least("_cap", F.col("_weight") * level)).select(
        "source", "source_size", "index", "target", "words"
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked blocks among ``drawn`` out of ``total``, by inversion of the distribution at ``u``."""
    mean = drawn * marked / total
    spread = F.sqrt(mean * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - _REACH * spread - 3)).cast("bigint")
    high = F.least(drawn, marked, F.ceil(mean + _REACH * spread + 3)).cast("bigint")

    def draw(bounds: Column) -> Column:
        ks = F.sequence(bounds["low"], bounds["high"])

        def following(log: Column, k: Column) -> Column:  # log weight of k + 1
            ratio = (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1)).cast("double")
            return F.when(k < bounds["high"], log + F.log(ratio)).otherwise(log)

        def add(acc: Column, k: Column) -> Column:
            top = F.greatest(acc["top"], acc["log"])
            return F.struct(
                following(acc["log"], k).alias("log"), top.alias("top"),
                (acc["sum"] * F.exp(acc["top"] - top) + F.exp(acc["log"] - top)).alias("sum"),
            )

        start = F.struct(F.lit(0.0).alias("log"), F.lit(-1e300).alias("top"), F.lit(0.0).alias("sum"))

        def pick(whole: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                reached = acc["sum"] + F.exp(acc["log"] - whole["top"])
                found = F.when(acc["found"].isNull() & (reached >= u * whole["sum"]), k).otherwise(acc["found"])
                return F.struct(following(acc["log"], k).alias("log"), reached.alias("sum"), found.alias("found"))

            first = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("found"))
            return F.coalesce(F.aggregate(ks, first, step)["found"], bounds["high"])

        return _bound(F.aggregate(ks, start, add), pick)

    drawn_at_random = _bound(F.struct(low.alias("low"), high.alias("high")), draw)
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("bigint")).otherwise(drawn_at_random)


def _uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12) + 0.5) / float(1 << 52)


def permuted(value: Column, count: Column, *key: Column) -> Column:
    """A keyed permutation of 0 .. count - 1: a Feistel network over two digits, walked on until it is below ``count``."""
    width = F.ceil(F.sqrt(count.cast("double"))).cast("bigint")
    height = F.ceil(count / width).cast("bigint")

    def once(x: Column) -> Column:
        def turn(digits: Column, number: Column) -> Column:
            low, high = digits["low"], digits["high"]
            hashed = F.xxhash64(*key, number, F.when(number % 2 == 0, high).otherwise(low))
            return F.when(number % 2 == 0, F.struct(F.pmod(low + F.pmod(hashed, width), width).alias("low"), high.alias("high"))).otherwise(
                F.struct(low.alias("low"), F.pmod(high + F.pmod(hashed, height), height).alias("high"))
            )

        start = F.struct(F.pmod(x, width).alias("low"), F.floor(x / width).cast("bigint").alias("high"))
        return F.aggregate(F.array(*[F.lit(r) for r in range(_ROUNDS)]), start, turn, lambda d: d["high"] * width + d["low"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(value), lambda x, _: F.when(x < count, x).otherwise(once(x)))


def place_in(ends: Column, value: Column) -> Column:
    """How many of the ascending ``ends``, a power of two less one or more, are at most ``value``: by bisection."""
    widths = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(ends) + 1)).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    halves = F.reverse(widths)

    def step(found: Column, width: Column) -> Column:
        end = F.get(ends, found + width - 1)
        return F.when(F.coalesce(end <= value, F.lit(False)), found + width).otherwise(found)

    return F.aggregate(halves, F.lit(0), step)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``shard``, ``quota`` (an array like ``quota`` of the one row given): what each shard gets of every source."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    nodes = quotas.select(F.lit(0).alias("shard"), "quota")
    width = shards
    while width > 1:
        width //= 2

        def left(q: Column, node: Column, level: int = width) -> Column:
            total = F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x)
            start = F.struct(
                total.alias("total"), F.floor((total + 1) / 2).cast("bigint").alias("drawn"),
                F.array().cast("array<bigint>").alias("out"),
            )

            def take(acc: Column, i: Column) -> Column:
                marked = F.get(q, i)
                drawn = hypergeometric(acc["total"], marked, acc["drawn"], _uniform(seed, F.lit(level), node, i))
                return _bound(drawn, lambda k: F.struct(
                    (acc["total"] - marked).alias("total"), (acc["drawn"] - k).alias("drawn"), F.concat(acc["out"], F.array(k)).alias("out"),
                ))

            indexes = F.when(F.size(q) > 0, F.sequence(F.lit(0), F.size(q) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(indexes, start, take)["out"]

        split = nodes.withColumn("_left", left(F.col("quota"), F.col("shard")))
        right = F.zip_with("quota", "_left", lambda a, b: a - b)
        sides = F.array(
            F.struct(F.col("shard").alias("shard"), F.col("_left").alias("quota")),
            F.struct((F.col("shard") + width).alias("shard"), right.alias("quota")),
        )
        nodes = split.select(F.inline(sides))
    return nodes


def source_plan(totals: DataFrame, weights, most_repeats: int, shards: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """One row per source: ``source, source_size, target, take, block, quota`` and ``ends``, where shards' blocks end."""
    rows = source_targets(totals, weights, most_repeats)
    block = F.greatest(F.lit(1), F.ceil(F.col("words") / (shards * blocks_per_shard))).cast("bigint")
    rows = rows.withColumn("block", block).withColumn("take", F.round("target").cast("bigint"))
    rows = materialise(rows.withColumn("quota", F.ceil(F.col("take") / F.col("block")).cast("bigint")))
    one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "quota"))), lambda x: x["quota"]).alias("quota"))
    dealt = split_quotas(one, shards, seed).select("shard", F.posexplode("quota").alias("index", "n"))
    order = Window.partitionBy("index").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        dealt.withColumn("end", F.sum("n").over(order)).groupBy("index")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    )
    return materialise(rows.join(ends, "index").drop("index", "words"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, shards: int | None = None,
    blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_takes``: what the mix takes of each row.

    A take is ``copy`` (which reading of the source), ``words`` (from the front of the text), ``shard`` and ``key``, a
    random order in the shard. Reruns agree: all is a function of ``doc_id``, text, source and seed.
    """
    clash = set(_OWN) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with those of the mix")
    slices = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Columns of the caller go by numbers, so none is named like one of these.
    given = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    flat = docs.select(*given, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "text")
    point = F.xxhash64(F.lit(seed), "_id")
    # Slices follow the order of the hash, so sums of earlier slices complete the sums inside one.
    cut = F.floor((F.shiftright(point, 40) + (1 << 23)) * slices / float(1 << 24)).cast("int")
    rows = sized(flat).withColumns({"_point": point, "_slice": cut, "_tie": F.xxhash64("text")}).drop("text")
    parts = materialise(rows.groupBy("_source", "_slice").agg(F.sum("_size").alias("_words")))
    totals = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    if shards is None:
        words = totals.agg(F.sum("source_size")).first()[0] or 0
        shards = 1 << max(0, -(-words // WORDS_PER_SHARD) - 1).bit_length()
    plan = source_plan(totals, weights, most_repeats, shards, blocks_per_shard, seed)
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    here = before.withColumnsRenamed({"_source": "_s", "_slice": "_k"}).join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    joined = rows.join(here, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")))
    inside = (
        Window.partitionBy("_source", "_slice").orderBy("_point", "_id", "_size", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))

    def take(copy: Column) -> Column:
        at = copy * F.col("source_size") + F.col("_start")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("take") - at)).cast("bigint")
        quota = F.greatest(F.col("quota"), F.lit(1))
        block = F.least(F.floor((at + words / 2) / F.col("block")).cast("bigint"), quota - 1)
        shard = place_in(F.col("ends"), permuted(block, quota, F.lit(seed), F.col("_source"))).cast("int")
        return F.struct(
            copy.alias("copy"), words.alias("words"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "_id", copy).alias("key")
        )

    copies = F.filter(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda c: (F.col("_size") > 0) & (c * F.col("source_size") + F.col("_start") < F.col("take")))
    taken = joined.withColumn("_start", start).select(
        *[f"_c{i}" for i in range(len(docs.columns))], "_size", F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.transform(copies, take).alias("_takes"),
    )
    return taken.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], *_OWN)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each take, in the columns of ``docs``, shard after shard in random order.

    Ranges of (shard, key) make the partitions, so a shard larger than a task is several, and each is sorted locally.
    """
    given = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    taken = mix(docs, **options).select(*given, F.col("text").alias("_text"), "_size", F.explode("_takes").alias("_take"))
    front = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col("_take.words").cast("int")), " ")
    whole = F.when(F.col("_take.words") < F.col("_size"), front).otherwise(F.col("_text"))
    order = [F.col(f"_take.{c}") for c in ("shard", "key", "copy")]
    ordered = taken.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return ordered.select(*[(whole if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)])
