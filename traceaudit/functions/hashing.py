"""Canonical JSON, lineage hashes, keyed seeds and typed equality."""

from __future__ import annotations

import json
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from traceaudit.functions.text import as_column, each_value

SEED_MODULUS = (1 << 63) - 1  # fixed value: keyed seeds stay below 2^63 - 1


@arrow_udf(T.StringType())
def canonical_json(documents: pa.Array) -> pa.Array:
    """JSON text with sorted keys and no blanks."""

    def tidy(text: str) -> str:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return each_value(documents, tidy, pa.string())


def stable_text_hash(document: Column | str) -> Column:
    """sha256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(as_column(document)), 256)


def stable_hash(value) -> str:
    """sha256 of the canonical JSON of a small driver-side value (manifests)."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return sha256(text.encode("utf-8")).hexdigest()


def prompt_signature(given_hash: Column | str, arguments: Column | str) -> Column:
    """Identity of a prompt: the hash that came with it, else one of its arguments."""
    given_hash = as_column(given_hash)
    return F.when(F.length(given_hash) > 0, F.concat(F.lit("lm-eval:"), given_hash)).otherwise(
        F.concat(F.lit("arguments-sha256:"), stable_text_hash(arguments))
    )


def context_seed(secret: str, token_ids: Column | str, window: int) -> Column:
    """Keyed seed of the last ``window`` token ids."""
    ids = as_column(token_ids)
    start = F.greatest(F.size(ids) - window, F.lit(0)) + 1
    tail = F.array_join(F.transform(F.slice(ids, start, F.lit(window)), lambda t: t.cast("string")), ",")
    digest = F.sha2(F.concat(F.lit(f"{secret}|"), tail), 256)
    seed = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (seed % F.lit(SEED_MODULUS).cast("decimal(20,0)")).cast("bigint")


def typed_eq(left: Column | str, right: Column | str) -> Column:
    """Equality of two VARIANT scalars where a boolean, a text and a number never match."""
    left, right = as_column(left), as_column(right)

    def kind(v: Column) -> Column:
        name = F.schema_of_variant(v)
        return F.when(name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number").otherwise(name)

    same_number = F.try_variant_get(left, "$", "double") == F.try_variant_get(right, "$", "double")
    same_text = F.try_variant_get(left, "$", "string") == F.try_variant_get(right, "$", "string")
    return F.when(kind(left) != kind(right), False).when(kind(left) == "number", same_number).otherwise(same_text)


def is_scalar(value: Column | str) -> Column:
    """True for a JSON boolean, text or finite number."""
    return F.schema_of_variant(as_column(value)).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|STRING|BOOLEAN)")


def _hash_level(rows: DataFrame, block: int) -> DataFrame:
    """Hash runs of ``block`` consecutive positions into one row each."""
    return (
        rows.groupBy(F.floor(F.col("p") / F.lit(block)).alias("b"))
        .agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("rows"), F.sum("n").alias("n"))
        .select(F.col("b").alias("p"), F.sha2(F.array_join(F.col("rows.h"), "\n"), 256).alias("h"), "n")
    )


def ordered_hash(df: DataFrame, position: str, parts: list[str], block: int = 1 << 16) -> DataFrame:
    """One hash over ordered rows, at any size.

    Rows are hashed one by one, then blocks of consecutive positions over their
    row hashes, then blocks of blocks. No task sees more than ``block`` short
    hashes; where positions are so sparse that more than ``block`` blocks are
    left, these are hashed in blocks once more, until the last step has few. The value is not
    that of ``stable_hash`` over the same list, so the scheme is named.
    """
    row_hash = F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
    rows = df.select(F.col(position).cast("bigint").alias("p"), row_hash.alias("h"), F.lit(1).cast("bigint").alias("n"))
    tree = _hash_level(_hash_level(rows, block), block)
    while tree.limit(block + 1).count() > block:
        tree = _hash_level(tree, block)
    merged = tree.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("tops"), F.sum("n").alias("n"))
    return merged.select(
        F.lit(f"block-sha256/{block}").alias("scheme"),
        F.coalesce("n", F.lit(0)).alias("row_count"),
        F.sha2(F.array_join(F.col("tops.h"), "\n"), 256).alias("ordering_hash"),
    )


#: Bits of each of the two hashes of a set's members that are added up.
SET_BITS = 60


def set_digest(ident: Column | str) -> Column:
    """Aggregate: digest of the set of (distinct, non-null) texts of a group, whatever their order.

    Two independent hashes of each member are added up modulo 2**60, so parts of a set can be summed apart, at any size.
    The scheme is ``sum-md5/60``: SHA-256 of the number of members and both sums. It is not the hash of a sorted list.
    """
    text = as_column(ident).cast("string")
    sums = [F.coalesce(F.sum(F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), text)), 1, SET_BITS // 4), 16, 10).cast("decimal(38,0)")), F.lit(0)) for k in (1, 2)]
    return F.sha2(F.concat_ws(":", F.count(text).cast("string"), *[(s % F.lit(1 << SET_BITS)).cast("decimal(38,0)").cast("string") for s in sums]), 256)
