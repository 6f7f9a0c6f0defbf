"""Text keys, tokens, n-grams and overlap scores as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

# The whitespace that separates words, and the token patterns.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ROUGE_TOKEN = rf"[\u3400-\u4dbf\u4e00-\u9fff]|[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*|[^{SPACE}]"
QUALITY_TOKEN = (
    r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{2fa1f}]"
    rf"|[\p{{L}}\p{{N}}]+(?:['’\-][\p{{L}}\p{{N}}]+)*|[^{SPACE}]"
)
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+"
PHRASE_STOP_WORDS = (
    "this", "that", "these", "those", "therefore", "because", "important", "domain", "concept", "concepts",
)
CAPITAL_RUN = r"(?U)\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,4}\b"
QUERY_TEMPLATES = {
    "DEF": "What is {entity}? Give a precise definition and explain why it is important.",
    "CAT": "What category does {entity} belong to, and what are closely related concepts?",
    "FUN": "What is the function or role of {entity} in its domain?",
    "PART": "What are the main components, subtypes, or parts of {entity}?",
}
LOWER_RUN = r"(?U)\b[a-z][a-z0-9\-]{4,}(?:\s+[a-z][a-z0-9\-]{4,}){0,3}\b"

def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that needs it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ascii(c: Column | str) -> Column:
    """One byte per character."""
    c = as_column(c)
    return F.octet_length(c) == F.char_length(c)


def collapse_space(c: Column | str) -> Column:
    """Trim and replace each run of whitespace by one blank."""
    return F.trim(F.regexp_replace(as_column(c), f"[{SPACE}]+", " "))


#: Bytes of texts, or one text, that a Python function turns into Python values at once.
SLICE_BYTES = 1 << 20


def sliced(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a column of at most ``SLICE_BYTES``, or one row: a batch of Spark is bounded by rows, not by their length."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    ends = np.cumsum(pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    if pa.types.is_list(column.type):
        count = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        ends = np.append(0, ends)[count]
    at = 0
    while at < len(column):
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + SLICE_BYTES, side="right")))
        yield column.slice(at, to - at)
        at = to


def each_value(column: pa.Array, work: Callable, kind: pa.DataType) -> pa.Array:
    """``work`` on every value that is not null, a slice at a time."""
    parts = [pa.array([None if v is None else work(v) for v in part.to_pylist()], kind) for part in sliced(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _key(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@arrow_udf(T.StringType())
def _unicode_key(texts: pa.Array) -> pa.Array:
    return each_value(texts, _key, pa.string())


@pandas_udf(T.ArrayType(T.StringType()))
def _unicode_key_array(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: None if row is None else [_key(t) for t in row])


@arrow_udf(T.StringType())
def _unicode_fold(texts: pa.Array) -> pa.Array:
    return each_value(texts, str.casefold, pa.string())


@arrow_udf(T.ArrayType(T.StringType()))
def _unicode_fold_tokens(rows: pa.Array) -> pa.Array:
    return each_value(rows, lambda row: [t.casefold() for t in row], pa.list_(pa.string()))


def _ascii_or(c: Column, native: Column, python) -> Column:
    """Native expression for ASCII rows; only the others cross into Python."""
    plain = is_ascii(c)
    return F.when(plain, native).otherwise(python(F.when(~plain, c)))


def norm_key(c: Column | str) -> Column:
    """Comparison key of a prompt: NFKC, casefold, trimmed, single blanks."""
    c = as_column(c)
    return _ascii_or(c, collapse_space(F.lower(c)), _unicode_key)


def fold(c: Column | str) -> Column:
    """Unicode casefold."""
    c = as_column(c)
    return _ascii_or(c, F.lower(c), _unicode_fold)


def fold_key(c: Column | str) -> Column:
    """Casefold with single blanks, no compatibility normalisation."""
    return collapse_space(fold(c))


def rouge_tokens(c: Column | str) -> Column:
    """Lower-case overlap tokens; CJK characters stand alone."""
    return F.transform(F.regexp_extract_all(as_column(c), F.lit(ROUGE_TOKEN), F.lit(0)), lambda t: F.lower(t))


def quality_tokens(c: Column | str) -> Column:
    """Case-folded Unicode words, single CJK characters and punctuation."""
    c = as_column(c)
    tokens = F.regexp_extract_all(c, F.lit(QUALITY_TOKEN), F.lit(0))
    plain = is_ascii(c)
    return F.when(plain, F.transform(tokens, lambda t: F.lower(t))).otherwise(
        _unicode_fold_tokens(F.when(~plain, tokens))
    )


def split_words(c: Column | str) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    return F.filter(F.split(as_column(c), f"[{SPACE}]+"), lambda w: w != "")


def ws_tokens(c: Column | str) -> Column:
    """Case-folded whitespace tokens."""
    return split_words(fold(c))


TOKENIZERS = {"unicode_cjk": quality_tokens, "whitespace": ws_tokens}


def ngrams(tokens: Column | str, n: int) -> Column:
    """All n-grams of a token array in order; empty when the array is short."""
    return F.transform(aligned_slices(as_column(tokens), n), lambda z: F.array(*[z[f"g{i}"] for i in range(n)]))


def aligned_slices(tokens: Column, n: int) -> Column:
    """The token array shifted by 0..n-1 and zipped: one entry per n-gram.

    Lambdas over the result never refer to the token column itself, which keeps
    Python-made columns usable (Spark forbids Python UDFs inside lambdas).
    """
    length = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, i + 1, length).alias(f"g{i}") for i in range(n)])


def gram_texts(tokens: Column | str, n: int) -> Column:
    """N-grams joined by a blank: tokens hold no blank, so equality is kept."""
    tokens = as_column(tokens)
    if n == 1:
        return tokens
    return F.transform(aligned_slices(tokens, n), lambda z: F.concat_ws(" ", *[z[f"g{i}"] for i in range(n)]))


def rep_n(tokens: Column | str, n: int) -> Column:
    """Share of repeated n-grams; null when there is no n-gram at all."""
    grams = gram_texts(tokens, n)
    total = F.size(as_column(tokens)) - n + 1
    return F.when(total > 0, 1.0 - F.size(F.array_distinct(grams)) / total)


def _lcs_length(left: Sequence[str], right: Sequence[str]) -> int:
    """Longest common subsequence by bit rows: one big-integer step per token."""
    short, long = (left, right) if len(left) <= len(right) else (right, left)
    where: dict[str, int] = {}
    for i, token in enumerate(short):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(short)) - 1
    row = full
    for token in long:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(short) - row.bit_count()


@pandas_udf(T.DoubleType())
def rouge_l_tokens(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two token arrays; both empty is 1, one empty is 0.

    F1 of precision c/n and recall c/m is 2c / (n + m).
    """

    def f1(a, b) -> float | None:
        if a is None or b is None:
            return None
        if len(a) == 0 or len(b) == 0:
            return 1.0 if len(a) == len(b) else 0.0
        return 2.0 * _lcs_length(list(a), list(b)) / (len(a) + len(b))

    return pd.Series([f1(a, b) for a, b in zip(candidate, reference)], dtype="float64")


def rouge_l(candidate: Column | str, reference: Column | str) -> Column:
    """ROUGE-L F1 on overlap tokens."""
    return rouge_l_tokens(rouge_tokens(candidate), rouge_tokens(reference))


def rouge_l_keys(candidate: Column | str, reference: Column | str) -> Column:
    """ROUGE-L F1 on the words of the comparison keys."""
    return rouge_l_tokens(split_words(norm_key(candidate)), split_words(norm_key(reference)))


def length_group(candidate: Column, reference: Column, lower: float, upper: float) -> Column:
    """shorter / similar / longer by length ratio, with rules for zero lengths."""
    if not 0 < lower <= upper:
        raise ValueError("length ratio bounds must satisfy 0 < lower <= upper")
    ratio = candidate / reference
    return (
        F.when((reference == 0) & (candidate == 0), "similar")
        .when(reference == 0, "longer")
        .when(ratio < lower, "shorter")
        .when(ratio > upper, "longer")
        .otherwise("similar")
    )


def interval_distance(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies against a closed interval, and how far outside."""
    gap = F.greatest(low - value, value - high, F.lit(0.0))
    edge = F.when(value < low, low).when(value > high, high).otherwise(value)
    return F.struct(
        F.when(value < low, "below").when(value > high, "above").otherwise("inside").alias("position"),
        gap.alias("distance"),
        F.when(gap > 0, gap / edge).otherwise(0.0).alias("relative_distance"),
    )


def phrases(c: Column | str, limit: int | None = 50) -> Column:
    """Capitalised runs, then long lower-case runs: distinct, in order of appearance."""
    c = as_column(c)
    runs = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (CAPITAL_RUN, LOWER_RUN)])
    clean = F.transform(runs, collapse_space)
    kept = F.filter(clean, lambda p: (F.length(p) >= 4) & ~F.lower(p).isin(*PHRASE_STOP_WORDS))
    unique = F.array_distinct(kept)
    return unique if limit is None else F.slice(unique, 1, limit)


def sentence_chunks(c: Column | str, limit: int = 4, min_words: int = 6) -> Column:
    """Sentences of at least ``min_words`` words, the first ``limit`` of them."""
    parts = F.transform(F.split(as_column(c), SENTENCE_END), strip)
    return F.slice(F.filter(parts, lambda p: F.size(split_words(p)) >= min_words), 1, limit)


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace, Unicode blanks included."""
    return F.regexp_replace(as_column(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def sentences(c: Column | str) -> Column:
    """Split after sentence ends and at line breaks, blanks dropped."""
    parts = F.transform(F.split(as_column(c), rf"{SENTENCE_END}|\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def word_choice(c: Column | str, choices: Column) -> Column:
    """First listed choice that stands as a whole word in the text."""
    plain = F.forall(choices, lambda x: F.octet_length(x) == F.char_length(x))
    keys = F.when(plain, F.transform(choices, lambda x: collapse_space(F.lower(x)))).otherwise(
        _unicode_key_array(F.when(~plain, choices))
    )
    texts = F.array_repeat(norm_key(c), F.size(choices))
    rows = F.arrays_zip(choices.alias("choice"), keys.alias("key"), texts.alias("text"))
    before, after = F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lit(r"\E(?![\p{L}\p{N}_])")
    hits = F.filter(rows, lambda r: F.regexp_like(r["text"], F.concat(before, r["key"], after)))
    return F.get(hits, F.lit(0))["choice"]


def clean_task_text(c: Column | str) -> Column:
    """Replace ``[title]`` markers by a full stop and trim."""
    return strip(F.regexp_replace(as_column(c), r"\s*\[title\]\s*", ". "))


def with_leading_space(c: Column) -> Column:
    """Candidate continuations start with whitespace."""
    return F.when(c.rlike(f"^[{SPACE}]"), c).otherwise(F.concat(F.lit(" "), c))


def render(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` slots of a template with column values.

    The template is cut at its slots first, so braces inside the values are
    never read as slots.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values]
        hits = [(at, k) for at, k in hits if at >= 0]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, slot = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(as_column(values[slot]).cast("string"))
        rest = rest[at + len(slot) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")


def expand_templates(
    df: DataFrame, entity: str, templates: dict[str, str] | None = None, limit: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """One query per (entity, template); each row is expanded in place, optionally cut to a budget in order."""
    templates = QUERY_TEMPLATES if templates is None else templates
    rows = [
        F.struct(F.lit(i).alias("slot"), F.lit(name).alias("template_id"), render(text, entity=entity).alias("query"))
        for i, (name, text) in enumerate(templates.items())
    ]
    expanded = df.withColumn("_t", F.explode(F.array(*rows))).select(*df.columns, "_t.*")
    if limit is not None:
        expanded = expanded.orderBy(*order, "slot").limit(limit)
    return expanded
