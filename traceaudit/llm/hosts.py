"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none). Repeated windows of a text are told apart by 64-bit
hashes, lines are compared themselves.

A document fails the base rules with fewer than 10 words, or if more than a fifth of its words stand in repeated 5-word
windows. Further rules are for hosts alone: words that are on average shorter than 2 or longer than 15 characters, more
than one symbol for ten words, more than three of ten lines equal to an earlier one. For each rule a host's failure rate
is ``(failures + a) / (documents + a + b)``, where the beta prior (a, b) has the mean and variance of the hosts' own
rates; a host with a rate above ``host_limit`` loses all its documents. A document that fails a host rule at a good host
stays.

Defined results: documents without a host are judged by the base rules alone; null, empty and blank texts have no words
and fail the base rules only; null or repeated ``doc_id`` are rows like others, and equal rows get equal verdicts; texts of
any length are counted whole; an empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.store import materialise
from traceaudit.llm.texts import run_starts, slices, utf8, window_hashes, word_hashes, words

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Bounds of the host rules: characters of a word on average, symbols for 100 words, repeated lines of 100.
SHORTEST_WORD, LONGEST_WORD, MOST_SYMBOLS, MOST_EQUAL_LINES = 2, 15, 10, 30
HOST_LIMIT = 0.5
#: Parts of a host when verdicts are joined back: a host with a third of all rows is this many keys.
SALTS = 64
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A rule's column of each document, and its rate's of each host.
RULES = {"base_failed": "host_rate", "length_failed": "length_rate", "symbols_failed": "symbols_rate", "lines_failed": "lines_rate"}
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_IN_WORD = np.ones(256, dtype=np.int64)  # first bytes of characters that are no white space
_IN_WORD[[9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)]] = 0


def _per_text(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(weights) + 1, dtype=np.int64)
    np.cumsum(weights, out=total[1:])
    return np.diff(total[bounds])


def repeated_words(hashes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Words of each text that stand in a window of ``width`` words that the text has twice or more."""
    starts = run_starts(counts, width)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    key = window_hashes(hashes, width)[starts]
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    often = np.zeros(len(key), dtype=bool)
    often[:-1] |= same
    often[1:] |= same
    at = starts[order[often]]
    change = np.bincount(at, minlength=len(hashes) + 1) - np.bincount(at + width, minlength=len(hashes) + 1)
    covered = np.cumsum(change)[: len(hashes)] > 0
    return _per_text(covered, np.concatenate([[0], np.cumsum(counts)]))


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the counts of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bounds, data = utf8(part.column("text"))
                starts, ends, before = words(bounds, data)
                n_words = np.diff(before)
                repeated = repeated_words(word_hashes(data, starts, ends), n_words, WINDOW)
                equal, lines = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    worded = [line for line in data[a:b].tobytes().split(b"\n") if line.strip()]
                    equal.append(len(worded) - len(set(worded)))
                    lines.append(len(worded))
                columns = (n_words, _per_text(_IN_WORD[data], bounds), _per_text(_SYMBOL[data], bounds), equal, repeated, lines)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("host"), *[pa.array(c, pa.int64()) for c in columns]],
                    ["doc_id", "host", *_COUNTS],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col(host).cast("string").alias("host"), "text")
    return narrow.mapInArrow(count, "doc_id bigint, host string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def failures() -> dict[str, Column]:
    """Each rule's verdict of a document, from its counts."""
    n_words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "base_failed": (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words),
        "length_failed": (chars > LONGEST_WORD * n_words) | (chars < SHORTEST_WORD * n_words),
        "symbols_failed": 100 * F.col("n_symbols") > MOST_SYMBOLS * n_words,
        "lines_failed": 100 * F.col("n_dup_lines") > MOST_EQUAL_LINES * F.col("n_lines"),
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """``host`` and each rule's failure rate, shrunk toward the rate of all hosts."""
    counted = [F.count_if(rule).alias(rule) for rule in RULES]
    hosts = materialise(judged.filter("host is not null").groupBy("host").agg(F.count("*").alias("documents"), *counted))
    raw = {rule: F.col(rule) / F.col("documents") for rule in RULES}
    # A host's own rate varies by p (1 - p) / n even where all hosts are alike; the rest is the prior's variance.
    found = hosts.agg(
        F.avg(1 / F.col("documents")).alias("inverse"),
        *[use(raw[rule]).alias(f"{name}_{rule}") for rule in RULES for name, use in (("mean", F.avg), ("variance", F.var_samp))],
    ).first()
    rates = {}
    for rule, rate in RULES.items():
        mean = min(max(found[f"mean_{rule}"] or 0.0, 1e-6), 1 - 1e-6)
        noise = mean * (1 - mean) * (found.inverse or 0.0)
        between = max((found[f"variance_{rule}"] or 0.0) - noise, 1e-6)
        strength = max(mean * (1 - mean) / between - 1, 1e-3)
        rates[rate] = (F.col(rule) + mean * strength) / (F.col("documents") + strength)
    return hosts.select("host", *[column.alias(name) for name, column in rates.items()])


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: counts, verdicts of the rules, the host's rates (null without a host) and ``kept``."""
    judged = materialise(rule_counts(docs, host).withColumns(failures()))
    rates = list(RULES.values())
    verdicts = host_rates(judged).select(
        F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), *rates
    )
    salted = judged.withColumn("_part", F.pmod(F.xxhash64("doc_id", *_COUNTS), F.lit(SALTS)).cast("int"))
    joined = salted.join(verdicts, (F.col("host") == F.col("_host")) & (F.col("_part") == F.col("_salt")), "left")
    worst = F.coalesce(F.greatest(*rates), F.lit(0.0))
    return joined.select("doc_id", "host", *_COUNTS, *RULES, *rates, (~F.col("base_failed") & (worst <= host_limit)).alias("kept"))
