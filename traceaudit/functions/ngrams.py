"""Repeated n-grams of token arrays for several n at once.

Tokens become numbers once per batch. The id of an n-gram is the number of a pair of ids of two shorter ones that meet in
it, so each further n costs one pass over integers, whatever the length of tokens and of n-grams. Ids are numbers of equal
pairs, not hashes: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Tokens that are numbered together, or one text.
SLICE_TOKENS = 1 << 17


class GramIds:
    """Ids of the n-grams that begin at each token, of one text each if ``apart``. Beyond the end of a text they mean nothing."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, apart: bool = True) -> None:
        self._text = np.repeat(np.arange(len(lengths)), lengths)
        self._left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        self._texts = len(lengths)
        self._found = {1: self._number(self._text, codes) if apart else codes}

    @staticmethod
    def _number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
        return np.unique(pair, return_inverse=True)[1]

    def of(self, n: int) -> np.ndarray:
        """Ids for all tokens that at least n - 1 others of their text follow, numbers without meaning for the others."""
        if n not in self._found:
            front = 1 << (n - 1).bit_length() - 1
            a, b = self.of(front), self.of(n - front)
            shifted = np.zeros_like(b)
            shifted[: len(b) - front] = b[front:]
            self._found[n] = self._number(a, np.where(self._left >= n, shifted, 0))
        return self._found[n]

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct n-gram begins first, and how often it is met."""
        whole = np.flatnonzero(self._left >= n)
        _, first, counts = np.unique(self.of(n)[whole], return_index=True, return_counts=True)
        return whole[first], counts

    def repeated_shares(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """1 - distinct / all n-grams of each text, and which texts have none."""
        whole = self._left >= n
        ids, first = np.unique(self.of(n)[whole], return_index=True)
        text = self._text[whole]
        distinct, every = np.bincount(text[first], minlength=self._texts), np.bincount(text, minlength=self._texts)
        return 1.0 - distinct / np.maximum(every, 1), every == 0


def _parts(tokens: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First token and text of parts of bounded size, with the codes of their tokens and the lengths of their texts."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = tokens.flatten()
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        start = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, start + SLICE_TOKENS, side="right")))
        codes = values.slice(start, int(ends[to - 1]) - start).dictionary_encode().indices
        yield start, at, pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, lengths[at:to]
        at = to


def gram_counts(tokens: pa.Array, n: int) -> Iterator[pa.RecordBatch]:
    """``ngram``, its tokens joined by a blank, and ``n``, how often parts of the arrays hold it."""
    values = tokens.flatten()
    for start, _, codes, lengths in _parts(tokens):
        first, counts = GramIds(codes, lengths, apart=False).counts(n)
        words = [values.take(pa.array(start + first + k)) for k in range(n)]
        texts = pc.binary_join_element_wise(*words, " ", null_handling="skip")
        yield pa.RecordBatch.from_arrays([texts, pa.array(counts, pa.int64())], ["ngram", "n"])


def _shares(tokens: pa.Array, ns: Sequence[int]) -> pa.Array:
    out: dict[int, list] = {n: [] for n in ns}
    for _, _, codes, lengths in _parts(tokens):
        grams = GramIds(codes, lengths)
        for n in ns:
            share, none = grams.repeated_shares(n)
            out[n].append(pa.array(share, mask=none))
    columns = [pa.concat_arrays(out[n]) if out[n] else pa.array([], pa.float64()) for n in ns]
    return pa.StructArray.from_arrays(columns, [f"r{n}" for n in ns])


def repeated_shares(tokens: Column, ns: Sequence[int]) -> Column:
    """Struct ``r{n}``: share of repeated n-grams of each array, null where there is no n-gram."""
    if not ns or any(n <= 0 for n in ns):
        raise ValueError("ns must hold positive integers")
    ns = sorted(set(ns))

    @arrow_udf(", ".join(f"r{n} double" for n in ns))
    def shares(arrays: pa.Array) -> pa.Array:
        return _shares(arrays, ns)

    return shares(tokens)
