"""Fill-in-the-middle transformation: texts cut in two places between tokens and put together in another order.

Tokens are runs of ASCII letters and single other code points. A slice of texts is one byte array, whose bytes fall in
four classes: rest of a code point, code point that is no letter, first letter of a run, further letter of a run. A
wavelet matrix over the classes answers how many bytes of a class stand before any place. Two of these ranks together
count the tokens begun before a place, three the code points; bisection on the counts finds the place of a cut. So the
cuts of all texts of a slice are found together, whatever the length of a text, and none is ever split into tokens.

Defined results: null and empty texts, texts that hold a marker, and rows without ``doc_id`` stay plain (a null text is
empty). Draws depend on ``doc_id`` alone, so rows that repeat one are cut by the same draws, each in its own text. Texts
of any length are cut whole. An empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.texts import slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those the percent whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1
#: Classes of bytes.
REST, OTHER, FIRST, FURTHER = range(4)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Bits:
    """Bits with the number of ones before every 64th."""

    def __init__(self, ones: np.ndarray) -> None:
        padded = np.zeros((len(ones) // 64 + 1) * 8, dtype=np.uint8)
        packed = np.packbits(ones, bitorder="little")
        padded[: len(packed)] = packed
        self._words = padded.view("<u8")
        self._before = np.zeros(len(self._words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self._words), out=self._before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & below)


class WaveletMatrix:
    """Symbols of a few bits, level by level from the highest bit; each level moves those with a zero to the front."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self._levels = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self._levels.append((bit, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before each place."""
        low, high = np.zeros(1, dtype=np.int64), at
        for bit, ones, zeros in self._levels:
            if symbol >> bit & 1:
                low, high = zeros + ones.rank(low), zeros + ones.rank(high)
            else:
                low, high = low - ones.rank(low), high - ones.rank(high)
        return high - low


class Tokens:
    """Counts of tokens and code points before any byte of texts that stand one after the other."""

    def __init__(self, bounds: np.ndarray, data: np.ndarray) -> None:
        letter = _LETTER[data]
        follows = np.zeros(len(data), dtype=bool)
        follows[1:] = letter[:-1]
        follows[bounds[:-1][bounds[:-1] < len(data)]] = False
        classes = np.where(letter, np.where(follows, FURTHER, FIRST), OTHER).astype(np.uint8)
        classes[data & 0xC0 == 0x80] = REST
        self._matrix = WaveletMatrix(classes, 2)
        self._starts, self._ends = bounds[:-1], bounds[1:]
        self._earlier = self.begun(self._starts)

    def begun(self, at: np.ndarray) -> np.ndarray:
        """Tokens whose first byte stands before each place."""
        return self._matrix.rank(OTHER, at) + self._matrix.rank(FIRST, at)

    def code_points(self, at: np.ndarray) -> np.ndarray:
        return at - self._matrix.rank(REST, at)

    def count(self) -> np.ndarray:
        """Tokens of each text."""
        return self.begun(self._ends) - self._earlier

    def cut(self, after: np.ndarray) -> np.ndarray:
        """In each text the place behind so many tokens."""
        low, high = self._starts.copy(), self._ends.copy()
        wanted = self._earlier + after + 1
        # The least place before which the next token has begun is one behind its first byte.
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.begun(middle) >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(self.begun(low) >= wanted, low - 1, self._ends)


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    found = b"".join(hashlib.sha256(f"{seed}:{d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(found, dtype=">u4").astype(np.int64).reshape(-1, 4)


def transform(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per row of ``docs`` (``doc_id``, ``text``).

    ``n`` counts tokens; ``form`` is plain (the text itself), psm (prefix, suffix, middle, each behind its marker) or
    spm (suffix, prefix, middle); lengths are code points, null if plain. No row is moved.
    """
    p, s, m = (x.encode() for x in markers)
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                bounds, data = utf8(part.column("text"))
                tokens = Tokens(bounds, data)
                n, h = tokens.count(), draws(ids, seed)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                a, b = tokens.cut(np.minimum(one, two)), tokens.cut(np.maximum(one, two))
                chars = [tokens.code_points(at) for at in (bounds[:-1], a, b)]
                forms, outputs, raw = [], [], data.tobytes()
                plain = (h[:, 2] % 100 >= cut_percent) | (n == 0)
                suffix_first = h[:, 3] % 100 < suffix_first_percent
                for k, (start, x, y, end) in enumerate(zip(bounds[:-1].tolist(), a.tolist(), b.tolist(), bounds[1:].tolist())):
                    text = raw[start:end]
                    plain[k] |= ids[k] is None or p in text or s in text or m in text
                    if plain[k]:
                        forms.append("plain")
                        outputs.append(text)
                    elif suffix_first[k]:
                        forms.append("spm")
                        outputs.append(b"".join((s, raw[y:end], p, raw[start:x], m, raw[x:y])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, raw[start:x], s, raw[y:end], m, raw[x:y])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n), pa.array(forms), pa.array(chars[1] - chars[0], mask=plain),
                        pa.array(chars[2] - chars[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


def restored(output: Column | str, form: Column | str, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text of an output: no text that was cut holds a marker, so each marker's first place is its own."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = markers

    def between(start: str, end: str) -> Column:
        at = F.instr(output, start) + F.lit(len(start))
        return F.substr(output, at, F.instr(output, end) - at)

    middle = F.substr(output, F.instr(output, m) + F.lit(len(m)))
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
