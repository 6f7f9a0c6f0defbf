"""Byte-level BPE of whole texts by the tokenizers library, each word once.

A text is cut only where the pre-tokenizer cuts as well, so the ids of the parts, put together, are the ids of the
text: before a single space and around a single newline between characters that are no white space, and between the
letters of a word and the punctuation that ends it. A text with any other white space, or with the string of a special
token, is encoded as a whole.

The words of a slice of texts are told apart by 64-bit hashes, the words that a worker has met lie in sorted arrays beside
their ids, and the ids of all texts are gathered at once. Only words not met before go to the library. Two words out of
the ``KNOWN_WORDS`` that a worker holds share a hash with a chance of 3 in 10**8.
"""

from __future__ import annotations

import os
import struct

import numpy as np

from traceaudit.llm.texts import mixed, word_hashes, words

#: Words whose ids a worker holds, and words that it holds as text to put others together from.
KNOWN_WORDS, CACHE_WORDS = 1_000_000, 40_000
#: Newly met words that are held apart before they are merged with the others.
_RECENT_WORDS = 60_000
#: Marks that end words. An apostrophe is none: the pre-tokenizer has its own rule for contractions.
_MARKS = ".,!%&*$#|;:?"
#: Byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: What stands before a word: nothing, a newline, a space.
START, NEWLINE, SPACE = range(3)


class _Words(dict):
    """Word to its ids, as little-endian unsigned 32-bit bytes; ``lead`` stands before each word."""

    def __init__(self, tokenizer, lead: str) -> None:
        self._lead, self._mark = lead, lead.translate(_ALPHABET)
        self._tail: dict[str, bytes] = {}
        self._cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = tokenizer.model.tokenize

    def _ids(self, text: str) -> bytes:
        return b"".join(self._part(part) for part, _ in self._cut(text))

    def _part(self, part: str) -> bytes:
        found = [t.id for t in self._merge(part)]
        return _PACK[len(found)](*found) if len(found) < len(_PACK) else np.array(found, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
            self._tail.clear()
        base = word.rstrip(_MARKS)
        if base and len(base) < len(word) and base.isalpha():
            mark = word[len(base) :]
            if mark not in self._tail:
                self._tail[mark] = self._ids(mark)
            return self[base] + self._tail[mark]
        if word.isalpha():  # letters only are one pre-token
            if word.isascii():  # these stand for themselves in the byte alphabet
                found = self._part(self._mark + word)
            else:
                found = self._part(self._mark + word.encode().decode("latin-1").translate(_ALPHABET))
            self[word] = found
            return found
        return self._ids(self._lead + word)


class _Table:
    """Ascending hashes with the place and number of their ids; ``used`` since the last look."""

    def __init__(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.used = np.zeros(0, dtype=bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and whether it is the key's."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return row, self.keys[row] == keys

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray, used: np.ndarray) -> None:
        place = np.searchsorted(self.keys, keys)
        for name, values in (("keys", keys), ("at", at), ("n", n), ("used", used)):
            kept = getattr(self, name)
            setattr(self, name, np.insert(kept, place, values.astype(kept.dtype)))

    def take(self, rows: np.ndarray) -> None:
        for name in ("keys", "at", "n", "used"):
            setattr(self, name, getattr(self, name)[rows])


def gathered(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n`` entries from ``at`` on, one after the other."""
    return flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class _Known:
    """Ids of words by their hashes: a large table and a small one of those met lately."""

    def __init__(self) -> None:
        self._old, self._new = _Table(), _Table()
        self._ids, self._end = np.zeros(1 << 16, dtype="<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each of ascending keys, and which are known."""
        at, n, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
        for table in (self._old, self._new):
            row, own = table.find(keys)
            at[own], n[own] = table.at[row[own]], table.n[row[own]]
            table.used[row[own]] = True
            known |= own
        return at, n, known

    def add(self, keys: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of new ascending keys: their places and numbers."""
        n = np.array([len(f) for f in found], dtype=np.int64) // 4
        at = self._end + np.cumsum(n) - n
        end = self._end + int(n.sum())
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._end], np.zeros(max(end - self._end, end >> 2, 1 << 16), dtype="<u4")])
        self._ids[self._end : end] = np.frombuffer(b"".join(found), dtype="<u4")
        self._end = end
        self._new.add(keys, at, n, np.ones(len(keys), dtype=bool))
        return at, n

    def settle(self) -> None:
        """Merge new words with the others; of too many, those not used since the last time are forgotten, or each second one."""
        if len(self._new.keys) <= _RECENT_WORDS:
            return
        self._old.add(self._new.keys, self._new.at, self._new.n, self._new.used)
        self._new = _Table()
        if len(self._old.keys) > KNOWN_WORDS:
            rows = np.flatnonzero(self._old.used)
            self._old.take(rows if len(rows) <= KNOWN_WORDS // 2 else rows[::2])
            n = self._old.n.astype(np.int64)
            self._ids = gathered(self._ids, self._old.at.astype(np.int64), n)
            self._end = len(self._ids)
            self._old.at = (np.cumsum(n) - n).astype(np.uint32)
            self._old.used[:] = False

    def ids(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return gathered(self._ids, at, n)


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space that is no ASCII white space, in UTF-8, and of the ASCII separators that Python splits at."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F)))
    a, b, c = (np.append(data, [0, 0])[lead + k] for k in range(3))
    general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    latin = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    single = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[(a < 0x80) | general | latin | single]


class Encoder:
    """Made once in each Python worker. ``escape_special``: strings of special tokens are ordinary text."""

    def __init__(self, path: str, escape_special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = escape_special
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._first, self._next = _Words(self._tokenizer, ""), _Words(self._tokenizer, " ")
        self._newline = self._first._ids("\n")
        self._known = _Known()

    def _whole(self, text: bytes) -> bytes:
        found = self._tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0]
        return np.array(found.ids, dtype="<u4").tobytes()

    def _word(self, word: str, kind: int) -> bytes:
        if kind == SPACE:
            return self._next[word]
        return self._first[word] if kind == START else self._newline + self._first[word]

    def _regular(self, bounds: np.ndarray, data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which texts have nothing but single spaces and newlines between words, and no special token."""
        blank = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data == 32) | (data == 10), out=blank[1:])
        other = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data >= 9) & (data <= 13) & (data != 10), out=other[1:])
        fine = (np.diff(blank[bounds]) == np.diff(before) - 1) & (np.diff(other[bounds]) == 0)
        odd = _odd_space(data).tolist()
        raw = data.tobytes()
        for special in self._special:
            at = raw.find(special)
            while at >= 0:
                odd.append(at)
                at = raw.find(special, at + 1)
        if odd:
            fine[np.searchsorted(bounds, np.array(odd), side="right") - 1] = False
        return fine

    def encode_texts(self, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand one after the other, as unsigned 32-bit numbers, and how many each has."""
        starts, ends, before = words(bounds, data)
        fine = self._regular(bounds, data, before)
        text = np.repeat(np.arange(len(fine)), np.diff(before))
        use = fine[text]
        starts, ends, text = starts[use], ends[use], text[use]
        kind = np.where(data[np.maximum(starts - 1, 0)] == 10, NEWLINE, SPACE)
        kind[starts == bounds[text]] = START
        keys, first, word = np.unique(
            mixed(word_hashes(data, starts, ends) + kind.astype(np.uint64)), return_index=True, return_inverse=True
        )
        self._known.settle()
        at, n, known = self._known.find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            raw, rows = data.tobytes(), first[new]
            spans = zip(starts[rows].tolist(), ends[rows].tolist(), kind[rows].tolist())
            at[new], n[new] = self._known.add(keys[new], [self._word(raw[a:b].decode(), k) for a, b, k in spans])
        ids = self._known.ids(at[word], n[word])
        counts = np.bincount(text, n[word], len(fine)).astype(np.int64)
        odd = np.flatnonzero(~fine & (np.diff(bounds) > 0))
        if not len(odd):
            return ids, counts
        whole = [np.frombuffer(self._whole(data[bounds[k] : bounds[k + 1]].tobytes()), dtype="<u4") for k in odd.tolist()]
        sizes = np.array([len(w) for w in whole])
        places = (np.cumsum(counts) - counts)[odd]
        ids = np.insert(ids, np.repeat(places, sizes), np.concatenate(whole))
        counts[odd] = sizes
        return ids, counts

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_texts(np.array([0, len(data)]), data)[0].astype("<u4").tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, escape_special: bool = False) -> Encoder:
    if (path, escape_special) not in _ENCODERS:
        _ENCODERS[path, escape_special] = Encoder(path, escape_special)
    return _ENCODERS[path, escape_special]
