"""Min-max near-dedup, fill-in-the-middle and vector codes against plain versions on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tests.llm.test_text_operators import made_texts
from traceaudit.llm import infill, minmax, vectorcodes

CLASH = "doc_id bigint, text string, node bigint, grp string, tiles int, fresh boolean, data binary, n int, form string, output string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, True, b"", 3, "f", "o") for d, t in rows], CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(made_texts(8, 160)))
    rows += [(None, "a row without an id " * 9), (None, None), (20, rows[21][1]), (20, rows[20][1])]
    return table(spark, rows).repartition(5).cache()


# Min-max hashing


def sets_of(rows, width=2):
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        out.append((doc, grams or ({tuple(words)} if words else set())))
    return out


def classes_by_hand(sets, percent=80):
    """Class of each row: the least id in reach of its set."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (da, a) in enumerate(sets):
        for j, (db, b) in enumerate(sets[:i]):
            if a and b and da is not None and db is not None and 100 * len(a & b) >= percent * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [least.get(top(i)) for i in range(len(sets))]


def near_copies(seed, groups, size, words=60):
    """Groups of texts that differ from a common one in a few words, some pairs just above, some just below 0.8."""
    draw = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(size):
            copy = list(base)
            for at in draw.sample(range(words), draw.randrange(0, 5)):
                copy[at] = f"c{draw.randrange(9)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [None, 3])
def test_classes_like_by_hand(spark, docs, monkeypatch, tile):
    if tile:  # every group of more than three goes to tiles, some with members apart from the hub
        monkeypatch.setattr(minmax, "TILE_SIGNATURES", tile)
        monkeypatch.setattr(minmax, "TILE_SETS", tile)
    copies = near_copies(3, 4, 14)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(copies)]
    sets = sets_of(rows)
    want = sorted((d is None, d or 0, len(s), c or 0) for (d, s), c in zip(sets, classes_by_hand(sets)))
    found = minmax.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)
    assert len({w[3] for w in want}) < len(want) - 40


def test_members_apart_from_the_hub_meet_all_tiles(spark, monkeypatch):
    """A chain: each text is near its neighbours only, so tiles leave most members apart from the hub."""
    monkeypatch.setattr(minmax, "TILE_SIGNATURES", 2)
    monkeypatch.setattr(minmax, "TILE_SETS", 2)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(40)]
    found = {r.doc_id: r.component_id for r in minmax.near_duplicates(table(spark, rows)).collect()}
    assert found == dict.fromkeys(range(40), 0)


def test_min_max_estimates_are_unbiased():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        shared, own = draw.integers(0, 1 << 64, 800, dtype=np.uint64), draw.integers(0, 1 << 64, 200, dtype=np.uint64)
        a, b = np.sort(np.append(shared, own[:100])), np.sort(np.append(shared, own[100:]))
        low, high = minmax.signatures(np.append(a, b), np.array([len(a), len(b)]))
        errors.append(((low[:, 0] == low[:, 1]).mean() + (high[:, 0] == high[:, 1]).mean()) / 2 - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_bands_hold_smallest_or_largest_values():
    low, high = (np.arange(k, k + 8, dtype=np.uint64).reshape(8, 1) for k in (0, 100))
    bands = minmax.band_values(low, high, rows=4)
    assert bands.shape == (1, 4)
    high[5] += np.uint64(1)
    assert (minmax.band_values(low, high, rows=4) == bands).tolist() == [[True, True, True, False]]


def test_no_documents(spark, docs):
    assert minmax.near_duplicates(docs.limit(0)).collect() == []
    blank = minmax.near_duplicates(table(spark, [(1, None), (2, ""), (3, " \n"), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in blank) == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


# Fill-in-the-middle


def cut_by_hand(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if doc_id is None or not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_like_by_hand(spark, docs):
    odd = ["<P", "a<S>b", "<<M>", "x<M", "é" * 50 + "abc", "日本語 text 中 \U0001f600a", "word", "ab" * 40_000, "\x00\x00 a", "<P<S<M" * 30]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + 7 * i + k, t) for i in range(9) for k, t in enumerate(odd)]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted(((d, *cut_by_hand(d, t)) for d, t in rows), key=key)
    cut = infill.transform(table(spark, rows))
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in cut.collect()]
    assert sorted(found, key=key) == want
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    back = sorted(r.text for r in cut.select(infill.restored("output", "form").alias("text")).collect())
    assert back == sorted(t or "" for _, t in rows)


def test_infill_of_no_documents(docs):
    assert infill.transform(docs.limit(0)).count() == 0


def test_wavelet_ranks():
    draw = np.random.default_rng(4)
    for size, bits in ((0, 2), (1, 2), (63, 2), (64, 3), (65, 1), (5000, 3)):
        symbols = draw.integers(0, 1 << bits, size, dtype=np.uint8)
        matrix, at = infill.WaveletMatrix(symbols, bits), np.arange(size + 1)
        for symbol in range(1 << bits):
            assert matrix.rank(symbol, at).tolist() == [0, *np.cumsum(symbols == symbol).tolist()]


# Vector codes

VECTORS = "vec_id bigint, embedding array<float>, label string, id int, v double, code string, error int"


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """Plain Python over (id, vector, label) rows of one length."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[cut[k][p] for k in range(len(cut)) if kept[k][0] is not None][:entries] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in assign()]
    sums = {}
    for r, (_, error) in zip(kept, final):
        sums[r[2]] = sums.get(r[2], 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, code, error, sums[r[2]], digest) for r, (code, error) in zip(kept, final))


def codes_found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 1.0, "c", 1) for r in rows], VECTORS).repartition(3)
    return sorted((r.id is None, r.id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.encode(frame, **options).collect())


def made_vectors(count, length, seed=3):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(count, length)).astype(np.float32) * 0.2
    vectors[count // 3 : count // 2] = vectors[0]  # a vector that many rows share
    vectors[-5:] = np.round(vectors[-5:] * 4) / 4
    return [(k * 3 % count, v.tolist(), [None, "a", "hot", "hot"][k % 4]) for k, v in enumerate(vectors)]


@pytest.mark.parametrize(("count", "length", "entries"), [(200, 16, 256), (400, 8, 32), (90, 4, 7)])
def test_codes_like_by_hand(spark, count, length, entries):
    rows = made_vectors(count, length)
    rows += [(None, rows[5][1], "a"), (7, rows[9][1], "b"), (7, rows[7][1], "b")]
    odd = [(5000, None, "a"), (5001, [], "a"), (5002, [1.0, None] * (length // 2), "a"), (5003, [float("nan")] * length, "a"), (5004, [float("inf")] * length, "a"), (5005, [1.0], "a")]
    assert codes_found(spark, rows + odd, entries=entries) == codes_by_hand(rows, entries=entries)


def test_codes_of_few_far_or_no_vectors(spark):
    assert codes_found(spark, []) == [] and codes_found(spark, [(1, None, "a")]) == []
    (one,) = codes_found(spark, [(1, [0.5, -0.5, 0.25, 1.0], None)])
    assert one[2:5] == ("00000000", 0, 0)
    far = codes_found(spark, [(1, [3e38, -3e38, 0.0, 0.0], "a"), (2, [0.0] * 4, "a"), (3, [0.0] * 4, None)], entries=1)
    assert all(0 <= f[3] <= f[4] or f[3] == f[4] for f in far) and len(far) == 3
    odd = codes_found(spark, [(k, [0.1 * k, 0.2, 0.3, 0.4, 0.5 * k, 0.6], "a") for k in range(9)])
    assert {f[3] for f in odd} == {0} and len(odd) == 9  # six components in four parts


def test_equal_average_search_is_exact():
    draw = np.random.default_rng(2)
    for scale in (1, 30, 1 << 26):  # many ties, usual sizes, sizes beyond exact floats
        x, book = draw.integers(-scale, scale + 1, (700, 6)), draw.integers(-scale, scale + 1, (90, 6))
        book[40:60] = book[:20]
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        codes, errors = vectorcodes.nearest(x, book)
        assert codes.tolist() == far.argmin(axis=1).tolist() and errors.tolist() == far.min(axis=1).tolist()
