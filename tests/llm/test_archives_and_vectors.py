"""Archives, vectors and connected components against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.llm import ann, warc
from traceaudit.llm.components import connected_components
from traceaudit.llm.store import fresh_folder

PAGES = "page_id bigint, url string, html string, file string, start int"


@pytest.fixture(scope="module")
def pages(spark):
    magic = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n\r\n\r\n"
    whole = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 30
    copy = "é" * 600
    html = [None, "", "x", "tail\r\n", "tail\r\n\r", "\r\n\r\n", magic, whole, copy, copy, copy, magic * 9, magic * 9, "y" * 999, "y" * 999, "long " * 200_000, "many\r\nlines\r\n\r\n" * 20_000, "WARC/1.1\r\nContent-Length: 40\r\n" * 5000]
    rows = [(k, f"http://h/{k} \r\n", t, "clash", -1) for k, t in enumerate(html)]
    rows += [(8, None, copy, None, None), (None, "u", copy, None, None), (None, None, "short", None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(3).cache()


@pytest.fixture
def split_bytes(spark, request):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, (request.param, 1)):
        spark.conf.set(name, str(value))
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize(("split_bytes", "compression"), [(32 << 20, "gzip"), (40_000, "none"), (150, "none"), (1500, "gzip")], indirect=["split_bytes"])
def test_archives_round_trip(spark, pages, split_bytes, compression):
    folder = fresh_folder(spark, "archives")
    if split_bytes == 150:  # more splits than header lines: no long page
        pages = pages.filter("html is null or length(html) < 2000")
    warc.write_archives(pages, folder, compression=compression)
    if compression == "none":
        assert warc._lines(spark, folder).select("file", "block").distinct().count() > 8
    records = warc.read_archives(spark, folder, with_payload=True).collect()
    rows = pages.collect()
    largest = {}
    for r in rows:
        payload = (r.html or "").encode()
        if r.page_id is not None:
            largest[payload] = max(largest.get(payload, -1), r.page_id)
    want = collections.Counter()
    for r in rows:
        payload = (r.html or "").encode()
        revisit = len(payload) >= 1000 and largest[payload] != r.page_id
        digest = hashlib.sha1(payload).hexdigest()
        want[r.page_id, len(payload), digest, "revisit" if revisit else "response", largest[payload] if revisit else None] += 1
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    assert got == want and all(r.verified for r in records)
    assert warc.candidates(spark, folder).count() > len(records)  # magic inside payloads
    for r in records:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest


def test_archives_of_no_pages(spark):
    folder = fresh_folder(spark, "archives")
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_pointer_jumping_follows_the_chain_only():
    draw = random.Random(4)
    starts = list(np.cumsum([0] + [draw.randrange(50, 90) for _ in range(700)]))
    chain = list(zip(starts[:-1], starts[1:]))
    false = [(a + 7, draw.choice(starts)) for a, _ in chain[::3]] + [(a + 11, 10**9) for a, _ in chain[::5]]
    both = chain + false
    draw.shuffle(both)
    found = warc.reached(np.array([a for a, _ in both]), np.array([b for _, b in both]))
    assert {p for p, ok in zip(both, found) if ok} == set(chain)
    assert warc.reached(np.array([5]), np.array([9])).tolist() == [False]
    assert warc.reached(np.zeros(0, int), np.zeros(0, int)).tolist() == []


VECTORS = "vec_id bigint, embedding array<float>, label int, rank int, score double"


def nearest_by_hand(rows, asked, k):
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = {}
    for q in asked:
        own = np.flatnonzero(ids == q)[0]
        score = unit @ unit[own]
        order = sorted((-round(s, 12), i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)
        out[q] = [i for _, i in order[:k]]
    return out


def test_neighbours_are_found(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(1200, 16)).astype(np.float32)
    vectors[400:700] = vectors[0]  # a vector that a quarter of all rows share
    rows = [(k, v.tolist(), 0, 1, 0.5) for k, v in enumerate(vectors)]
    odd = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [1.0, None] * 8), (5200, [float("nan")] * 16), (5250, [float("inf")] * 16), (5300, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + [(k, v, 0, 1, 0.5) for k, v in odd], VECTORS)
    found = collections.defaultdict(list)
    for r in sorted(ann.search(table, table.filter("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r["rank"] == len(found[r.query_id]) + 1
        a, b = vectors[r.query_id].astype(float), vectors[r.vec_id].astype(float)
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        found[r.query_id].append(r.vec_id)
    want = nearest_by_hand([r[:2] for r in rows], range(0, 1200, 50), 5)
    assert set(found) == set(want)
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert found[0] == [400, 401, 402, 403, 404] and found[450] == [0, 400, 401, 402, 403]


def test_few_or_no_vectors(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, 0.0), (1, [0.5, 0.5], 0, 0, 0.0), (2, [0.0, 1.0], 0, 0, 0.0)], VECTORS)
    rows = ann.search(three, three.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1), (0, 2, 2)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none).count() == 0


def test_isolated_groups_get_all_neighbours(spark, monkeypatch):
    """Groups of three vectors, each far from all others: lists that hold one group alone do not end a search."""
    monkeypatch.setattr(ann, "PER_LIST", 3)
    draw = np.random.default_rng(5)
    vectors = np.repeat(draw.normal(size=(40, 32)), 3, axis=0) + draw.normal(size=(120, 32)) * 1e-3
    table = spark.createDataFrame([(k, v.astype(np.float32).tolist(), 0, 1, 0.5) for k, v in enumerate(vectors)], VECTORS)
    found = collections.defaultdict(list)
    for r in ann.search(table, table).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert {q: len(set(n)) for q, n in found.items()} == dict.fromkeys(range(120), 5)
    assert all({n // 3 for n in found[q][:2]} == {q // 3} for q in found)


def test_short_queries_are_compared_with_all_rows(spark, monkeypatch):
    """With lists that hold a few vectors each and no list beyond the nearest, the exact pass finds what is missing."""
    monkeypatch.setattr(ann, "PER_LIST", 3)
    monkeypatch.setattr(ann, "LEAST_HELD", 0)
    monkeypatch.setattr(ann, "BLOCK", 16)
    draw = np.random.default_rng(8)
    rows = [(k, v.astype(np.float32).tolist(), 0, 1, 0.5) for k, v in enumerate(draw.normal(size=(90, 8)))]
    table = spark.createDataFrame(rows, VECTORS)
    found = collections.defaultdict(list)
    for r in ann.search(table, table, search_ratio=0.0, replicas=1).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert {q: len(set(n)) for q, n in found.items()} == {k: 5 for k in range(90)}


def test_repeated_ids_crowd_out_nobody(spark):
    """Rows of one id count once among equal vectors and among the k best, whether their vectors are equal or not."""
    alike = [(1, [1.0, 0.001 * k], 0, 0, 0.0) for k in range(7)]
    rows = [(0, [1.0, 0.0], 0, 0, 0.0)] + [(1, [1.0, 0.0], 0, 0, 0.0)] * 6 + alike
    rows += [(k, [1.0, 0.0], 0, 0, 0.0) for k in (2, 3)] + [(k, [1.0, 0.1 * k], 0, 0, 0.0) for k in (4, 5, 6)]
    table = spark.createDataFrame(rows, VECTORS)
    found = ann.search(table, table.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5]


def test_graph_search_meets_all_near_centroids():
    draw = np.random.default_rng(6)
    unit = draw.normal(size=(600, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centroids = ann.fit_centroids(unit, 40)
    sizes = np.bincount(np.argmax(unit @ centroids.T, axis=1), minlength=40)
    assert sizes.max() <= 4 * 600 / 40
    exact = np.sqrt(np.maximum(0, 2 - 2 * unit @ centroids.T))
    far = ann.graph_search(unit, centroids, ann.link_centroids(centroids), 0.2)
    wanted = exact <= exact.min(axis=1, keepdims=True) * 1.2
    assert np.isfinite(far[wanted]).mean() > 0.99


def test_components_of_chains_and_stars(spark):
    draw = random.Random(9)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    nodes = list(range(1000, 1200))
    links += [(draw.choice(nodes), draw.choice(nodes)) for _ in range(150)]
    draw.shuffle(links)
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in links)}
    assert connected_components(frame.limit(0)).count() == 0
