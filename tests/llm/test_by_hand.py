"""Features, boosting steps, scores and file layouts against plain Python."""

import glob
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.test_text_operators import made_texts
from traceaudit.llm import quality, tokenfiles
from traceaudit.llm.queries import tokenizer_path
from traceaudit.llm.store import fresh_folder

LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))


def features_by_hand(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    kinds = (set(range(65, 91)), set(range(48, 58)), set(b"#*$%&<>@^~+=_\\"), {33}, {124}, set(b".,;:?'\"()-"), set(range(0xC0, 256)), {10})
    return [
        math.log1p(len(words)), sum(map(len, words)) / n,
        *[sum(b in kind for b in raw) / size for kind in kinds],
        len(set(words)) / n, len(set(triples)) / max(len(triples), 1), math.log1p(max(map(len, words), default=0)),
        sum(len(w) <= 2 for w in words) / n, sum(w[-1] not in LETTERS for w in words) / n,
        sum(a == b for a, b in itertools.pairwise(words)) / n,
    ]


def test_features_by_hand():
    texts = made_texts(21, 60) + ["A b b b! | <x> #1\n\nÉ é", "\n", "ends with space ", "x" * 5000, "((a)) 12,3 \\ _"]
    found = quality.text_features(pa.array(texts, pa.string()))
    want = np.array([features_by_hand(t) for t in texts])
    assert found.shape == (len(texts), len(quality.FEATURES))
    assert found == pytest.approx(want, rel=1e-6, abs=1e-6)


def leaf(g, h, rows):
    return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)


def gain(g, h, rows):
    return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)


def tree_by_hand(g, h, rows, depth=2):
    """Every cut tried at every node."""
    cuts = [(gain(g, h, rows[:k]) + gain(g, h, rows[k:]) - gain(g, h, rows), -k) for k in range(1, len(rows))]
    best = max(cuts, default=(0, 0))
    if depth and best[0] > 1e-9:
        return tree_by_hand(g, h, rows[: -best[1]], depth - 1) + tree_by_hand(g, h, rows[-best[1] :], depth - 1)
    return [leaf(g, h, rows)] * len(rows)


def test_trees_by_hand():
    draw = np.random.default_rng(3)
    for size in (1, 2, 3, 9, 32):
        g, h = draw.normal(size=size), draw.uniform(0.01, 1, size=size)
        assert quality.shallow_tree(g, h).tolist() == pytest.approx(tree_by_hand(g.tolist(), h.tolist(), list(range(size))))


def test_one_boosting_cycle_and_scores_by_hand():
    draw = random.Random(4)
    x = [[draw.random(), draw.choice([0.0, 0.5, 1.0])] for _ in range(300)]
    y = [int(a + b + draw.gauss(0, 0.3) > 1) for a, b in x]
    model = quality.fit_model(np.array(x, dtype=np.float32), np.array(y), bins=8, rounds=1, pairs=0, rate=0.5)
    total = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    for k in range(2):  # feature after feature
        values = sorted(np.float32(r[k]) for r in x)
        cuts = sorted({float(np.quantile(values, q / 8)) for q in range(1, 8)})
        place = [sum(float(np.float32(r[k])) >= c for c in cuts) for r in x]
        p = [1 / (1 + math.exp(-t)) for t in total]
        g = [sum(y[i] - p[i] for i in range(len(y)) if place[i] == b) for b in range(len(cuts) + 1)]
        h = [sum(p[i] * (1 - p[i]) for i in range(len(y)) if place[i] == b) for b in range(len(cuts) + 1)]
        table = [0.5 * v for v in tree_by_hand(g, h, list(range(len(g))))]
        assert model.tables[k].tolist() == pytest.approx(table)
        total = [t + table[b] for t, b in zip(total, place)]
    want = [1 / (1 + math.exp(-t)) for t in total]
    assert model.score(np.array(x, dtype=np.float32)).tolist() == pytest.approx(want)


def test_scores_are_sums_of_table_entries():
    draw = np.random.default_rng(5)
    x = draw.uniform(size=(500, 4)).astype(np.float32)
    model = quality.fit_model(x, ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.4)).astype(int))
    for row, score in zip(x[:50], model.score(x[:50])):
        place = [sum(row[k] >= c for c in cuts) for k, cuts in enumerate(model.cuts)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, place))
        total += sum(t[place[i], place[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_token_files_can_be_read_in_part(spark):
    """Ids are encoded by dictionary or as deltas, pages are indexed, and a read of lengths leaves the ids alone."""
    texts = [t or "" for t in made_texts(3, 80)[:-2]] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = fresh_folder(spark, "tokens")
    tokenfiles.write_token_files(docs, path, tokenizer_path())
    files = glob.glob(f"{path}/*.parquet")
    assert files
    for name in files:
        footer = pq.ParquetFile(name).metadata
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            assert group.total_byte_size <= 2 * tokenfiles.ROW_GROUP_BYTES
            columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert set(columns) == {"doc_id", "ids", "n_tokens"}
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(columns["ids"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings or "RLE_DICTIONARY" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert all(c.compression == "ZSTD" for c in columns.values())
    lengths = tokenfiles.read_token_files(spark, path).groupBy("file").sum("n_tokens")
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<n_tokens:bigint>", plan)
    one = tokenfiles.read_token_files(spark, path).filter("doc_id = 77").select("ids")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
