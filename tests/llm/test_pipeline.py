"""The pipeline stage by stage against plain versions of what each decides."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import components_by_hand, removed_by_hand, rows_of, targets_by_hand, words_of
from traceaudit.llm.queries import tokenizer_path
from traceaudit.llm.tokenizer import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark):
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
    return found


def test_stage_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in stages[0].schema]


def test_classifier_keeps_good_and_rejects_bad(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = ([d for d, q in labels.items() if q == k] for k in (1, 0))
    assert np.mean([d in kept for d in good]) > 0.95
    assert np.mean([d in kept for d in bad]) < 0.2


def test_one_document_of_each_group_stays(stages):
    groups = components_by_hand(rows_of(stages[1]), 80, width=5)
    assert {r.doc_id for r in stages[2].collect()} == {c for _, c in groups.values()}


def test_scattered_changes_make_a_near_duplicate(spark):
    """Four of 200 words changed leave 176 of 216 5-word n-grams in common (0.81); five changes leave 0.77."""
    words = [f"w{k}" for k in range(200)]
    copies = [" ".join(f"c{k}" if k in changed else w for k, w in enumerate(words)) for changed in ((), (20, 60, 100, 140), (10, 50, 90, 130, 170))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(copies)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {0, 2}


def test_repeated_passages_go(stages):
    want = removed_by_hand(rows_of(stages[2]), 20)
    before = dict(rows_of(stages[2]))
    for doc, text in rows_of(stages[3]):
        n_words, removed, _ = want[doc]
        assert len(words_of(text)) == n_words - removed
        assert removed or text == before[doc]


def test_mix_reaches_its_targets(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(words_of(r.text))
    for r in stages[4].collect():
        taken[r.source] += len(words_of(r.text))
    assert all(abs(taken[s] - t) <= 1 for s, t in targets_by_hand(sizes).items())


def test_packed_pieces_hold_all_ids(stages):
    bpe = Encoder(tokenizer_path())
    want = sum(len(bpe.encode(r.text or "")) // 4 + 1 for r in stages[4].collect())
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces) == want
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) for p in pieces)


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[5].columns
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    total = lambda rows: sum(r.length for r in rows)
    assert total(out.collect()) == total(stages[5].collect())
    assert {key(r)[0] for r in out.collect()} == {key(r)[0] for r in stages[5].collect()}
    assert re.fullmatch(r"\d+", str(out.count()))


def odd_documents(spark):
    """Null, empty, blank and very long texts, rows that repeat, null ids and sources, and columns named like inner ones."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t", "en", None, 3), (103, "one", "en", "s1", 3)]
    rows += [rows[5], rows[5], rows[7], (None, good[9], "en", "s2", 1), (None, None, None, None, None)]
    rows += [(104, " ".join(good) * 3, "en", "s0", 9), (5, "another text of an id that others have " * 4, "en", "s1", 9)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("target", "_rank", "words", "shard", "quality", "score", "length", "spans", "node"))])


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark).cache()
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF).cache()
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        if name != "mixing to target weights":
            kept = collections.Counter(r.doc_id for r in out.collect())
            assert not kept - collections.Counter(r.doc_id for r in before.collect()), name
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(9))}, name
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    known = [r.doc_id for r in near if r.doc_id is not None]
    assert len(known) == len(set(known)) and sum(r.doc_id is None for r in near) == 2 and {100, 101, 102, 103} <= set(known)
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert len({p.doc_id for p in pieces}) == len({r.doc_id for r in docs.collect()})
    assert sum(p.length for p in pieces if p.doc_id == 100) == 1


def test_stages_take_no_documents(spark):
    none = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
