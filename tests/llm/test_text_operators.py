"""Operators on texts against plain versions on small tables, with nulls, ties, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceaudit.llm import hosts, jaccard, lm, mixing, packing, quality, substrings, tokenfiles, tokenizer
from traceaudit.llm.queries import tokenizer_path
from traceaudit.llm.store import fresh_folder
from traceaudit.llm.texts import utf8
from traceaudit.llm.tokenizer import Encoder

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, size bigint"


def made_texts(seed: int, count: int) -> list[str | None]:
    """Texts over few words, so passages recur; copies, near copies, empty, null, odd white space and a long one."""
    draw = random.Random(seed)
    words = ["the", "an", "Ünder", "of!", "zwölf", "x###", "y", "Zed.", "É", "7"] + [f"w{k}" for k in range(40)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts: list[str | None] = [None, "", "  \n\t ", "one", "two words", "a b c", "x  y\r\nz\x0b\x0cw", "a\n\na\na b\n"]
    while len(texts) < count - 2:
        kind = draw.randrange(6)
        if kind == 0 and len(texts) > 20:
            texts.append(draw.choice(texts))
        elif kind == 1 and len(texts) > 20:
            copy = (draw.choice(texts) or "a b c").split(" ")
            copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        else:
            own = [draw.choice(words) for _ in range(draw.randrange(1, 120))]
            own[draw.randrange(len(own)) : 0] = passage.split() if kind == 2 else []
            texts.append("\n".join([" ".join(own[:30]), " ".join(own[30:])]))
    return [*texts, " ".join(draw.choice(words) for _ in range(30_000)), texts[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts(5, 160)
    sources = ["a", "b", "hot", "hot", "hot", None, "Ä"]
    rows = [(k, t, "en", sources[k % 7], len(t or ""), "clash", -1) for k, t in enumerate(texts)]
    rows += [(None, "a row without an id " * 9, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None), key=lambda r: r[0])


def words_of(text):
    return re.findall(WORD, text or "")


# Substring dedup


def removed_by_hand(rows, window):
    seen: dict = {}
    for doc, text in rows:
        words = words_of(text)
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), (doc, i))
    out = {}
    for doc, text in rows:
        words = words_of(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [2000, 8 << 20])
def test_substrings_like_by_hand(docs, chunk):
    found = substrings.removal_digest(docs, chunk_bytes=chunk).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found if r.doc_id is not None}
    want = removed_by_hand(rows_of(docs), 20)
    assert got == want
    assert sum(w[1] for w in want.values()) > 500
    assert [r.n_removed for r in found if r.doc_id is None] == [0, 0]
    for row in found:  # spans are maximal
        spans = row.spans or []
        assert sum(s.end - s.start for s in spans) == row.n_removed
        assert all(a.end < b.start for a, b in zip(spans, spans[1:]))


def test_substrings_keep_columns_and_untouched_texts(docs, empty):
    out = substrings.dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    lost = {r.doc_id for r in substrings.removal_digest(docs).collect() if r.n_removed}
    before = dict(rows_of(docs))
    for doc, text in rows_of(out):
        assert doc in lost or text == before[doc]
    assert substrings.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(docs.withColumnRenamed("host", "_spans"))


def test_substrings_repeated_ids_keep_equal_windows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_removed) for r in substrings.removal_digest(rows).collect())
    assert found == [(1, 0), (1, 0), (2, 30)]


# n-gram Jaccard join


def shingles(text, width=3):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(WORD, low)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components_by_hand(rows, percent, width=3):
    sets = {doc: shingles(text, width) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), top(doc)) for doc in sets}


def test_suffix_filter_bounds_the_difference():
    draw, pruned = np.random.default_rng(5), 0
    for _ in range(400):
        base = draw.choice(5000, size=draw.integers(1, 80), replace=False).astype(np.uint64)
        other = np.unique(np.append(base[draw.random(len(base)) < draw.random()], draw.choice(5000, size=draw.integers(0, 30)).astype(np.uint64)))
        x, y = np.sort(base), other
        differ = len(set(x.tolist()) ^ set(y.tolist()))
        for most in (0, 3, 20, 200):
            bound = jaccard.hamming_bound(x, y, most)
            assert bound <= differ
            pruned += bound > most
        assert jaccard.hamming_bound(x, y, 10**6, depth=20) == differ
    assert pruned > 400


def near_copies(count, seed, length=60):
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    out = []
    for k in range(count):
        words = list(base)
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(length)] = f"new{draw.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("percent", "prefixes", "sets"), [(90, 4096, 512), (80, 4096, 512), (80, 8, 16)])
def test_jaccard_like_by_hand(spark, docs, monkeypatch, percent, prefixes, sets):
    monkeypatch.setattr(jaccard, "TILE_PREFIXES", prefixes)
    monkeypatch.setattr(jaccard, "TILE_SETS", sets)
    family = [(1000 + k, t) for k, t in enumerate(near_copies(70, 3) + near_copies(20, 4, 35))]
    more = spark.createDataFrame(family, "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more).repartition(6)
    found = jaccard.near_duplicates(every, percent=percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    want = components_by_hand(rows_of(every), percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 40
    assert {r.component_id for r in found if r.doc_id is None} == {None}


def random_sets(draw, size, percent):
    """Two sets that overlap by about ``percent`` of their union, as ascending hashes."""
    common = draw.integers(0, 1 << 64, size=max(1, size), dtype=np.uint64)
    more = int(size * 100 / percent - size)
    cut = draw.integers(0, more + 1)
    extra = draw.integers(0, 1 << 64, size=more, dtype=np.uint64)
    return np.unique(np.append(common, extra[:cut])), np.unique(np.append(common, extra[cut:]))


@pytest.mark.parametrize(("percent", "differ"), [(90, None), (80, None), (80, 2), (75, 9), (50, 2)])
def test_linked_sets_meet_in_a_segment(monkeypatch, percent, differ):
    if differ:  # many segments, some smaller than what they may differ by
        monkeypatch.setattr(jaccard, "SEGMENT_DIFFER", differ)
    draw, met, linked, segments = np.random.default_rng(percent), 0, 0, 0
    for _ in range(300):
        size = int(2 ** draw.uniform(0, 12))
        sets = random_sets(draw, size, percent)
        counts = np.array([len(s) for s in sets])
        grams = np.concatenate(sets)
        level = (grams % np.uint64(5)).astype(np.uint8)
        doc, key, _, kind, place, cell, sizes, bits = jaccard.prefix_entries(grams, counts, level, np.ones(2, dtype=bool), percent)
        order = np.lexsort((counts[doc], key))
        run = (key[order], counts[doc[order]], sizes[cell[order]], place[order], bits[cell[order]], 4 ** kind[order])
        pairs = [(doc[order[i]], doc[order[j]]) for i, j in jaccard.candidate_pairs(*run, percent) for i, j in zip(i, j)]
        common = len(np.intersect1d(*sets))
        if 100 * common >= percent * (counts.sum() - common):
            linked += 1
            met += any(a != b for a, b in pairs)
            segments += kind.max() > 0
    assert met == linked > 100
    assert segments > 20 or percent == 50


def long_texts(count, length, percent, seed):
    """Long texts without structure that share a passage with the next one; and a copy of each, about as alike as asked."""
    draw = random.Random(seed)
    own = [[f"v{draw.randrange(10**6)}" for _ in range(int(length * 1.06**k))] for k in range(count)]
    for k in range(count - 1):
        own[k + 1][:90] = own[k][-90:]
    copies = []
    for words in own:
        copy = list(words)
        share = (100 - percent) / (100 + percent) / 3 * draw.uniform(0.7, 1.2)
        for at in draw.sample(range(100, len(words) - 100), int(share * len(words))):
            copy[at] = f"other{draw.randrange(10**6)}"
        copies.append(copy)
    return [" ".join(w) for w in own + copies]


@pytest.mark.parametrize("percent", [90, 80])
def test_long_texts_that_share_a_passage_are_no_group(spark, monkeypatch, percent):
    rows = list(enumerate(long_texts(12, 1800, percent, percent)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sizes, components = [], jaccard.connected_components

    def watched(links):
        found = components(links)
        sizes.append(max((r["count"] for r in found.groupBy("component").count().collect()), default=0))
        return found

    monkeypatch.setattr(jaccard, "connected_components", watched)
    # As in a large corpus: slots count so many n-grams that rare ones are not told from those of two texts.
    monkeypatch.setattr(jaccard, "_slot", lambda grams: (grams % np.uint64(64)).astype(np.int64))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, percent=percent).collect()}
    want = components_by_hand(rows, percent)
    assert got == want
    assert 2 < len(rows) - len({c for _, c in want.values()}) < 12
    assert sizes == [2, 2]


def test_sets_of_many_tiles_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 4000)
    texts = [" ".join(f"w{k}_{i}" for i in range(102)) for k in range(3)]
    part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts), pa.array([7, 7, 8]), pa.array([50, 50, 1])], ["doc_id", "text", "component", "tiles"])
    batches = list(jaccard.tiled_sets(part, 3, 16))
    assert max(b.nbytes for b in batches) < 6000
    rows = [r for b in batches for r in b.to_pylist()]
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 50, 2: 50, 3: 1}
    assert {len(r["grams"]) for r in rows} == {800}
    assert len({(r["low"], r["high"]) for r in rows if r["doc_id"] == 1}) == 50


def test_jaccard_keeps_one_of_each_group(docs, empty):
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    leaders = {c for _, c in components_by_hand(rows_of(docs), 90).values()}
    assert sorted(d for d, _ in rows_of(kept)) == sorted(leaders)
    assert kept.filter("doc_id is null").count() == 2
    assert jaccard.near_duplicates(empty).count() == 0


# Tokens


def test_encoder_equals_the_library():
    bpe, plain = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd = ["a  b", "\n\na", "a\n\nb", " x", "x ", "a  b", "a b c", "it's 'tis  don't. x", "x\r\ny", "a\tb", "é.è ,b", "c12,3 <|endoftext|> y"]
    odd += ["", "\n", " ", "a\x1c b", "日本 語。 x", "a.́ b", "x'.' y", "l'été, x", "ñ ÑE!! x3. 3.", "ab-cd e_f"]
    odd += ["<|endoftext|>", "a<|endoftext|>", "x <|endoftext|>\n<|endoftext|> y <|endof", "a\u00a0b", "a \u2003b", "x\u3000y \u1680z \u2028 w\u205f"]
    for text in odd + [t for t in made_texts(8, 60) if t]:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert bpe.encode(text) == want, repr(text)
    assert np.frombuffer(bpe.encode("a <|endoftext|>"), dtype="<u4").tolist()[-1] == 50256
    escaped = Encoder(tokenizer_path(), escape_special=True)
    assert 50256 not in np.frombuffer(escaped.encode("a <|endoftext|>"), dtype="<u4").tolist()


def test_slices_of_texts_equal_the_library(monkeypatch):
    """Many texts at once, words met again and words forgotten in between."""
    monkeypatch.setattr(tokenizer, "KNOWN_WORDS", 400)
    monkeypatch.setattr(tokenizer, "_RECENT_WORDS", 50)
    monkeypatch.setattr(tokenizer, "CACHE_WORDS", 30)
    bpe, plain, draw = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(3)
    pool = [t or "" for seed in range(4) for t in made_texts(seed, 40)[:-2]] + ["a  b", "", " x", "x <|endoftext|>", "a\n"]
    pool += [" ".join(f"w{draw.randrange(3000)}" for _ in range(90)) for _ in range(30)]
    for _ in range(40):
        texts = [draw.choice(pool) for _ in range(draw.randrange(1, 30))]
        ids, counts = bpe.encode_texts(*utf8(pa.array(texts, pa.string())))
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def encoded(docs):
    bpe = Encoder(tokenizer_path())
    return [(d, bpe.encode(t or "") + b"\0\0\0\0") for d, t in rows_of(docs)]


def test_token_files_round_trip(spark, docs, empty):
    path = fresh_folder(spark, "tokens")
    known = docs.filter("doc_id is not null")
    tokenfiles.write_token_files(known, path, tokenizer_path())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_spans(spark, path).collect())
    want, at = [], 0
    for doc, ids in encoded(docs):
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    order = [r.doc_id for r in tokenfiles.read_token_files(spark, path).orderBy("file", "row").collect()]
    assert order == sorted(order)
    nothing = fresh_folder(spark, "tokens")
    tokenfiles.write_token_files(empty, nothing, tokenizer_path())
    assert tokenfiles.token_spans(spark, nothing).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "x"), (3, "b"), (3, "a b"), (3, "b"), (1, None)], "doc_id bigint, text string")
    path = fresh_folder(spark, "tokens")
    tokenfiles.write_token_files(rows, path, tokenizer_path())
    found = tokenfiles.token_spans(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 3, 3, 3]
    assert [r.start for r in found] == list(np.cumsum([0] + [r.n_tokens for r in found])[:-1])


@pytest.mark.parametrize("window", [1500, 1 << 20])
def test_packing_uses_every_id_once(docs, empty, window):
    pieces = packing.pack(docs, tokenizer_path(), window_tokens=window).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.array(p.ids, dtype="<u4").tobytes()
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(ids)
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.start, ids, p.doc_tokens))
    for doc, ids in encoded(docs):
        found = sorted(documents[doc])
        assert b"".join(x for _, x, _ in found) == ids and {n for _, _, n in found} == {len(ids) // 4}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_balance_fills_sequences_with_even_costs():
    draw = random.Random(2)
    lengths = [draw.randrange(1, 1024) for _ in range(500)]
    pieces = packing.balance(lengths, 1024)
    assert len({k for *_, k, _ in pieces}) == -(-sum(lengths) // 1024)
    whole = [0] * len(lengths)
    for doc, at, n, _, _ in sorted(pieces):
        assert at == whole[doc]
        whole[doc] += n
    assert whole == lengths


# Mixing


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else weight[s] * level
        rest -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


def test_mix_takes_its_targets(docs, empty):
    found = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    want, taken = targets_by_hand(sizes), collections.Counter()
    assert len(found) == docs.count()
    for r in found:
        words = [t.words for t in r._takes]
        assert r._size == len(words_of(r.text)) and r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source]) and max(words, default=0) <= r._size and len(words) <= 3
        taken[r.source] += sum(words)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {(r.doc_id, r._size): [tuple(t) for t in r._takes] for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r._size): [tuple(t) for t in r._takes] for r in found}
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumnRenamed("size", "_size"))


def test_mixed_documents_hold_the_words_taken(docs):
    rows = mixing.mixed_documents(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += len(words_of(r.text))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    assert all(abs(taken[s] - t) <= 1 for s, t in targets_by_hand(sizes).items())


CLASHING = (
    "target take block source_size quota ends words key copy shard index _point _slice _start _tie _id _source _s _k _c0 _text _take _rank "
    "_packed n k1 k2 node component component_id doc"
).split()


def test_mix_and_near_duplicates_keep_columns_of_any_name(spark, docs):
    rows = docs.select("doc_id", "text", "source")
    more = rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    for keep in (mixing.mixed_documents, jaccard.drop_near_duplicates, lambda d: mixing.mix(d).select(*d.columns, "_size")):
        wide, narrow = keep(more), keep(rows)
        assert wide.columns[: len(more.columns)] == more.columns
        found = [tuple(r) for r in wide.collect()]
        assert {r[3 : 3 + len(CLASHING)] for r in found} == {tuple(range(len(CLASHING)))}
        assert collections.Counter(r[:3] for r in found) == collections.Counter(tuple(r)[:3] for r in narrow.collect())


def test_mix_of_repeated_ids_and_blank_sources(spark):
    """Rows of one id and size are told apart by their texts, so reruns agree; a source without words takes nothing."""
    rows = [(7, f"w{k} x y", "a") for k in range(30)] + [(None, f"v{k} x y", "a") for k in range(5)]
    rows += [(k, "z " * 50, "b") for k in range(100, 120)] + [(200, " ", "c"), (201, None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one, two = ({r.text: [tuple(t) for t in r._takes] for r in mixing.mix(d, shards=4).collect()} for d in (df, df.repartition(7)))
    assert one == two and one[" "] == [] and one[None] == []


def test_blocks_are_permuted_by_key(spark):
    counts = [1, 2, 3, 5, 17, 331, 662, 4681, 5000]
    df = spark.createDataFrame([(c, k) for c in counts for k in range(c)], "n bigint, k bigint")
    at = mixing.permuted(F.col("k"), F.col("n"), F.lit(9), F.lit("src"))
    other = mixing.permuted(F.col("k"), F.col("n"), F.lit(9), F.lit("more"))
    found = df.select("n", "k", at.alias("p"), other.alias("q")).orderBy("n", "k").collect()
    for c in counts:
        p, q = ([getattr(r, x) for r in found if r.n == c] for x in "pq")
        assert sorted(p) == sorted(q) == list(range(c))
        if c > 300:  # neighbours part, and keys give other permutations
            assert np.mean(np.abs(np.diff(p)) < c / 20) < 0.2 and np.mean(np.array(p) == np.array(q)) < 0.05


def test_bisection_counts_ends(spark):
    ends = [0, 0, 3, 3, 7, 9, 9, 12]
    for size in (1, 2, 5, 8):
        df = spark.range(14).select(mixing.place_in(F.array(*[F.lit(e).cast("bigint") for e in ends[:size]]), F.col("id")).alias("p"), "id")
        assert all(r.p == sum(e <= r.id for e in ends[:size]) for r in df.collect())


def test_shards_follow_the_words(docs, monkeypatch):
    words = sum(len(words_of(r.text)) for r in docs.collect())
    for per_shard, want in ((words, 1), (words // 3, 4), (words // 30, 32)):
        monkeypatch.setattr(mixing, "WORDS_PER_SHARD", per_shard)
        found = {t.shard for r in mixing.mix(docs).collect() for t in r._takes}
        assert max(found) < want and len(found) > want / 2


def test_split_quotas_add_up_and_follow_the_distribution(spark):
    quotas = [0, 7, 300, 41]
    row = spark.createDataFrame([(quotas,)], "quota array<bigint>")
    shards = mixing.split_quotas(row, 8).collect()
    assert [sum(x) for x in zip(*[r.quota for r in shards])] == quotas
    totals = [sum(r.quota) for r in shards]
    assert max(totals) - min(totals) <= 3 and len(shards) == 8
    drawn = [sum(r.quota[2] for r in mixing.split_quotas(row, 2, seed=s).collect() if r.shard == 0) for s in range(12)]
    assert abs(np.mean(drawn) - 150) < 8 and len(set(drawn)) > 3


# Host rules


def counts_by_hand(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    often = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(often)


def test_host_counts_and_verdicts(spark, docs, empty):
    junk = [(5000 + k, "bad", "x") for k in range(60)]
    fine = [(6000 + k, "good", " ".join(f"{k}w{j}" for j in range(40))) for k in range(60)] + [(7000, "bad", " ".join(f"q{j}" for j in range(40)))]
    more = spark.createDataFrame(junk + fine, "doc_id bigint, source string, text string")
    every = docs.select("doc_id", "source", "text").unionByName(more)
    found = hosts.judge(every).collect()
    texts = {r.doc_id: r.text for r in every.collect()}
    assert len(found) == every.count()
    for r in found:
        if r.doc_id is not None:
            want = counts_by_hand(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert r.host == "bad" or r.kept == (not r.base_failed)
    kept = {r.doc_id: r.kept for r in found}
    assert not kept[7000] and kept[6000]  # a clean page of a bad host goes
    assert hosts.judge(empty).count() == 0


BAD_PAGES = {
    "length_failed": lambda k: " ".join(f"{'x' * 20}{k}y{j}" for j in range(30)),
    "symbols_failed": lambda k: " ".join(f"a{k}b{j}#$" for j in range(30)),
    "lines_failed": lambda k: "\n".join("menu" if j % 2 else " ".join(f"w{k}l{j}x{i}" for i in range(6)) for j in range(20)),
}


@pytest.mark.parametrize("rule", sorted(BAD_PAGES))
def test_a_host_goes_by_any_rule_and_its_neighbours_stay(spark, rule):
    fine = lambda k: "\n".join(" ".join(f"word{k}x{i}y{j}" for j in range(8)) for i in range(5))
    rows = [(100 * h + k, f"h{h}", fine(100 * h + k)) for h in range(12) for k in range(20)]
    rows += [(5000 + k, "bad", BAD_PAGES[rule](k)) for k in range(20)] + [(5100, "bad", fine(1)), (5200, "h3", BAD_PAGES[rule](99)), (5300, None, BAD_PAGES[rule](98))]
    found = {r.doc_id: r for r in hosts.judge(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert not any(r.base_failed for r in found.values())
    assert all(found[5000 + k][rule] for k in range(20)) and found[5200][rule] and not found[5100][rule]
    gone = {d for d, r in found.items() if not r.kept}
    assert gone == {5100, *range(5000, 5020)}  # all of the bad host, none of its neighbours, none without a host


# Classifier


def test_classifier_learns_and_scores_all(spark, empty):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8)))
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = " ".join(word() if good else word() + "%%%" for _ in range(40)) if k % 2 else (" ".join(word() for _ in range(30)) if good else "SPAM!! BUY!! " * 15)
        rows.append((k, text, "x"))
        labels.append((k, int(good), 0))
    rows += [(900, None, "x"), (901, "", "x"), (None, "no id here", "x"), (902, "word " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (901, None, None)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert len(found) == len(rows)
    held = [k for k, *_ in labels if found[k].held_out]
    assert held == [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k].predicted == labels[k][1]) for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.predicted}
    none = quality.classify(docs, marks.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.classify(empty, marks).count() == 0


def test_pairs_learn_what_single_features_cannot():
    draw = np.random.default_rng(3)
    x = draw.uniform(size=(4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit_model(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


# Language models


def losses_by_hand(texts, target, entries, weight=0.7, uniform=0.1):
    """(target loss, background loss) of each (doc, words): models of bigrams without the document's own counts."""

    def counted(some):
        pairs = collections.Counter(p for t in some for p in zip(["<s>", *t], t))
        after, single = collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            after[a] += n
            single[b] += n
        return pairs, after, single

    models = [counted([t for d, t in texts if inside(d)]) for inside in (lambda d: d in target, lambda d: True)]
    out = []
    for doc, words in texts:
        own, means = counted([words]), []
        for model, holds in zip(models, (doc in target, True)):
            pairs, after, single = (collections.Counter(m) for m in model)
            if holds:
                for left, mine in zip((pairs, after, single), own):
                    left.subtract(mine)
            total = sum(single.values())
            chance = [
                weight * pairs[p] / max(after[p[0]], 1) + (1 - weight) * ((1 - uniform) * single[p[1]] / max(total, 1) + uniform / entries)
                for p in zip(["<s>", *words], words)
            ]
            means.append(-np.mean(np.log(chance)) if words else None)
        out.append(means)
    return out


def test_losses_like_by_hand(spark, docs, empty):
    size = 12
    good = spark.createDataFrame([(k,) for k in range(20, 60)] + [(None,)], "doc_id bigint")
    rows = docs.filter("doc_id is not null")
    found = {r.doc_id: r for r in lm.score(rows, good, vocabulary=size).collect()}
    low = {k: k + 32 for k in range(65, 91)}
    texts = [(r.doc_id, re.findall(WORD, (r.text or "").translate(low))) for r in rows.collect()]
    vocabulary = {w for w, _ in collections.Counter(w for _, t in texts for w in t).most_common(size - 2)}
    known = [(d, [w if w in vocabulary else None for w in t]) for d, t in texts]
    for (doc, words), want in zip(known, losses_by_hand(known, set(range(20, 60)), size - 1)):
        if words:
            assert [found[doc].target_loss, found[doc].background_loss] == pytest.approx(want, abs=1e-4)
        else:
            assert found[doc].score is None
    assert lm.score(empty, good).count() == 0


def test_every_word_has_its_own_entry(spark, monkeypatch):
    """Texts that differ from the target in rare topic words alone score differently, as by hand, over many chunks."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    common = [f"c{k}" for k in range(3000)] * 2
    rows = [(k, " ".join(common[k * 40 : k * 40 + 40])) for k in range(150)]
    rows += [(1000, "apple pear plum fig"), (1001, "apple pear plum fig"), (1002, "iron zinc tin lead"), (None, "Apple zinc"), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in lm.score(docs, spark.createDataFrame([(1000,), (3,)], "doc_id bigint")).collect()}
    texts = [(d, (t or "").lower().split()) for d, t in rows]
    for (doc, words), want in zip(texts, losses_by_hand(texts, {1000, 3}, sum(len(t) for _, t in texts))):
        if words:
            assert [found[doc].target_loss, found[doc].background_loss] == pytest.approx(want, abs=1e-9)
    assert len(found) == len(rows) and found[1003].score is None
    assert found[1001].score < found[1002].score - 1


def test_models_have_not_seen_what_they_score(spark):
    """A text of the target that nothing else resembles scores like its equal outside the target, and copies are expected."""
    draw = random.Random(6)
    texts = [" ".join(f"u{draw.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rows = [*enumerate(texts), (100, texts[7]), (101, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in lm.score(docs, spark.createDataFrame([(k,) for k in range(7)], "doc_id bigint")).collect()}
    alone = [found[k].background_loss for k in range(40) if k not in (7, 8)]
    twice = [found[k].background_loss for k in (7, 8, 100, 101)]
    assert max(twice) < min(alone) - 2
    inside, outside = [found[k].score for k in range(7)], [found[k].score for k in range(9, 40)]
    assert abs(np.mean(inside) - np.mean(outside)) < 0.1


def test_smoothing_does_not_depend_on_the_size_of_a_corpus(spark):
    """Words that neither model has seen cost both the same, however small the target is."""
    rows = [(k, f"a b c d e f g h n{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lm.score(docs, spark.createDataFrame([(1,), (2,)], "doc_id bigint"), weight=0.0).filter("doc_id > 2").collect()
    assert all(abs(r.score) < 0.05 for r in found)
