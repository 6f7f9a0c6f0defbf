"""Text functions and parsers against hand-computed values and plain-Python references."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from traceaudit.functions import hashing as H
from traceaudit.functions import parsing as A
from traceaudit.functions import text as S


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").repartition(2)


def evaluate(df, expr):
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


SAMPLES = [
    "Straße  ﬁne X", "  Mixed\tCASE\n\nlines ", "", "ΑΣ ας", "Ｆｕｌｌ　ｗｉｄｔｈ", "plain ascii", "a b\u0085c", "\x1cfoo\x1fbar",
]


def test_norm_key(spark):
    want = [" ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in SAMPLES]
    assert evaluate(column(spark, SAMPLES), S.norm_key("c")) == want


def test_fold_key(spark):
    want = [" ".join(t.casefold().split()) for t in SAMPLES]
    assert evaluate(column(spark, SAMPLES), S.fold_key("c")) == want


def test_quality_tokens(spark):
    got = evaluate(column(spark, ["你好, Paris!", "It's über-cool 3x", "_a_b"]), S.quality_tokens("c"))
    assert got[0] == ["你", "好", ",", "paris", "!"]
    assert got[1] == ["it's", "über-cool", "3x"]
    assert got[2] == ["_", "a", "_", "b"]


def test_rouge(spark):
    rows = spark.createDataFrame([("a b c", "a b c"), ("a c", "a b c"), ("", ""), ("", "x"), ("x", "y")], "a string, b string")
    got = [r["v"] for r in rows.select(S.rouge_l("a", "b").alias("v")).collect()]
    assert got == pytest.approx([1.0, 0.8, 1.0, 0.0, 0.0])


def test_rouge_random(spark):
    rng = random.Random(5)
    pairs = [tuple(" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(2)) for _ in range(200)]

    def slow(a, b):
        a, b = a.split(), b.split()
        if not a or not b:
            return 1.0 if a == b else 0.0
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        lcs = table[-1][-1]
        return 0.0 if lcs == 0 else 2 * (lcs / len(a)) * (lcs / len(b)) / (lcs / len(a) + lcs / len(b))

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["v"] for r in df.select("i", S.rouge_l("a", "b").alias("v")).orderBy("i").collect()]
    assert got == pytest.approx([slow(*p) for p in pairs])


def test_rep_n(spark):
    tokens = column(spark, ["a b a b", "x", ""]).withColumn("t", S.ws_tokens("c"))
    assert evaluate(tokens, S.rep_n("t", 2)) == [pytest.approx(1 / 3), None, None]


def test_ngrams(spark):
    tokens = column(spark, ["a b c", "a"]).withColumn("t", S.ws_tokens("c"))
    assert evaluate(tokens, S.ngrams("t", 2)) == [[["a", "b"], ["b", "c"]], []]


def test_interval(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 6.0), (2, 15.0)], "i int, c double")
    got = evaluate(df, S.interval_distance(F.col("c"), F.lit(8.0), F.lit(12.0)))
    assert [(g["position"], g["distance"]) for g in got] == [("inside", 0.0), ("below", 2.0), ("above", 3.0)]


def test_phrases(spark):
    text = "The Great Wall of China because concepts matters greatly when THE Great Wall falls. This domain"
    pattern = [r"\b[A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+){0,4}\b", r"\b[a-z][a-z0-9\-]{4,}(?:\s+[a-z][a-z0-9\-]{4,}){0,3}\b"]
    want = []
    for p in pattern:
        for m in re.finditer(p, text):
            phrase = " ".join(m.group(0).split())
            if len(phrase) >= 4 and phrase.lower() not in S.PHRASE_STOP_WORDS and phrase not in want:
                want.append(phrase)
    assert evaluate(column(spark, [text]), S.phrases("c"))[0] == want
    assert evaluate(column(spark, [text]), S.phrases("c", 2))[0] == want[:2]


def test_sentences(spark):
    text = "One two three four five six. Short one! Is this a sentence of more words?\nNext line without end"
    df = column(spark, [text])
    assert evaluate(df, S.sentences("c"))[0] == [
        "One two three four five six.", "Short one!", "Is this a sentence of more words?", "Next line without end",
    ]
    assert evaluate(df, S.sentence_chunks("c", 1))[0] == ["One two three four five six."]


def test_word_choice(spark):
    df = column(spark, ["I pick Straße now", "alphabet", "Beta, alpha"])
    choices = F.array(F.lit("alpha"), F.lit("beta"), F.lit("STRASSE"))
    assert evaluate(df, S.word_choice("c", choices)) == ["STRASSE", None, "alpha"]


def test_render(spark):
    df = column(spark, ["{x} {prompt}"])
    assert evaluate(df, S.render("Q: {prompt}! {other}", prompt="c")) == ["Q: {x} {prompt}! {other}"]


NUMBERS = {
    "The answer is 1,234.50 units": "1234.5",
    "#### 42\nfinal answer: -7": "-7",
    "total 12 then 3": "3",
    "final answer = $ 1,000": "1000",
    "-000.000": "0",
    "answer: +05.10": "5.1",
    "no digits": None,
    "answer 3 #### 8": "8",
    "1" * 10000: "1" * 10000,
    "٣٤": "34",
    "0.50.": "0.5",
}


def test_parse_number(spark):
    got = evaluate(column(spark, list(NUMBERS)), A.parse_number("c"))
    assert [g["normalized"] for g in got] == list(NUMBERS.values())
    assert [g["status"] for g in got] == ["success" if v is not None else "failed" for v in NUMBERS.values()]


CHOICES = {
    "Final answer: (b)": "B",
    "Answer: A\nSo the answer is C": "C",
    "(d).": "D",
    "I think\nmaybe C here": "C",
    "A or B": None,
    "": None,
    "answer: A. Therefore option B": "B",
}


def test_parse_choice(spark):
    got = evaluate(column(spark, list(CHOICES)), A.parse_choice("c", ["A", "B", "C", "D"]))
    assert [g["normalized"] for g in got] == list(CHOICES.values())


def test_parse_label(spark):
    texts = ["Final answer: Hawkish", "dovish or neutral", "label: 'dovish' then neutral", "none", None]
    got = evaluate(column(spark, texts), A.parse_label("c", ["dovish", "hawkish", "neutral"]))
    assert [g["normalized"] for g in got] == ["hawkish", "neutral", "dovish", None, None]
    aliased = evaluate(column(spark, ["yep", "direct regulator", "DIRECT_REGULATOR"]), A.parse_label("c", ["yes", "DIRECT-REGULATOR"], {"yep": "yes", "direct regulator": "direct-regulator", "DIRECT_REGULATOR": "direct-regulator"}))
    assert [g["normalized"] for g in aliased] == ["yes", "direct-regulator", "direct-regulator"]


def test_parse_code(spark):
    texts = ["```python\nx = 1\n```\ntext ```\ny = 2\n```", "  plain()  \n", "   ", "``` ```"]
    got = evaluate(column(spark, texts), A.parse_code("c"))
    assert [g["normalized"] for g in got] == ["y = 2", "  plain()", None, None]


def test_json_answers(spark):
    texts = [
        '{"answer": "x", "sentence": "s"}', 'say {"answer": "y"} ok', "nope", "", '{"answer": " unknown "}', '{"a": 1}', "[1, 2]", 'a } b { c',
    ]
    got = evaluate(column(spark, texts), A.clean_answer("c"))
    assert [g["reason"] for g in got] == [
        "kept", "kept", "json_parse_failed", "empty_response", "rejected_or_unsure", "rejected_or_unsure", "json_parse_failed", "json_parse_failed",
    ]
    assert got[0]["supporting_sentence"] == "s" and got[1]["response"] == "y"


def test_probe_choice(spark):
    texts = ["b", "(C).", "You are a test", "The final answer is [D] maybe", "Answer: A then choice B", None]
    assert evaluate(column(spark, texts), A.probe_choice("c")) == ["B", "C", None, "D", "B", None]


def test_typed_equality(spark):
    rows = spark.createDataFrame(
        [("1", "1.0"), ("1", '"1"'), ("true", "1"), ('"a"', '"a"'), ("2", "3")], "a string, b string"
    ).select(H.typed_eq(F.parse_json("a"), F.parse_json("b")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [True, False, False, True, False]


def test_prompt_signature(spark):
    rows = spark.createDataFrame([("h", None), (None, '[["q", {"b": 1, "a": 2}]]'), ("", "[1]")], "h string, a string")
    got = [r["v"] for r in rows.select(H.prompt_signature("h", "a").alias("v")).collect()]
    assert got[0] == "lm-eval:h"
    assert got[1] == "arguments-sha256:" + H.stable_hash([["q", {"a": 2, "b": 1}]])


def test_ordered_hash_needs_order_only(spark):
    rows = spark.range(1000).withColumn("t", F.concat(F.lit("t"), F.col("id").cast("string")))
    a = H.ordered_hash(rows, "id", ["id", "t"], block=16).first()
    b = H.ordered_hash(rows.repartition(7, "t"), "id", ["id", "t"], block=16).first()
    c = H.ordered_hash(rows.withColumn("t", F.when(F.col("id") == 500, "x").otherwise(F.col("t"))), "id", ["id", "t"], block=16).first()
    assert a == b and a["ordering_hash"] != c["ordering_hash"] and a["row_count"] == 1000
