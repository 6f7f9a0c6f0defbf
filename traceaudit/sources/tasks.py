"""Benchmark tables of different shapes as one example schema.

Every adapter is a projection: raw columns in, ``EXAMPLE_COLUMNS`` out. Rows
that break a task's rule come back as violations, not as errors in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.hashing import canonical_json
from traceaudit.functions.parsing import (
    CHOICE_PARSER,
    CODE_PARSER,
    LABEL_PARSER,
    NUMBER_PARSER,
    gold_after_marker,
    normalize_label,
    normalize_number,
)
from traceaudit.functions.text import clean_task_text, strip, with_leading_space
from traceaudit.operators import rules
from traceaudit.operators.probes import format_mc

EXAMPLE_COLUMNS = (
    "dataset", "split", "example_index", "example_id", "logical_prompt", "rendered_prompt", "gold_answer",
    "normalized_gold_answer", "parser", "labels", "choice_scoring",
)
# Label sets, id fields and prompt endings.
ID_FIELDS = ("task_id", "id", "idx", "example_id", "question_id")
CHEMPROT_LABELS = (
    "ACTIVATOR", "INHIBITOR", "AGONIST", "ANTAGONIST", "SUBSTRATE", "PRODUCT-OF",
    "SUBSTRATE_PRODUCT-OF", "DIRECT-REGULATOR", "INDIRECT-DOWNREGULATOR",
    "INDIRECT-UPREGULATOR", "UPREGULATOR", "DOWNREGULATOR", "AGONIST-ACTIVATOR",
    "AGONIST-INHIBITOR",
)
YES_NO_MAYBE = ("yes", "no", "maybe")
STANCES = ("dovish", "hawkish", "neutral")
PRICE_SENTIMENTS = ("negative", "neutral", "positive", "none")
SENTIMENTS = ("negative", "neutral", "positive")
GSM8K_ENDING = "\n\nSolve the problem. You may show reasoning, but end with 'Final answer: <NUMBER>'."
PUBMEDQA_ENDING = "\n\nAnswer with exactly one label: yes, no, or maybe.\nFinal answer:"
FOMC_ENDING = "\n\nChoose one stance: dovish, hawkish, or neutral.\nFinal answer:"
HEADLINE_ENDING = "\n\nWhat is the price sentiment? Choose one: negative, neutral, positive, or none.\nFinal answer:"
FPB_ENDING = "\n\nClassify the sentiment as negative, neutral, or positive.\nFinal answer:"

SCORING_TYPE = "struct<prompt:string,labels:array<string>,continuations:array<string>,length_normalize:boolean,metric:string>"


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def alphabet(count: Column) -> Column:
    """The first ``count`` capital letters."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(25)), lambda i: i < count), lambda i: F.char(i + 65))


def example_id(df: DataFrame, dataset: str, split: Column | str = "split") -> Column:
    """First non-blank id field, else a short hash of the whole row; only rows without such a field go to Python."""
    given = [F.when(strip(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in ID_FIELDS if c in df.columns]
    payload = [c for c in df.columns if c not in ("split", "example_index")]
    row = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    row = F.when(F.coalesce(*given).isNull(), row) if given else row
    digest = F.substring(F.sha2(canonical_json(row), 256), 1, 20)
    split = F.col(split) if isinstance(split, str) else split
    return F.coalesce(*given, F.concat_ws(":", F.lit(dataset), split, digest))


def _scoring(prompt: Column, labels: Column, continuations: Column, normalize: bool, metric: str) -> Column:
    return F.struct(
        prompt.alias("prompt"), labels.alias("labels"), continuations.alias("continuations"),
        F.lit(normalize).alias("length_normalize"), F.lit(metric).alias("metric"),
    )


def _spaced(texts: Column) -> Column:
    return F.transform(texts, with_leading_space)


def _project(
    df: DataFrame, dataset: str, logical: Column, rendered: Column, gold: Column, normalized: Column, parser: str,
    labels: Column | None = None, scoring: Column | None = None,
) -> DataFrame:
    return df.select(
        F.lit(dataset).alias("dataset"), "split", "example_index",
        example_id(df, dataset).alias("example_id"),
        logical.alias("logical_prompt"), rendered.alias("rendered_prompt"),
        gold.alias("gold_answer"), normalized.alias("normalized_gold_answer"), F.lit(parser).alias("parser"),
        (F.array().cast("array<string>") if labels is None else labels).alias("labels"),
        (F.lit(None) if scoring is None else scoring).cast(SCORING_TYPE).alias("choice_scoring"),
    )


def _choice(df: DataFrame, dataset: str, question: Column, labels: Column, texts: Column, gold: Column, scoring: Column | None = None) -> DataFrame:
    prompt = format_mc(question, labels, texts)
    return _project(df, dataset, prompt["logical"], prompt["rendered"], gold, gold, CHOICE_PARSER, labels, scoring)


def _labelled(df: DataFrame, dataset: str, logical: Column, ending: str, gold: Column, labels: tuple[str, ...]) -> DataFrame:
    return _project(
        df, dataset, logical, F.concat(logical, F.lit(ending)), gold, normalize_label(gold, list(labels)), LABEL_PARSER,
        F.array(*map(F.lit, labels)),
    )


def _question_prompt(name: str) -> Column:
    return F.concat(F.lit("Question: "), strip(text_of(name)), F.lit("\nAnswer:"))


def arc_challenge(df: DataFrame) -> DataFrame:
    labels = F.transform("choices.label", lambda x: F.upper(x))
    texts = F.col("choices.text")
    scoring = _scoring(_question_prompt("question"), labels, _spaced(texts), True, "acc_norm")
    return _choice(df, "arc_challenge", text_of("question"), labels, texts, F.upper(text_of("answerKey")), scoring)


def hellaswag(df: DataFrame) -> DataFrame:
    second = F.concat(F.upper(F.substring("ctx_b", 1, 1)), F.expr("substring(ctx_b, 2)"))
    halves = strip(F.concat_ws(" ", text_of("ctx_a"), F.coalesce(second, F.lit(""))))
    context = clean_task_text(F.when(F.length(text_of("ctx")) > 0, F.col("ctx")).otherwise(halves))
    labels = alphabet(F.size("endings"))
    scoring = _scoring(context, labels, _spaced(F.col("endings")), True, "acc_norm")
    question = F.concat(F.lit("Complete the following scenario:\n"), context)
    return _choice(df, "hellaswag", question, labels, F.col("endings"), F.get(labels, F.col("label").cast("int")), scoring)


def mmlu(df: DataFrame) -> DataFrame:
    labels = alphabet(F.size("choices"))
    subject = F.replace(text_of("subject"), F.lit("_"), F.lit(" "))
    question = F.when(subject != "", F.concat(F.lit("Subject: "), subject, F.lit("\n"), text_of("question"))).otherwise(text_of("question"))
    logical = format_mc(question, labels, F.col("choices"))["logical"]
    scoring = _scoring(F.concat(logical, F.lit("\nAnswer:")), labels, _spaced(labels), False, "acc")
    return _choice(df, "mmlu", question, labels, F.col("choices"), F.get(labels, F.col("answer").cast("int")), scoring)


def truthfulqa(df: DataFrame) -> DataFrame:
    texts = F.col("mc1_targets.choices")
    labels = alphabet(F.size(texts))
    marks = F.transform("mc1_targets.labels", lambda x: x.cast("int"))
    gold = F.when(F.size(F.filter(marks, lambda m: m == 1)) == 1, F.get(labels, (F.array_position(marks, 1) - 1).cast("int")))
    scoring = _scoring(_question_prompt("question"), labels, _spaced(texts), False, "mc1")
    return _choice(df, "truthfulqa", text_of("question"), labels, texts, gold, scoring)


def winogrande(df: DataFrame) -> DataFrame:
    sentence = text_of("sentence")
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(text_of("option1"), text_of("option2"))
    parts = F.split(sentence, "_")
    suffix = F.get(parts, F.lit(1))
    gold = F.when(F.size(parts) == 2, F.when(text_of("answer") == "1", "A").when(text_of("answer") == "2", "B"))
    joined = F.array(F.concat(text_of("option1"), suffix), F.concat(text_of("option2"), suffix))
    scoring = _scoring(F.get(parts, F.lit(0)), labels, joined, False, "acc")
    question = F.concat(F.lit("Choose the option that correctly replaces the blank in: "), sentence)
    return _choice(df, "winogrande", question, labels, texts, gold, scoring)


def gsm8k(df: DataFrame) -> DataFrame:
    logical = F.concat(F.lit("Math word problem: "), text_of("question"))
    gold = gold_after_marker(text_of("answer"))
    return _project(df, "gsm8k", logical, F.concat(logical, F.lit(GSM8K_ENDING)), gold, normalize_number(gold), NUMBER_PARSER)


def medqa(df: DataFrame) -> DataFrame:
    """Options are ``array<struct<key, value>>``; a missing key becomes the letter of its place."""
    letter = alphabet(F.size("options"))
    labels = F.zip_with("options", letter, lambda o, place: F.upper(F.coalesce(F.nullif(o["key"], F.lit("")), place)))
    texts = F.transform("options", lambda o: F.coalesce(o["value"], F.lit("")))
    answer = F.upper(text_of("answer_idx"))
    question = F.concat(F.lit("Medical question: "), text_of("question"))
    return _choice(df, "medqa", question, labels, texts, F.when(F.array_contains(labels, answer), answer))


def pubmedqa(df: DataFrame) -> DataFrame:
    logical = F.concat(F.lit("Question: "), text_of("question"), F.lit("\n\nContexts:\n"), F.array_join("contexts", "\n\n"))
    return _labelled(df, "pubmedqa", logical, PUBMEDQA_ENDING, F.lower(text_of("final_decision")), YES_NO_MAYBE)


def chemprot(df: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, CHEMPROT_LABELS))
    labels = alphabet(F.lit(len(CHEMPROT_LABELS)))
    raw = F.upper(text_of("label"))
    place = F.array_position(names, raw)
    gold = F.when(place > 0, F.get(labels, (place - 1).cast("int")))
    question = F.concat(
        F.lit("Choose the best chemical-protein relation for this text:\n"), F.replace(text_of("text"), F.lit("\n"), F.lit(" "))
    )
    prompt = format_mc(question, labels, names)
    return _project(df, "chemprot", prompt["logical"], prompt["rendered"], raw, gold, CHOICE_PARSER, labels)


def fomc(df: DataFrame) -> DataFrame:
    logical = strip(F.concat(text_of("instruction"), F.lit("\n\nStatement: "), text_of("text")))
    return _labelled(df, "fomc", logical, FOMC_ENDING, F.lower(text_of("label")), STANCES)


def headline(df: DataFrame) -> DataFrame:
    logical = F.concat(F.lit("Financial headline: "), text_of("headline"))
    return _labelled(df, "headline", logical, HEADLINE_ENDING, F.lower(text_of("label")), PRICE_SENTIMENTS)


def fpb(df: DataFrame) -> DataFrame:
    raw = text_of("label")
    gold = F.coalesce(*[F.when(raw == str(i), s) for i, s in enumerate(SENTIMENTS)], F.lower(raw))
    logical = F.concat(F.lit("Financial phrase: "), text_of("sentence"))
    return _labelled(df, "fpb", logical, FPB_ENDING, gold, SENTIMENTS)


def humaneval(df: DataFrame) -> DataFrame:
    prompt = text_of("prompt")
    return _project(df, "humaneval", prompt, prompt, F.lit(""), F.lit(None).cast("string"), CODE_PARSER)


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        arc_challenge, hellaswag, mmlu, truthfulqa, winogrande, gsm8k, medqa, pubmedqa, chemprot, fomc, headline, fpb,
        humaneval,
    )
}


def adapt(df: DataFrame, task: str) -> DataFrame:
    """Examples of a benchmark table with ``split`` and ``example_index`` columns."""
    return ADAPTERS[task](df)


def example_violations(examples: DataFrame) -> DataFrame:
    """Examples without a usable gold answer, prompt or candidate list."""
    code = F.col("dataset") == "humaneval"
    spec = F.col("choice_scoring")
    return rules.row_rules(
        examples,
        F.concat_ws("/", "dataset", "example_id"),
        [
            ("unusable_gold", ~code & F.col("normalized_gold_answer").isNull(), F.col("gold_answer")),
            ("missing_prompt", F.coalesce(F.length("logical_prompt"), F.lit(0)) == 0),
            ("choice_counts_differ", spec.isNotNull() & (F.size(spec["labels"]) != F.size(spec["continuations"]))),
            ("gold_outside_labels", spec.isNotNull() & ~F.array_contains(spec["labels"], F.col("normalized_gold_answer"))),
        ],
    )
