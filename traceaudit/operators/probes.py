"""Multiple-choice probes: cleaning, few-shot attachment and prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.functions.parsing import OPTION_LETTERS
from traceaudit.functions.text import as_column, strip
from traceaudit.operators.rules import row_rules

# Prompt wording and the number of examples per probe.
FEW_SHOT = 5
HEADER = (
    "The following are multiple-choice questions. Think step by step and end every answer with "
    "the exact sentence 'The answer is (X).', where X is one option letter."
)
THINK = "Answer: Let's think step by step."
MISSING_OPTION = "N/A"


def letters(count: Column) -> Column:
    """The first ``count`` option letters."""
    return F.slice(F.array(*[F.lit(c) for c in OPTION_LETTERS]), F.lit(1), count)


def lettered(options: Column | str) -> Column:
    """Option lines ``A. text`` joined by line breaks."""
    options = as_column(options)
    return F.array_join(F.zip_with(letters(F.size(options)), options, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def format_mc(question: Column | str, labels: Column, texts: Column) -> Column:
    """Logical and rendered prompt of a multiple-choice question."""
    lines = F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    logical = F.concat(F.lit("Question: "), strip(question), F.lit("\n"), lines)
    ending = F.concat(
        F.lit("\n\nSelect the best answer. End your response with 'Final answer: <LABEL>', using one of: "),
        F.array_join(labels, ", "),
        F.lit("."),
    )
    return F.struct(logical.alias("logical"), F.concat(logical, ending).alias("rendered"))


def clean_options(options: Column | str) -> Column:
    """Trimmed options without nulls, empty texts and placeholders."""
    kept = F.filter(as_column(options), lambda o: o.isNotNull() & (o != "") & (o != MISSING_OPTION))
    return F.transform(kept, strip)


def answer_letter(answer: Column | str, options: Column, index: Column | None = None) -> Column:
    """Letter of an answer: of its index where there is one, else of a letter or an option text.

    Only an integer is an index; digits in a text are the text of an option.
    """
    text = strip(as_column(answer).cast("string"))
    allowed = letters(F.size(options))
    letter = F.when(F.array_contains(allowed, F.upper(text)), F.upper(text))
    place = F.array_position(options, text)
    of_text = F.coalesce(letter, F.when(place > 0, F.get(allowed, (place - 1).cast("int"))))
    return of_text if index is None else F.when(index.isNotNull(), F.get(allowed, index.cast("int"))).otherwise(of_text)


def _answer(df: DataFrame) -> Column:
    """Answer of cleaned rows; ``answer_index``, if they have it, is an integer."""
    index = F.col("answer_index") if "answer_index" in df.columns else None
    answer = F.col("answer") if "answer" in df.columns else F.lit(None)
    return answer_letter(answer, F.col("options"), index)


def option_violations(df: DataFrame, key: str) -> DataFrame:
    """Questions with more options than there are letters."""
    count = F.size(clean_options("options"))
    return row_rules(df, key, [("too_many_options", count > len(OPTION_LETTERS), count.cast("string"))])


def _usable(df: DataFrame) -> DataFrame:
    return df.withColumn("options", clean_options("options")).filter(F.size("options").between(2, len(OPTION_LETTERS)))


def category_matches(category: Column | str, selected: Sequence[str] | None) -> Column:
    """Exact category or one that ends in ``_<selected>``; no selection or 'all' admits every row."""
    names = [s.strip().lower() for s in selected or () if s.strip()]
    if not names or "all" in names:
        return F.lit(True)
    text = F.lower(strip(category))
    hit = F.lit(False)
    for name in names:
        hit = hit | (text == name) | text.endswith(f"_{name}")
    return hit


def build_probes(df: DataFrame, categories: Sequence[str] | None = None, examples: DataFrame | None = None) -> DataFrame:
    """Usable probes ``(probe_id, category, question, options, answer)`` with their few-shot examples.

    ``examples`` has (category, position, question, options, answer,
    cot_content). The first five per category are kept by rank before they are
    gathered, so the gathered arrays have at most five entries. Questions with
    more options than letters are no probes; ``option_violations`` lists them.
    """
    cleaned = _usable(df.filter(category_matches("category", categories)))
    probes = cleaned.withColumns({"question": strip("question"), "answer": _answer(cleaned)})
    if examples is None:
        return probes
    usable = _usable(examples)
    rank = Window.partitionBy("category").orderBy("position")
    first = usable.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= FEW_SHOT)
    shot = F.struct(
        strip("question").alias("question"),
        F.col("options"),
        _answer(first).alias("answer"),
        strip(F.coalesce("cot_content", F.lit(""))).alias("cot_content"),
    )
    gathered = first.groupBy("category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", shot.alias("s")))), lambda r: r["s"]).alias("few_shot_examples")
    )
    return probes.join(gathered, "category", "left")


def probe_prompt(question: Column | str, options: Column | str, examples: Column | str | None = None) -> Column:
    """Prompt of a probe, with worked examples when there are any."""
    question, options = strip(question), as_column(options)
    plain = F.concat(
        question,
        F.when(F.size(options) > 0, F.concat(F.lit("\n\n"), lettered(options))).otherwise(""),
        F.lit("\n\nAnswer with only one letter from: "),
        F.array_join(letters(F.size(options)), ", "),
        F.lit("."),
    )
    if examples is None:
        return plain
    examples = as_column(examples)

    def worked(e: Column) -> Column:
        answer = F.when(F.length(e["cot_content"]) > 0, e["cot_content"]).otherwise(
            F.concat(F.lit("The answer is ("), F.upper(F.coalesce(e["answer"], F.lit(""))), F.lit(")."))
        )
        return F.concat(
            F.lit("Question:\n"), e["question"], F.lit("\nOptions:\n"), lettered(e["options"]), F.lit(f"\n{THINK} "), answer
        )

    own = F.concat(F.lit("Question:\n"), question, F.lit("\nOptions:\n"), lettered(options), F.lit(f"\n{THINK}"))
    guided = F.concat_ws("\n\n", F.lit(HEADER), F.array_join(F.transform(examples, worked), "\n\n"), own)
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, guided).otherwise(plain)
