"""Benchmark adapters over whole documents: each task's raw columns, made of a document's text, source and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.plans.registry import Catalog, table
from traceaudit.sources import tasks

CATALOG = Catalog()
query = CATALOG.query

NEWLINE = "chr(10)"


def sql(logical: str, gold: str, continuations: str = "NULL::VARCHAR") -> str:
    return f"SELECT doc_id::VARCHAR AS example_id, {logical} AS logical_prompt, {gold} AS gold, {continuations} AS continuations FROM documents"


def options(*texts: str) -> str:
    return " || ".join(f"{NEWLINE} || '{chr(65 + k)}. ' || {t}" for k, t in enumerate(texts))


def examples(spark, sf_dir, task: str, **columns):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("test").alias("split"), F.col("doc_id").alias("example_index"),
        *[value.alias(name) for name, value in columns.items()],
    )
    return tasks.adapt(rows, task).select(
        "example_id", "logical_prompt", F.col("normalized_gold_answer").alias("gold"),
        F.array_join("choice_scoring.continuations", "|").alias("continuations"),
    )


def every(n: int, *values: str):
    """A value by the remainder of doc_id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))


@query("adapter_arc_challenge", sql(f"'Question: ' || text || {options('source', 'lang')}", "CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END", "' ' || source || '| ' || lang"))
def adapter_arc_challenge(spark, sf_dir):
    choices = F.struct(F.array(F.lit("a"), F.lit("b")).alias("label"), F.array("source", "lang").alias("text"))
    return examples(spark, sf_dir, "arc_challenge", question=F.col("text"), choices=choices, answerKey=every(2, "a", "b"))


@query(
    "adapter_hellaswag",
    sql(
        f"'Question: Complete the following scenario:' || {NEWLINE} || CASE doc_id % 2 WHEN 0 THEN 'A man S' || substr(source, 2) ELSE 'The ' || lang END || {options('lang', 'source')}",
        "CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END", "' ' || lang || '| ' || source",
    ),
)
def adapter_hellaswag(spark, sf_dir):
    ctx = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("The "), "lang")).otherwise("")
    return examples(
        spark, sf_dir, "hellaswag", ctx=ctx, ctx_a=F.lit("A man"), ctx_b=F.col("source"), endings=F.array("lang", "source"), label=every(2, "0", "1")
    )


@query(
    "adapter_truthfulqa",
    sql(f"'Question: ' || text || {options('source', 'lang', repr('none'))}", "CASE WHEN doc_id % 5 <> 4 THEN chr((65 + doc_id % 3)::INTEGER) END", "' ' || source || '| ' || lang || '| none'"),
)
def adapter_truthfulqa(spark, sf_dir):
    """Every fifth question has two right answers, so none is usable."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when((i == F.col("doc_id") % 3) | (F.col("doc_id") % 5 == 4), 1).otherwise(0))
    targets = F.struct(F.array(F.col("source"), F.col("lang"), F.lit("none")).alias("choices"), marks.alias("labels"))
    return examples(spark, sf_dir, "truthfulqa", question=F.col("text"), mc1_targets=targets)


@query(
    "adapter_winogrande",
    sql(
        f"'Question: Choose the option that correctly replaces the blank in: ' || source || ' saw _ in ' || lang || {options('lang', 'source')}",
        "CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END", "lang || ' in ' || lang || '|' || source || ' in ' || lang",
    ),
)
def adapter_winogrande(spark, sf_dir):
    sentence = F.concat("source", F.lit(" saw _ in "), "lang")
    return examples(spark, sf_dir, "winogrande", sentence=sentence, option1=F.col("lang"), option2=F.col("source"), answer=every(3, "1", "2", ""))


@query("adapter_medqa", sql(f"'Question: Medical question: ' || text || {options('source', 'lang')}", "CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END"))
def adapter_medqa(spark, sf_dir):
    option = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    options_ = F.array(option(F.lit("a"), F.col("source")), option(F.lit(""), F.col("lang")))
    return examples(spark, sf_dir, "medqa", question=F.col("text"), options=options_, answer_idx=every(3, "a", "B", "z"))


@query(
    "adapter_pubmedqa",
    sql(f"'Question: ' || text || {NEWLINE} || {NEWLINE} || 'Contexts:' || {NEWLINE} || source || {NEWLINE} || {NEWLINE} || lang", "CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END"),
)
def adapter_pubmedqa(spark, sf_dir):
    return examples(spark, sf_dir, "pubmedqa", question=F.col("text"), contexts=F.array("source", "lang"), final_decision=every(4, "YES", "No", "maybe", "?"))


@query(
    "adapter_chemprot",
    sql(
        f"'Question: Choose the best chemical-protein relation for this text:' || {NEWLINE} || replace(text, {NEWLINE}, ' ') || {options(*map(repr, tasks.CHEMPROT_LABELS))}",
        "CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'N' END",
    ),
)
def adapter_chemprot(spark, sf_dir):
    return examples(spark, sf_dir, "chemprot", text=F.col("text"), label=every(3, "inhibitor", "AGONIST-INHIBITOR", "other"))


@query("adapter_fomc", sql(f"'Read.' || {NEWLINE} || {NEWLINE} || 'Statement: ' || text", "CASE doc_id % 3 WHEN 0 THEN 'dovish' WHEN 1 THEN 'hawkish' END"))
def adapter_fomc(spark, sf_dir):
    return examples(spark, sf_dir, "fomc", instruction=F.lit("Read."), text=F.col("text"), label=every(3, "Dovish", "HAWKISH", "calm"))


@query("adapter_headline", sql("'Financial headline: ' || text", "CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'positive' END"))
def adapter_headline(spark, sf_dir):
    return examples(spark, sf_dir, "headline", headline=F.col("text"), label=every(3, "None", "positive", "up"))


@query("adapter_fpb", sql("'Financial phrase: ' || text", "CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'neutral' END"))
def adapter_fpb(spark, sf_dir):
    return examples(spark, sf_dir, "fpb", sentence=F.col("text"), label=every(4, "0", "1", "2", "Neutral"))


@query("adapter_humaneval", sql("text", "NULL::VARCHAR"))
def adapter_humaneval(spark, sf_dir):
    return examples(spark, sf_dir, "humaneval", prompt=F.col("text"))
