"""Heterogeneous prompt/response logs: field picking, validation, pairs and lineage.

Raw log rows are kept as VARIANT. The logs disagree on what a missing field is,
so each rule has its own picker: null, blank text, falsy, empty, or not a text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.functions.hashing import set_digest
from traceaudit.functions.parsing import clean_answer
from traceaudit.functions.text import SPACE, as_column, let, render, strip
from traceaudit.operators import rules
from traceaudit.operators.combine import beside
from traceaudit.operators.corpus import require_rows
from traceaudit.operators.ordering import positions
from traceaudit.session import materialise

# Alias lists in order of preference.
QUERY_ID_KEYS = ("query_id", "id", "qid", "uid", "example_id", "idx")
QUERY_TEXT_KEYS = ("query", "prompt", "question", "problem", "instruction", "text", "input")
TRANSCRIPT_TEXT_KEYS = (
    "query", "prompt", "rendered_prompt", "logical_prompt", "instruction", "question", "problem", "text", "input",
)
RESPONSE_KEYS = ("response", "teacher_response", "output", "completion", "answer", "final_answer")
WATERMARK_RESPONSE_KEYS = (*RESPONSE_KEYS, "w_wm_output")
ORIGINAL_RESPONSE_KEYS = ("original_response", "response", "output", "answer", "completion")
RECEIVED_QUERY_KEYS = (
    "teacher_query", "rendered_prompt", "rendered_query", "templated_prompt", "template_prompt", "prompt",
    "prompt_text", "query", "logical_prompt", "instruction", "question", "input", "text",
)
LOG_ID_KEYS = ("query_id", "id", "idx", "example_id")
POOL_ID_KEYS = ("id", "prompt_id", "query_id", "example_id")
POOL_TEXT_KEYS = ("prompt", "prompt_text", "query")
RECORD_ID_KEYS = ("prompt_id", "example_id", "id", "task_id")
RECORD_PROMPT_KEYS = ("prompt", "prompt_text", "rendered_prompt", "logical_prompt", "instruction", "question")
RECORD_RESPONSE_KEYS = (
    "teacher_response", "student_response", "response", "output", "raw_response", "generated_completion",
)
TURN_TEXT_KEYS = ("prompt", "query", "instruction", "question", "text")
FORBIDDEN_KEYS = ("teacher_logits", "logits", "token_probabilities", "top_k_probabilities", "hidden_states", "gradients")
TRANSCRIPT_FIELDS = (
    "prompt_id", "prompt_text", "teacher_response", "teacher_model_id", "decode_config", "seed", "order_index",
    "query_id", "query_status", "created_at",
)
DIALOGUES = {
    "plain": "User: {prompt}\nAssistant: {response}",
    "headed": "### User:\n{prompt}\n\n### Assistant:\n{response}",
    "system": "{system}\n\nUser: {prompt}\nAssistant:",
}

Usable = Callable[[Column, Column], Column]


class Fields(Protocol):
    """Named fields of a row; ``usable(text, kind)`` says whether a field counts as present."""

    def first(self, keys: Sequence[str], usable: Usable) -> Column: ...


class ColumnFields:
    """Fields of a flat table; columns that are absent or not scalar are skipped."""

    def __init__(self, df: DataFrame) -> None:
        kinds = ((T.StringType, "STRING"), (T.BooleanType, "BOOLEAN"), (T.NumericType, "NUMBER"))
        self.kinds = {f.name: k for f in df.schema.fields for t, k in kinds if isinstance(f.dataType, t)}

    def first(self, keys: Sequence[str], usable: Usable) -> Column:
        texts = {k: F.col(k).cast("string") for k in keys if k in self.kinds}
        picks = [F.when(usable(text, F.lit(self.kinds[k])), text) for k, text in texts.items()]
        return F.coalesce(*picks) if picks else F.lit(None).cast("string")


class VariantFields:
    """Fields of a VARIANT object, opened once per row however many names are tried."""

    def __init__(self, raw: Column | str) -> None:
        self.raw = as_column(raw)

    def first(self, keys: Sequence[str], usable: Usable) -> Column:
        names = F.array(*[F.lit(k) for k in keys])

        def text_if_usable(value: Column) -> Column:
            kind = F.schema_of_variant(value)
            scalar = F.when(kind.isin("STRING", "BOOLEAN"), kind).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "NUMBER")
            text = F.try_variant_get(value, "$", "string")
            return F.when(usable(text, scalar), text)

        def pick(opened: Column) -> Column:
            values = F.transform(names, lambda k: text_if_usable(F.try_element_at(opened, k)))
            return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

        return let(F.try_variant_get(self.raw, "$", "map<string,variant>"), pick)


def column_fields(df: DataFrame) -> Fields:
    return ColumnFields(df)


def variant_fields(raw: Column | str) -> Fields:
    return VariantFields(raw)


def first_non_null(get: Fields, keys: Sequence[str]) -> Column:
    """First field that is present and not null."""
    return get.first(keys, lambda text, kind: text.isNotNull())


def first_filled(get: Fields, keys: Sequence[str]) -> Column:
    """First field that is not null and not the empty text."""
    return get.first(keys, lambda text, kind: text != "")


def first_truthy(get: Fields, keys: Sequence[str]) -> Column:
    """First field that is neither null, empty, zero nor false."""
    return get.first(
        keys,
        lambda text, kind: F.when(kind == "NUMBER", text.cast("double") != 0)
        .when(kind == "BOOLEAN", text == "true")
        .otherwise(text != ""),
    )


def first_text(get: Fields, keys: Sequence[str]) -> Column:
    """First field that holds a text, the empty text included."""
    return get.first(keys, lambda text, kind: kind == "STRING")


def first_non_blank(get: Fields, keys: Sequence[str]) -> Column:
    """First field that holds a non-blank text, trimmed."""
    return strip(get.first(keys, lambda text, kind: (kind == "STRING") & (strip(text) != "")))


def pick_query(raw: Column | str, depth: int) -> Column:
    """Text of a log object: a direct field, else the message contents, else of up to ``depth`` nested requests."""
    raw = as_column(raw)
    direct = first_non_blank(variant_fields(raw), RECEIVED_QUERY_KEYS)
    messages = F.try_variant_get(raw, "$.messages", "array<variant>")
    contents = F.transform(
        messages,
        lambda m: F.when(
            F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING",
            strip(F.try_variant_get(m, "$.content", "string")),
        ),
    )
    texts = F.filter(contents, lambda c: c.isNotNull())
    joined = F.when(F.size(texts) > 0, F.array_join(F.filter(texts, lambda c: c != ""), "\n"))
    if depth == 0:
        return F.coalesce(direct, joined)
    return F.coalesce(direct, joined, pick_query(F.try_variant_get(raw, "$.request", "variant"), depth - 1))


def received_queries(df: DataFrame, raw: str, name: str = "query", depth: int = 3) -> DataFrame:
    """``df`` with the text a teacher received: the object's own, else that of its nested request, however deep.

    A pass opens ``depth`` nested requests. Rows that still have one, usually few, are stored and go through the next.
    """
    columns, parts = df.columns, []
    left = df.withColumn("_request", F.col(raw))
    while True:
        below = F.try_variant_get(F.col("_request"), "$" + ".request" * (depth + 1), "variant")
        found = left.withColumns({name: pick_query("_request", depth), "_below": below})
        open_ = F.col(name).isNull() & F.col("_below").isNotNull()
        parts.append(found.filter(~open_).select(*columns, name))
        rest = found.filter(open_).select(*columns, F.col("_below").alias("_request"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        left = materialise(rest)


def normalize_query(df: DataFrame, get: Fields, index: str) -> DataFrame:
    """``(query_id, query)`` with the row index as fallback id; rows without text keep a null query."""
    return df.select(
        F.coalesce(first_non_null(get, QUERY_ID_KEYS), F.col(index).cast("string")).alias("query_id"),
        first_non_null(get, QUERY_TEXT_KEYS).alias("query"),
        F.col(index).alias("source_index"),
    )


def normalize_query_log(df: DataFrame, raw: str, index: str, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Query log rows and a one-row count of kept and skipped records."""
    ident = first_truthy(variant_fields(raw), LOG_ID_KEYS)
    synthetic = F.format_string("teacher_query_%06d", F.col(index))
    picked = received_queries(df, raw, "_query").select(
        F.coalesce(ident, synthetic).alias("id"), F.col("_query").alias("query"), F.col(index).alias("source_index"), F.col(path).alias("source_path")
    )
    counts = picked.agg(
        F.count("query").alias("num_queries"), F.count_if(F.col("query").isNull()).alias("skipped_records")
    )
    kept = picked.filter(F.col("query").isNotNull()).select("id", F.col("id").alias("query_id"), "query", "source_index", "source_path")
    return (kept if limit is None else kept.orderBy("source_index").limit(limit)), counts


def pool_id(get: Fields, index: Column | str) -> Column:
    return F.coalesce(first_truthy(get, POOL_ID_KEYS), F.format_string("row_%08d", as_column(index)))


def pool_text(get: Fields) -> Column:
    return F.coalesce(first_truthy(get, POOL_TEXT_KEYS), F.lit(""))


def record_id(get: Fields, index: Column | str) -> Column:
    return F.coalesce(first_filled(get, RECORD_ID_KEYS), F.format_string("row_%08d", as_column(index)))


def record_prompt(get: Fields) -> Column:
    return first_filled(get, RECORD_PROMPT_KEYS)


def record_response(get: Fields, *preferred: str) -> Column:
    return first_filled(get, (*preferred, *RECORD_RESPONSE_KEYS))


def normalize_transcript(df: DataFrame, get: Fields, index: str, prefix: str = "countermeasure") -> DataFrame:
    """``(query_id, query, response)`` with a numbered fallback id."""
    fallback = F.format_string(prefix + "_%06d", F.col(index))
    return df.select(
        F.coalesce(first_non_null(get, QUERY_ID_KEYS), fallback).alias("query_id"),
        first_non_null(get, TRANSCRIPT_TEXT_KEYS).alias("query"),
        first_non_null(get, WATERMARK_RESPONSE_KEYS).alias("response"),
        F.col(index).alias("source_index"),
    )


def triple_violations(df: DataFrame) -> DataFrame:
    return rules.row_rules(
        df, "query_id", [("missing_query", F.col("query").isNull()), ("missing_response", F.col("response").isNull())]
    )


def import_transcript(df: DataFrame, get: Fields, index: str, budget: int, teacher: str | None = None, seed: int = 0) -> DataFrame:
    """External prompt/response rows as transcript records, cut to a budget in input order; refused if it has fewer."""
    triples = normalize_transcript(df, get, index, "external")
    ordered = positions(triples, ["source_index"]).filter(F.col("position") <= budget)
    require_rows(ordered.select("position"), budget, "external transcript")
    return ordered.select(
        F.col("query_id").alias("prompt_id"),
        F.col("query").alias("prompt_text"),
        F.col("response").alias("teacher_response"),
        F.lit(teacher or "external_teacher_transcript").alias("teacher_model_id"),
        F.struct(F.lit("external_jsonl").alias("strategy"), F.create_map(F.lit("format"), F.lit("query_response_jsonl")).alias("settings")).alias("decode_config"),
        F.lit(seed).cast("bigint").alias("seed"),
        (F.col("position") - 1).alias("order_index"),
        F.col("query_id"),
        F.lit("success").alias("query_status"),
        F.lit("external").alias("created_at"),
    )


def query_log(transcripts: DataFrame, get: Fields, index: str) -> DataFrame:
    """Queries a teacher received, read back from a transcript."""
    return transcripts.select(
        F.coalesce(first_truthy(get, ("query_id", "id")), F.format_string("offline_%06d", F.col(index))).alias("query_id"),
        F.coalesce(first_truthy(get, ("query", "prompt", "prompt_text")), F.lit("")).alias("query"),
        F.lit("offline_batch_defended_transcript").alias("source"),
    )


# Conversations


def first_user_turn(turns: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """First non-blank human turn per conversation."""
    human = turns.filter(F.lower(role).isin("human", "user") & (strip(text) != ""))
    return human.groupBy(by).agg(F.min_by(strip(text), F.col(turn)).alias("query"))


def last_user_turn(turns: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Last user message per conversation, blank or not."""
    users = turns.filter(F.col(role) == "user")
    return users.groupBy(by).agg(F.max_by(F.col(text), F.col(turn)).alias("prompt"))


def chat_prompt(messages: Column) -> Column:
    """Prompt of a chat request held as ``array<struct<role, content>>``.

    ``content`` is an array of text parts. The last user message counts, its
    parts joined by line breaks; without one, all contents.
    """

    def joined(parts: Column) -> Column:
        return F.array_join(F.filter(parts, lambda p: p != ""), "\n")

    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))
    everything = F.array_join(F.transform(messages, lambda m: joined(m["content"])), "\n")
    return F.coalesce(joined(last["content"]), everything)


def completion_prompt(prompts: Column, join_all: bool) -> Column:
    """Prompt of a completion request that lists several: the first one, or all joined."""
    return F.array_join(prompts, "\n") if join_all else F.coalesce(F.get(prompts, F.lit(0)), F.lit(""))


def render_dialogue(prompt: Column | str, response: Column | str | None = None, style: str = "plain", system: Column | str | None = None) -> Column:
    """Dialogue text without a chat template, in one of three wordings."""
    answer = F.lit("") if response is None else response
    if style != "system":
        return render(DIALOGUES[style], prompt=prompt, response=answer)
    system = F.lit(None).cast("string") if system is None else as_column(system)
    framed = render(DIALOGUES["system"], system=system, prompt=prompt)
    return F.when(F.length(system) > 0, framed).otherwise(as_column(prompt))


# Pairs


def build_pairs(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Inner pairs by id; a duplicate teacher id counts with its last row.

    ``student``: (id, prompt, student_text). ``teacher``: (id, prompt,
    teacher_text, position).
    """
    last = teacher.groupBy("id").agg(F.max_by(F.struct("prompt", "teacher_text"), "position").alias("t"))
    joined = student.join(last, "id")
    prompt = F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.nullif(F.col("t.prompt"), F.lit("")), F.lit(""))
    return joined.select("id", prompt.alias("prompt"), F.col("t.teacher_text").alias("teacher_text"), "student_text")


def preference_pairs(teacher: DataFrame, student: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen/rejected pairs and the count per status.

    ``teacher``: (prompt_id, prompt, response). ``student``: (prompt_id,
    response, position); the last row of an id wins. A missing student row is
    reported as status ``missing_student``; blank responses are skipped.
    """
    last = student.groupBy("prompt_id").agg(F.max_by(F.struct("response"), "position").alias("_s"))
    joined = teacher.join(last, "prompt_id", "left")
    rejected = F.col("_s.response")
    status = (
        F.when(F.col("_s").isNull(), "missing_student")
        .when(F.coalesce(F.col("response"), F.lit("")) == "", "invalid_teacher")
        .when(F.coalesce(rejected, F.lit("")) == "", "invalid_student")
        .otherwise("written")
    )
    marked = joined.withColumn("status", status)
    pairs = marked.filter("status = 'written'").select(
        "prompt_id",
        "prompt",
        F.col("response").alias("chosen"),
        rejected.alias("rejected"),
        F.lit("soda").alias("method"),
        F.lit("teacher").alias("chosen_source"),
        F.lit("student_zero_shot_static").alias("rejected_source"),
    )
    return pairs, marked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def to_pairs(df: DataFrame, method: str, template_id: str) -> DataFrame:
    """Training-pair projection of cleaned answers with nested metadata."""
    return df.select(
        "prompt_id",
        F.coalesce(F.nullif(F.col("source_prompt"), F.lit("")), F.col("templated_query")).alias("prompt"),
        "response",
        F.lit(method).alias("method"),
        F.lit(template_id).alias("template_id"),
        F.struct("query_id", "supporting_sentence").alias("metadata"),
    )


def clean_responses(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, rejected rows and counts per outcome (reason null: all rows)."""
    cleaned = df.withColumn("_c", clean_answer(raw))
    outcome = F.col("_c.reason")
    kept = cleaned.filter(outcome == "kept").select(*df.columns, "_c.response", "_c.supporting_sentence")
    rejected = cleaned.filter(outcome != "kept").select(*df.columns, outcome.alias("reason"))
    counted = cleaned.select(outcome.alias("reason")).rollup("reason").agg(F.count(F.lit(1)).alias("n"))
    return kept, rejected, counted


def coverage_gap(target: DataFrame, source: DataFrame, ident: str) -> DataFrame:
    """How many distinct ids of the target the source covers, and how many are missing."""
    left = target.select(ident).distinct()
    right = source.select(ident).distinct().withColumn("_hit", F.lit(True))
    return left.join(right, ident, "left").agg(
        F.count(F.lit(1)).alias("target_ids"),
        F.count_if("_hit").alias("covered_ids"),
        F.count_if(F.col("_hit").isNull()).alias("missing_ids"),
    )


def reuse_outputs(source: DataFrame, expected: DataFrame, ident: str) -> DataFrame:
    """Stored outputs for exactly the expected ids; refused unless all are there."""
    rules.enforce(rules.missing_keys_rule(expected, source, [ident], "stored_output_missing"), "reuse of stored outputs")
    return source.join(expected.select(ident).distinct(), ident, "left_semi")


def prefix_violations(output: DataFrame, source: DataFrame, position: str = "position") -> DataFrame:
    """A partial output must equal the input prefix, position by position."""
    right = source.select(position, F.col("query_id").alias("_id"), F.col("response").alias("_text"), F.lit(True).alias("_has"))
    joined = output.join(right, position, "left")
    has = F.col("_has").isNotNull()
    return rules.row_rules(
        joined,
        position,
        [
            ("longer_than_input", ~has),
            ("id_differs", has & ~F.col("query_id").eqNullSafe(F.col("_id"))),
            ("source_text_differs", has & ~F.col("source_response").eqNullSafe(F.col("_text"))),
        ],
    )


# Records, ledgers and bundles


def record_violations(df: DataFrame, raw: str, key: str) -> DataFrame:
    """Rules of transcript records held as VARIANT."""
    keys = F.coalesce(F.json_object_keys(F.to_json(F.col(raw))), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, TRANSCRIPT_FIELDS)), keys)
    forbidden = F.array_intersect(keys, F.array(*map(F.lit, FORBIDDEN_KEYS)))
    config = F.schema_of_variant(F.try_variant_get(F.col(raw), "$.decode_config", "variant"))
    return rules.row_rules(
        df,
        key,
        [
            ("missing_fields", F.size(missing) > 0, F.array_join(F.array_sort(missing), ",")),
            ("forbidden_fields", F.size(forbidden) > 0, F.array_join(F.array_sort(forbidden), ",")),
            ("decode_config_not_object", ~F.coalesce(config.startswith("OBJECT"), F.lit(False))),
        ],
    )


def bundle_violations(records: DataFrame, budget: int, strategy: str, num_beams: int | None = None, allow_sampling: bool = False) -> DataFrame:
    """Invariants of a transcript cut to a budget.

    Uniqueness is counted per id, so no task holds the id set; order indices
    are contiguous from 0 when they are unique and max + 1 equals the count.
    """
    shape = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("order_index").alias("lo"),
        F.max("order_index").alias("hi"),
        F.count_if(F.col("query_status") != "success").alias("bad"),
    )
    checks = rules.row_rules(
        shape,
        F.lit("bundle"),
        [
            ("row_count", F.col("n") != budget, F.col("n")),
            ("query_not_successful", F.col("bad") > 0, F.col("bad")),
            ("order_index_gap", (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1), F.col("hi")),
            ("strategy_not_allowed", F.lit(strategy not in ("greedy", "external_jsonl", "beam", "sampling")), F.lit(strategy)),
            ("sampling_not_allowed", F.lit(strategy == "sampling" and not allow_sampling)),
            ("beam_width", F.lit(strategy == "beam" and num_beams != 5), F.lit(str(num_beams))),
        ],
    )
    return rules.all_violations(
        [checks] + [rules.duplicate_rule(records, [c], f"duplicate_{c}") for c in ("prompt_id", "query_id", "order_index")]
    )


def ledger(attempts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return attempts.groupBy(*by).agg(
        F.count_if(F.col("status") == "success").alias("successful_queries"),
        F.count(F.lit(1)).alias("api_attempts"),
        F.count_if(F.col("status") != "success").alias("failed_attempts"),
    )


def completion(prompts: DataFrame, outputs: DataFrame, ident: str) -> DataFrame:
    """Planned, finished and failed counts of a collection job, and a digest of the set of finished ids."""
    planned = prompts.select(ident).distinct()
    state = outputs.groupBy(ident).agg(F.bool_or(F.col("status") == "success").alias("_ok"))
    joined = planned.join(state, ident, "left")
    counts = joined.agg(
        F.count(F.lit(1)).alias("prompt_count"),
        F.count_if("_ok").alias("completed_count"),
        F.count_if(~F.coalesce("_ok", F.lit(True))).alias("failed_count"),
        set_digest(F.when(F.col("_ok"), F.col(ident))).alias("completed_id_hash"),
    )
    return beside(counts, outputs.agg(F.count(F.lit(1)).alias("written_rows")))


# Token arrays


def length_stats(df: DataFrame, prompt: str, full: str, max_len: int, by: Sequence[str] = ()) -> DataFrame:
    """Total, valid, skipped and truncated sequences at a maximum length."""
    prompt_len, full_len = F.size(prompt), F.size(full)
    too_long = prompt_len >= max_len
    truncated = ~too_long & (full_len > max_len)
    valid = ~too_long & (F.least(full_len, F.lit(max_len)) > prompt_len)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(~valid).alias("skipped_records"),
        F.count_if(truncated).alias("truncated_records"),
    )


def prefix_mismatch(prompt: Column | str, full: Column | str) -> Column:
    """True when the prompt tokens do not start the full sequence."""
    prompt, full = as_column(prompt), as_column(full)
    return ~F.slice(full, 1, F.size(prompt)).eqNullSafe(prompt)


def loss_mask(ids: Column | str, prompt_len: Column, max_len: int, pad: int = 0) -> Column:
    """Token ids, labels and attention of a padded sequence; prompt and padding labels are -100."""
    cut = F.slice(as_column(ids), 1, max_len)
    missing = F.lit(max_len) - F.size(cut)
    labels = F.transform(cut, lambda x, i: F.when(i < prompt_len, F.lit(-100)).otherwise(x))

    def padded(values: Column, filler: int) -> Column:
        return F.concat(values, F.array_repeat(F.lit(filler), missing))

    return F.struct(
        padded(cut, pad).alias("input_ids"),
        padded(labels, -100).alias("labels"),
        padded(F.transform(cut, lambda _: F.lit(1)), 0).alias("attention_mask"),
    )


def head_tokens(ids: Column | str, n: int) -> Column:
    return F.slice(as_column(ids), 1, n)


def sanitize_component(c: Column | str) -> Column:
    """File-name safe identifier; ``unknown`` when nothing is left."""
    safe = F.regexp_replace(strip(c), "[^A-Za-z0-9_.=-]+", "_")
    trimmed = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, trimmed).otherwise("unknown")


def path_identity(path: Column | str) -> Column:
    """Defence, attack and budget from ``.../defence/attack/b<N>/...``."""
    parts = F.split(as_column(path), "/")
    places = F.transform(parts, lambda p, i: F.when(p.rlike("^b[0-9]+$"), i))
    at = F.get(F.filter(places, lambda i: i.isNotNull()), F.lit(0))

    def before(n: int) -> Column:
        return F.when(at >= n, F.get(parts, at - n))

    return F.struct(
        F.nullif(before(2), F.lit("")).alias("defense"),
        F.nullif(before(1), F.lit("")).alias("attack"),
        F.substr(F.get(parts, at), F.lit(2)).try_cast("bigint").alias("budget"),
    )


def path_violations(df: DataFrame, path: str) -> DataFrame:
    """Paths whose budget is no 64-bit number."""
    too_large = F.col(path).rlike("(^|/)b[0-9]+(/|$)") & path_identity(path)["budget"].isNull()
    return rules.row_rules(df, path, [("budget_out_of_range", too_large)])


def blank(c: Column | str) -> Column:
    return as_column(c).isNull() | as_column(c).rlike(f"^[{SPACE}]*$")
