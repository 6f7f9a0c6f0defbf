"""Run catalogue: file listings, manifests, and the joins between them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceaudit.functions.text import strip
from traceaudit.operators import rules
from traceaudit.operators.corpus import tier_for
from traceaudit.operators.transcripts import path_identity, pool_id, pool_text, sanitize_component, variant_fields
from traceaudit.sources.pools import read_documents

# Log file names with their priority, and the combination rules.
LOG_PRIORITY = {
    "teacher_received_queries.jsonl": 0,
    "combined_teacher.jsonl": 1,
    "teacher_raw.jsonl": 2,
    "transcript.jsonl": 3,
    "seed_teacher.jsonl": 10,
    "template_teacher.jsonl": 11,
    "followup_teacher.jsonl": 12,
    "templated_queries.jsonl": 20,
    "preferences.jsonl": 30,
    "attack_manifest.json": 50,
}
EXCLUSIVE_LOGS = (
    "teacher_received_queries.jsonl", "combined_teacher.jsonl", "teacher_raw.jsonl", "transcript.jsonl",
    "preferences.jsonl",
)
PLAN_BLOCK = 1 << 16
SAMPLE_STAMP = r"_\d{4}-\d{2}-\d{2}T.*$"
ADAPTIVE_ATTACKS = ("dipper", "translation")
ADAPTIVE_DEFENSES = ("adfp", "ginsew", "radioactivity")
ADAPTIVE_BUDGETS = (1000,)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths, names, times and sizes below a root; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), "length"
    )


def latest_sample_files(files: DataFrame) -> DataFrame:
    """Newest sample file per task, the time stamp stripped from the name."""
    samples = files.filter(F.col("name").rlike(r"^samples_.*\.jsonl$"))
    stem = F.regexp_replace(F.regexp_replace("name", r"\.jsonl$", ""), "^samples_", "")
    named = samples.withColumn("task", F.regexp_replace(stem, SAMPLE_STAMP, ""))
    return named.groupBy("task").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def discover_logs(files: DataFrame, root: str) -> DataFrame:
    """Log files of each (attack, run), reduced to the best kind of source.

    Attack and run come from the path after the last ``attacks`` folder. If an
    exclusive kind exists only that kind stays; a manifest alone is a fallback;
    otherwise all remaining stage files stay.
    """
    priority = F.create_map(*[F.lit(x) for pair in LOG_PRIORITY.items() for x in pair])
    known = files.filter(F.col("name").isin(*LOG_PRIORITY)).withColumn("priority", F.try_element_at(priority, F.col("name")))
    tail = F.regexp_replace("path", r"^.*/attacks/", "")
    inside = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(F.when(F.col("path").contains("/attacks/"), tail).otherwise(inside), "/")
    run = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(
        F.size(parts) == 2, F.regexp_replace(F.get(parts, F.lit(1)), r"\.[^.]*$", "")
    )
    attack = F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))
    named = known.select(
        "path", "name", "priority",
        sanitize_component(F.coalesce(attack, F.lit("unknown_attack"))).alias("attack"),
        sanitize_component(F.coalesce(run, F.lit("unknown_run"))).alias("run_id"),
    )
    exclusive = F.when(F.col("name").isin(*EXCLUSIVE_LOGS), F.col("priority"))
    group = Window.partitionBy("attack", "run_id")
    best = F.min(exclusive).over(group)
    manifest = F.max(F.when(F.col("name") == "attack_manifest.json", F.col("priority"))).over(group)
    chosen = F.coalesce(best, manifest)
    return named.withColumn("_chosen", chosen).filter(F.col("_chosen").isNull() | (F.col("priority") == F.col("_chosen"))).drop("_chosen")


def _text(raw: str, *paths: str) -> Column:
    """First non-empty value among nested places of a manifest."""
    picks = [F.nullif(F.try_variant_get(F.col(raw), f"$.{p}", "string"), F.lit("")) for p in paths]
    return F.coalesce(*picks)


def run_catalog(spark: SparkSession, root: str, glob: str = "*manifest.json") -> DataFrame:
    """One row per run manifest: identity from several nested places, run kind and status."""
    manifests = read_documents(spark, root, glob)
    place = path_identity("path")
    comparison = _text("raw", "metadata.comparison", "generator_result.metadata.comparison")
    counter = _text("raw", "generator_result.metadata.countermeasure", "metadata.countermeasure")
    has_generator = F.schema_of_variant(F.try_variant_get("raw", "$.generator_result", "variant")).rlike("^OBJECT<.+")
    schema = F.coalesce(_text("raw", "schema_version"), F.lit(""))
    kind = (
        F.when(comparison.isNotNull() | F.coalesce(~counter.isin("none", "false"), F.lit(False)), "adaptive_attack")
        .when(F.coalesce(has_generator, F.lit(False)), "defense")
        .when(_text("raw", "detector", "output_report").isNotNull() | (F.col("name") == "detector_manifest.json"), "detector")
        .when(schema.startswith("attack_manifest") | _text("raw", "result.attack").isNotNull(), "attack")
        .otherwise(F.coalesce(_text("raw", "run_type"), F.lit("unknown")))
    )
    budget = F.coalesce(
        _text("raw", "result.budget", "budget", "run_config.budget", "config.budget", "generator_result.metadata.attack.budget").cast("bigint"),
        place["budget"],
    )
    folder = F.element_at(F.split("path", "/"), -2)
    base = manifests.select(
        "path", "mtime", "raw",
        kind.alias("kind"),
        F.coalesce(_text("raw", "result.attack", "generator_result.metadata.attack.attack", "attack", "run_config.attack", "config.attack"), place["attack"]).alias("attack"),
        budget.alias("budget"),
        F.when(kind == "detector", F.coalesce(_text("raw", "detector"), _text("raw", "defense"), place["defense"]))
        .otherwise(F.coalesce(_text("raw", "defense"), place["defense"])).alias("defense"),
        F.coalesce(_text("raw", "result.run_id", "run_id"), folder).alias("run_id"),
        _text("raw", "result.status", "status").alias("status"),
        _text("raw", "created_at").alias("created_at"),
        _text("raw", "config_hash").alias("config_hash"),
        _text("raw", "attack_run_id").alias("attack_run_id"),
        comparison.alias("comparison"),
    )
    source = F.coalesce("attack_run_id", "run_id")
    detector_run = F.concat_ws("_", "defense", "attack", F.concat(F.lit("b"), F.col("budget").cast("string")), source)
    return base.withColumn("run_id", F.when(F.col("kind") == "detector", detector_run).otherwise(F.col("run_id")))


def identity_violations(catalog: DataFrame) -> DataFrame:
    return rules.row_rules(
        catalog, "path", [("missing_attack", F.col("attack").isNull()), ("missing_budget", F.col("budget").isNull())]
    )


def check_identity(catalog: DataFrame, attack: str | None = None, budget: int | None = None) -> DataFrame:
    """Manifests that contradict an asserted attack or budget."""
    checks = []
    if attack is not None:
        checks.append(("attack_differs", ~F.col("attack").eqNullSafe(F.lit(attack)), F.col("attack")))
    if budget is not None:
        checks.append(("budget_differs", ~F.col("budget").eqNullSafe(F.lit(budget)), F.col("budget")))
    return rules.row_rules(catalog, "path", checks)


def latest_run(catalog: DataFrame, statuses: Sequence[str] | None = None, by: Sequence[str] = ("attack", "budget")) -> DataFrame:
    """Newest usable manifest per group; dry runs never count, ``statuses`` restricts further."""
    usable = catalog.filter(F.coalesce(F.col("status"), F.lit("")) != "dry_run")
    if statuses is not None:
        usable = usable.filter(F.col("status").isin(*statuses))
    return usable.groupBy(*by).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def resumable(catalog: DataFrame) -> DataFrame:
    """Newest planned, running or completed manifest per configuration."""
    return latest_run(catalog.filter(F.col("config_hash").isNotNull()), ("planned", "running", "completed"), ("config_hash",))


def first_existing(candidates: DataFrame, files: DataFrame, by: Sequence[str], listed: str = "candidates") -> DataFrame:
    """First candidate path, in list order, that exists in a listing."""
    ordered = candidates.select(*by, F.posexplode(listed).alias("place", "path")).filter(F.col("path").isNotNull())
    return ordered.join(files.select("path").distinct(), "path").groupBy(*by).agg(F.min_by("path", "place").alias("path"))


def log_candidates(catalog: DataFrame) -> DataFrame:
    """Ordered places where the query log of a run may lie, relative ones below the manifest's folder."""
    transcript = "result.artifacts.teacher_transcript"
    bundle = _text("raw", f"{transcript}.bundle_dir")
    listed = F.array(
        *[_text("raw", f"{transcript}.{k}") for k in ("source_path", "transcript", "jsonl")],
        *[F.concat(bundle, F.lit(f"/{n}")) for n in ("transcript.jsonl", "teacher_raw.jsonl")],
        _text("raw", "result.artifacts.teacher_raw"),
        F.when(F.schema_of_variant(F.try_variant_get("raw", f"$.{transcript}", "variant")) == "STRING", _text("raw", transcript)),
        _text("raw", "result.teacher_transcript_path"),
        _text("raw", "teacher_transcript_path"),
    )
    folder = F.regexp_replace("path", "/[^/]*$", "")
    both = F.flatten(
        F.transform(listed, lambda p: F.array(p, F.when(~p.startswith("/"), F.concat(F.lit("./"), p))))
    )
    return catalog.select(
        F.col("path").alias("manifest"), folder.alias("folder"), both.alias("candidates")
    ).select(
        "manifest",
        F.transform(
            F.arrays_zip(F.col("candidates").alias("c"), F.array_repeat("folder", F.size("candidates")).alias("f")),
            lambda z: F.when(z["c"].startswith("./"), F.concat(z["f"], F.substring(z["c"], 2, 1 << 30))).otherwise(z["c"]),
        ).alias("candidates"),
    )


def resolve_log(catalog: DataFrame, files: DataFrame, explicit: str | None = None) -> DataFrame:
    """Query log per manifest: an explicit path, else the first candidate that exists."""
    if explicit is not None:
        return catalog.select(F.col("path").alias("manifest"), F.lit(explicit).alias("path"))
    plain = files.withColumn("path", plain_path("path"))
    fixed = log_candidates(catalog.withColumn("path", plain_path("path")))
    return first_existing(fixed, plain, ["manifest"])


def plain_path(c: Column | str) -> Column:
    """Path without the ``file:`` scheme that local listings carry."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), "^file:/+", "/")


def log_from_manifest(catalog: DataFrame, pool: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Query log rebuilt from the pool prefix of each manifest, and manifests whose pool is too short.

    ``pool``: (order_index, prompt_id, prompt_text), one pool for all runs.
    """
    wanted = F.col("budget") if limit is None else F.least(F.col("budget"), F.lit(limit))
    plans = catalog.filter(F.col("budget").isNotNull()).select("attack", "run_id", F.col("path").alias("source_path"), wanted.alias("wanted"))
    size = pool.agg(F.count(F.lit(1)).alias("n"))
    short = plans.withColumn("have", size.scalar()).filter("have < wanted").select(
        F.lit("pool_too_short").alias("rule"), F.col("source_path").alias("row_key"), F.format_string("%d rows, need %d", "have", "wanted").alias("detail")
    )
    # A manifest asks for a contiguous prefix, so its rows are its own index range.
    # Two steps, so that no row holds an array as long as a budget.
    blocks = plans.filter("wanted > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("wanted") - 1) / PLAN_BLOCK))))
    last = F.least(F.col("wanted"), (F.col("_block") + 1) * PLAN_BLOCK) - 1
    ranges = blocks.withColumn("order_index", F.explode(F.sequence(F.col("_block") * PLAN_BLOCK, last))).drop("_block")
    rows = ranges.join(pool, "order_index").select(
        F.col("prompt_id").alias("id"), F.col("prompt_id").alias("query_id"), strip("prompt_text").alias("query"),
        "attack", F.col("run_id").alias("attack_run_id"), F.col("order_index").alias("source_index"), "source_path",
    )
    return rows, short


def remap_paths(df: DataFrame, column: str, root: str, files: DataFrame, run_dir: str | None = None, run_id: str | None = None) -> DataFrame:
    """Old absolute paths moved below a new root; the first existing variant wins.

    Tried in order: below the run folder after the run id, the path itself, and
    the part from ``outputs`` on below the root.
    """
    old = F.col(column)
    options = [old, F.when(old.contains("/outputs/"), F.concat(F.lit(root.rstrip("/")), F.regexp_replace(old, r"^.*?/outputs/", "/outputs/")))]
    if run_dir is not None and run_id is not None:
        inside = F.when(old.contains(f"/{run_id}/"), F.concat(F.col(run_dir) if run_dir in df.columns else F.lit(run_dir), F.regexp_replace(old, rf"^.*?/{run_id}/", "/")))
        options.insert(0, inside)
    listed = df.withColumn("_candidates", F.array(*options))
    found = first_existing(listed.select(column, "_candidates").distinct(), files.withColumn("path", plain_path("path")), [column], "_candidates")
    return df.join(found.withColumnRenamed("path", f"{column}_local"), column, "left")


def compatible_runs(runs: DataFrame, want: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Newest run per group that fits a request, and the reasons against every other run.

    ``runs``: (run_id, created_at, status, budget, student_model, pool_hash,
    ordering_identity, ordering_hash, transcript_path, transcript_hash,
    checkpoint). Ordering is compared by its id hash when both sides have one,
    by the file hash otherwise; transcripts by path or by content.
    """

    def want_of(name: str) -> Column:
        return F.lit(want.get(name))

    def differs(name: str) -> Column:
        return ~F.col(name).eqNullSafe(want_of(name))

    by_identity = F.col("ordering_identity").isNotNull() & want_of("ordering_identity").isNotNull()
    same_transcript = F.col("transcript_path").eqNullSafe(want_of("transcript_path")) | F.coalesce(
        F.col("transcript_hash") == want_of("transcript_hash"), F.lit(False)
    )
    checks = [
        (~F.col("status").eqNullSafe(F.lit("completed")), F.concat(F.lit("status="), F.coalesce("status", F.lit("none")))),
        (differs("budget"), F.concat(F.lit("budget="), F.coalesce(F.col("budget").cast("string"), F.lit("none")))),
        (differs("student_model"), F.concat(F.lit("student_model="), F.coalesce("student_model", F.lit("none")))),
        (differs("pool_hash"), F.lit("query pool differs")),
        (F.when(by_identity, differs("ordering_identity")).otherwise(differs("ordering_hash")), F.lit("query ordering differs")),
        (F.col("transcript_path").isNull(), F.lit("teacher transcript missing")),
        (F.col("transcript_path").isNotNull() & want_of("transcript_path").isNotNull() & ~same_transcript, F.lit("teacher transcript differs")),
        (F.col("checkpoint").isNull(), F.lit("checkpoint missing or incomplete")),
    ]
    reasons = F.filter(F.array(*[F.when(broken, text) for broken, text in checks]), lambda r: r.isNotNull())
    judged = runs.withColumn("reasons", reasons)
    order = F.struct(F.coalesce("created_at", "run_id"), F.col("run_id"))
    newest = judged.filter(F.size("reasons") == 0).agg(F.max_by(F.struct(*runs.columns), order).alias("r")).filter("r is not null").select("r.*")
    rejected = judged.filter(F.size("reasons") > 0).select("run_id", F.array_join("reasons", ", ").alias("reasons"))
    return newest, rejected


def follow_manifests(comparisons: DataFrame, baselines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve comparison -> baseline -> run and report names that point to several runs.

    ``comparisons``: (comparison, defense, countermeasure, condition, baseline_path).
    ``baselines``: (baseline_path, status, run_path). ``runs``: (run_path, checkpoint).
    """
    name = F.when(F.col("condition") == "clean", "clean").otherwise(F.concat_ws("_", "defense", "condition"))
    resolved = (
        comparisons.withColumn("model", name)
        .join(baselines, "baseline_path", "left")
        .join(runs, "run_path", "left")
    )
    broken = rules.row_rules(
        resolved,
        "baseline_path",
        [
            ("baseline_incomplete", ~F.col("status").eqNullSafe(F.lit("ok")), F.col("status")),
            ("run_not_found", F.col("checkpoint").isNull(), F.col("run_path")),
        ],
    )
    one_run = rules.constant_per_group_rule(resolved.filter(F.col("checkpoint").isNotNull()), ["model"], ["checkpoint"], "baseline_differs")
    return resolved, rules.all_violations([broken, one_run])


def shared_baseline_violations(reports: DataFrame) -> DataFrame:
    """Baseline reports of one (defence, condition) must be identical in all countermeasures."""
    return rules.constant_per_group_rule(reports, ["defense", "condition"], ["report"], "baseline_differs")


def compare_conditions(conditions: DataFrame, scores: DataFrame, detector: DataFrame) -> DataFrame:
    """Conditions with the scores of their model and their detector columns."""
    return conditions.join(scores, "model", "left").join(detector, ["defense", "countermeasure", "condition"], "left")


def detector_stats(reports: DataFrame, fields: Sequence[str], raw: str = "raw") -> DataFrame:
    """Detector columns from the first student of a report, else from the report itself."""
    record = F.col(raw)
    picks = [
        F.coalesce(
            F.try_variant_get(record, f"$.students[0].{f}", "string"), F.try_variant_get(record, f"$.{f}", "string")
        ).alias(f)
        for f in fields
    ]
    return reports.select(*[c for c in reports.columns if c != raw], *picks)


def allowed_combinations(requests: DataFrame) -> DataFrame:
    """Requests (adaptive, defense, budget) that the registry allows."""
    allowed = (
        F.col("adaptive").isin(*ADAPTIVE_ATTACKS)
        & F.col("defense").isin(*ADAPTIVE_DEFENSES)
        & F.col("budget").isin(*ADAPTIVE_BUDGETS)
    )
    return requests.filter(allowed)


def protocol_violations(stored: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settings that differ between a stored run and a request for the same keys."""
    fields = [c for c in wanted.columns if c not in keys]
    right = wanted.select(*keys, *[F.col(c).alias(f"_w_{c}") for c in fields])
    joined = stored.join(right, list(keys))
    return rules.row_rules(
        joined, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]),
        [(f"{c}_differs", ~F.col(c).eqNullSafe(F.col(f"_w_{c}")), F.col(c)) for c in fields],
    )


def merge_summaries(parts: Sequence[DataFrame], expected: Sequence[str], method: str = "attack") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Worker summaries in one table, rule violations, and the methods still missing."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wanted = merged.sparkSession.createDataFrame([(m,) for m in expected], f"{method} string")
    broken = rules.all_violations(
        [
            rules.duplicate_rule(merged, [method], "duplicate_method"),
            rules.missing_keys_rule(merged, wanted, [method], "unexpected_method"),
        ]
    )
    missing = wanted.join(merged.select(method).distinct(), method, "left_anti")
    return merged, broken, missing


def pool_choice(catalog: DataFrame) -> DataFrame:
    """Pool tier that backs each run."""
    return catalog.withColumn("pool_tier", tier_for("budget"))


def pool_rows(documents: DataFrame, raw: str, position: str) -> DataFrame:
    get = variant_fields(raw)
    return documents.select(F.col(position).alias("order_index"), pool_id(get, position).alias("prompt_id"), pool_text(get).alias("prompt_text"))
