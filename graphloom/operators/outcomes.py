"""Patch outcomes, experiment summaries and quality summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scale import first_per_key, value_at_fraction


def success_flag() -> Column:
    """A patch succeeded when it was approved, validated, tested and not rolled back."""
    return (F.col("approved_by_user") & F.col("validation_passed") & F.col("tests_passed")
            & ~F.col("rollback_occurred"))


def share(flag: Column) -> Column:
    return F.round(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)), 6)


def filter_patches(patches: DataFrame, repository: str | None = None, symbol: str | None = None,
                   model: str | None = None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Optional equality filters and an inclusive time range."""
    for column, value in (("repository", repository), ("target_symbol", symbol), ("model_used", model)):
        if value is not None:
            patches = patches.filter(F.col(column) == value)
    if since_ms is not None:
        patches = patches.filter(F.col("ts_ms") >= since_ms)
    if until_ms is not None:
        patches = patches.filter(F.col("ts_ms") <= until_ms)
    return patches


def patch_statistics(patches: DataFrame) -> DataFrame:
    """Success and rollback rates: overall, per model and per edit type in one pass."""
    return (patches.withColumn("ok", success_flag())
            .groupingSets([[], ["model_used"], ["edit_type"]], "model_used", "edit_type")
            .agg(F.grouping_id("model_used", "edit_type").alias("gid"), F.count("*").alias("total"),
                 share(F.col("ok")).alias("success_rate"), share(F.col("rollback_occurred")).alias("rollback_rate"))
            .select(F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "model").otherwise("edit_type").alias("scope"),
                    F.coalesce("model_used", "edit_type", F.lit("all")).alias("label"),
                    "total", "success_rate", "rollback_rate"))


def model_performance(patches: DataFrame) -> DataFrame:
    return patches.groupBy("model_used").agg(F.count("*").alias("patches"), share(success_flag()).alias("success_rate"))


def edit_risk(patches: DataFrame, edit_types: DataFrame | None = None) -> DataFrame:
    """Failure share per edit type; types without history have no risk."""
    seen = patches.groupBy("edit_type").agg(share(~success_flag()).alias("risk"))
    if edit_types is None:
        return seen
    return edit_types.join(seen, "edit_type", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def history_export(patches: DataFrame) -> DataFrame:
    """Timeline rows with their outcome; failures are the rows with ``ok`` false."""
    return patches.select("patch_id", "ts_ms", "repository", "target_symbol", "model_used", success_flag().alias("ok"))


def model_trends(patches: DataFrame) -> DataFrame:
    """Success per model and month."""
    month = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM")
    return patches.groupBy("model_used", month.alias("month")).agg(
        F.count("*").alias("patches"), share(success_flag()).alias("success_rate"))


def retrieval_quality(cases: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rates, means and exact p95 overall and per bucket."""
    both = cases.withColumn("scope", F.explode(F.array_compact(F.array(
        F.lit("overall"), F.when(F.col(bucket) != "", F.col(bucket))))))
    rates = both.groupBy("scope").agg(
        F.count("*").alias("case_count"), share(F.col("target_match")).alias("target_match_rate"),
        share(F.col("top_file_match")).alias("top_file_match_rate"),
        share(F.col("top_span_match")).alias("top_span_match_rate"),
        F.round(F.avg("omission_count"), 6).alias("omission_rate"),
        F.round(F.avg("overfetch_count"), 6).alias("overfetch_rate"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.avg("approx_tokens"), 4).alias("avg_tokens"), F.max("approx_tokens").alias("max_tokens"))
    return rates.join(value_at_fraction(both, ["scope"], "latency_ms", {"p95_latency_ms": 0.95}), "scope")


def route_quality(cases: DataFrame, flags: Sequence[str], mutation_intents: Sequence[str] = ("implement", "refactor"),
                  mutation_flags: Sequence[str] = ()) -> DataFrame:
    """Flag rates overall and per intent; mutation rates count only intents that change code."""
    mutating = F.col("intent").isin(*mutation_intents)
    return (cases.rollup("intent").agg(
        F.grouping("intent").alias("g"), F.count("*").alias("case_count"),
        F.count_if(mutating).alias("mutation_case_count"),
        *[share(F.col(f)).alias(f"{f}_rate") for f in flags],
        *[share(F.when(mutating, F.col(f))).alias(f"mutation_{f}_rate") for f in mutation_flags],
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.max("approx_tokens").alias("max_tokens"))
        .withColumn("scope", F.when(F.col("g") == 1, "overall").otherwise(F.col("intent"))).drop("g", "intent"))


# Flags of a route case that count over all cases, and over those that change code.
CASE_FLAGS = ("reviewable_or_better", "high_confidence", "intent_match", "selected_tool_match", "budget_match", "reference_only_match",
              "single_file_fast_path_match", "result_symbol_match", "project_summary_match")
MUTATION_FLAGS = ("reviewable_or_better", "high_confidence", "retry_recovered", "ready", "ready_without_retry", "exact_ready", "blocked", "scope_aligned",
                  "scope_incomplete", "scope_missing_files", "scope_extra_files", "scope_missing_symbols", "scope_extra_symbols")


def route_report(cases: DataFrame) -> DataFrame:
    """Every rate of the route quality report, overall and per intent, with exact p95 latency.

    A case is exactly ready or blocked by its ``bundle_status`` and ``state``. A null flag counts as false. Cases without
    an intent count overall only. Scopes without a case that changes code have mutation rates of zero.
    """
    flags = dict.fromkeys([*CASE_FLAGS, *MUTATION_FLAGS])
    given = cases.withColumns({"exact_ready": F.col("bundle_status") == "exact_ready", "blocked": F.col("state") == "blocked"})
    given = given.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).withColumn("intent", F.nullif("intent", F.lit("")))
    rates = route_quality(given, CASE_FLAGS, mutation_flags=MUTATION_FLAGS)
    scoped = given.select(F.explode(F.array(F.lit("overall"), F.col("intent"))).alias("scope"), "latency_ms", "approx_tokens")
    tokens = scoped.groupBy("scope").agg(F.round(F.avg("approx_tokens"), 4).alias("avg_tokens"))
    p95 = value_at_fraction(scoped, ["scope"], "latency_ms", {"p95_latency_ms": 0.95})
    return rates.filter("scope IS NOT NULL").join(tokens, "scope").join(p95, "scope")


def weighted_mean(df: DataFrame, keys: Sequence[str], metric: str, weight: str) -> DataFrame:
    """Weighted mean per key; zero weights do not count and an empty group has none."""
    used = df.filter(F.col(weight) != 0)
    return used.groupBy(*keys).agg(F.round(F.sum(F.col(metric) * F.col(weight)) / F.sum(weight), 6).alias("weighted_mean"))


def experiment_summary(tasks: DataFrame) -> DataFrame:
    """Control arm against treatment arm over paired task rows.

    A task succeeds in an arm with at least two term hits; step counts are estimated from the files
    involved. The gate trips when tokens overrun by 25 % or steps by 10 %.
    """
    steps_without = 4 + F.least(F.col("file_mentions"), F.lit(3))
    steps_with = 3 + F.least(F.col("impacted_files"), F.lit(3)) + (F.col("hits_with") == 0).cast("bigint")
    wide = tasks.groupBy("suite").agg(
        F.count("*").alias("task_count"), F.sum("tokens_without").alias("tokens_without"),
        F.sum("tokens_with").alias("tokens_with"), F.sum(steps_without).alias("steps_without"),
        F.sum(steps_with).alias("steps_with"),
        F.count_if(F.col("hits_without") >= 2).alias("success_without"),
        F.count_if(F.col("hits_with") >= 2).alias("success_with"),
        F.count_if((F.col("hits_with") >= 2) & F.col("validated")).alias("validated_success_with"),
        share(F.col("target_match")).alias("target_match_rate"),
        share(F.col("impacted_files") == 0).alias("empty_ref_rate"),
        share(F.col("tokens_with") > F.col("tokens_without")).alias("prompt_over_control_rate"),
        share(~F.col("target_match") & (F.col("hits_with") < 2)).alias("misdirection_rate"))
    pct = lambda a, b: F.round(F.when(F.col(a) == 0, 0.0).otherwise((F.col(a) - F.col(b)) / F.col(a) * 100), 6)
    out = wide.withColumns({"savings_pct": pct("tokens_without", "tokens_with"),
                            "step_savings_pct": pct("steps_without", "steps_with")})
    return out.withColumn("regression_alert", (F.col("savings_pct") < -25.0) | (F.col("step_savings_pct") < -10.0))


def experiment_rates(tasks: DataFrame, keys: Sequence[str] = ("suite",), overrun_pct: float = 25.0, step_pct: float = 10.0) -> DataFrame:
    """Percentages of both arms, retrieval quality and gates over paired task rows, in one aggregation.

    Coverage is the share of expected terms found, over all tasks of the group; without expected terms it is zero.
    Retrieval time is a whole number of milliseconds a task. A null flag counts as false.
    """
    flags = ("executed", "validated", "tests_passed", "target_match", "heavy_first", "escalated", "escalation_skipped", "trimmed")
    hit, control = F.col("hits_with") >= 2, F.col("hits_without") >= 2
    steps_without = 4 + F.least(F.col("file_mentions"), F.lit(3))
    steps_with = 3 + F.least(F.col("impacted_files"), F.lit(3)) + (F.col("hits_with") == 0).cast("bigint")
    pct = lambda flag: F.round(F.count_if(flag) / F.count("*") * 100, 6)
    saved = lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise((a - b) / a * 100)
    tokens = saved(F.sum("tokens_without"), F.sum("tokens_with"))
    steps = saved(F.sum(steps_without), F.sum(steps_with))
    found, expected = F.sum("terms_found"), F.sum("terms_expected")
    out = tasks.groupBy(*keys).agg(
        F.count("*").alias("task_count"), pct(control).alias("success_without_pct"), pct(hit).alias("success_with_pct"),
        pct(hit & F.col("validated")).alias("validated_success_pct"), *[pct(F.col(f)).alias(f"{f}_pct") for f in flags],
        pct(F.col("impacted_files") == 0).alias("empty_ref_pct"), pct(F.col("tokens_with") > F.col("tokens_without")).alias("over_control_pct"),
        pct(~F.col("target_match") & ~hit).alias("misdirection_pct"),
        F.round(F.when(expected == 0, F.lit(0.0)).otherwise(found / expected * 100), 6).alias("context_coverage_pct"),
        F.floor(F.sum("retrieval_ms") / F.count("*")).alias("avg_retrieval_ms"),
        tokens.alias("savings"), steps.alias("step_savings"))
    return out.withColumn("regression_alert", (F.col("savings") < -overrun_pct) | (F.col("step_savings") < -step_pct)).withColumns(
        {"savings_pct": F.round("savings", 6), "step_savings_pct": F.round("step_savings", 6)}).drop("savings", "step_savings")


def evolution_risk(patches: DataFrame, plans: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Half failure rate, 0.3 plan volume (full at 100 plans), 0.2 share of files that are no tests."""
    lower = F.lower(path)
    rows = (patches.agg(F.avg((~success_flag()).cast("double")).alias("v")).select(F.lit("failure").alias("k"), "v")
            .unionByName(plans.agg(F.least(F.count("*") / 100.0, F.lit(1.0)).alias("v")).select(F.lit("plans").alias("k"), "v"))
            .unionByName(files.agg((1 - F.avg((lower.contains("test") | lower.contains("spec")).cast("double"))).alias("v"))
                         .select(F.lit("untested").alias("k"), "v")))
    weight = F.when(F.col("k") == "failure", 0.5).when(F.col("k") == "plans", 0.3).otherwise(0.2)
    return rows.agg(F.round(F.sum(F.coalesce("v", F.lit(0.0)) * weight), 6).alias("risk_score"))


def dominant_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label per key; ties go to the smallest, keys without labels are unknown."""
    counts = df.groupBy(key, label).agg(F.count(label).alias("n"))
    best = counts.groupBy(key).agg(F.min_by(label, F.when(F.col(label).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(label)))).alias("dominant"))
    return best.withColumn("dominant", F.coalesce("dominant", F.lit("unknown")))


def provider_choice(stats: DataFrame) -> DataFrame:
    """Best preferred provider per task: success weighs 0.6, latency and cost 0.2 each.

    Missing metrics default to no failures, 500 ms and a cost of one.
    """
    success = F.coalesce(F.col("success_rate"), 1 - F.coalesce(F.col("failure_rate"), F.lit(0.0)))
    latency = F.coalesce(F.col("latency_ms"), F.lit(500.0))
    cost = F.coalesce(F.col("token_cost"), F.lit(1.0))
    score = F.round(success * 0.6 + 0.2 / (1 + latency / 1000) + 0.2 / (1 + cost), 6)
    return first_per_key(stats.select("task", "provider", score.alias("score")), ["task"],
                         [F.desc("score"), F.col("provider")])
