"""Analytics over the event log: token accounting, task roll-ups, trends, hints and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scale import first_per_key, ordered_scan, top_n, value_at_fraction

DAY_MS = 86_400_000


def effective_tokens() -> Column:
    """Reported tokens, else prompt plus completion, else prompt; completion alone counts nothing."""
    prompt = F.col("prompt_tokens_estimated")
    completion = F.col("completion_tokens_estimated")
    return F.coalesce(F.col("total_tokens_reported"), prompt + F.coalesce(completion, F.lit(0)), F.lit(0).cast("bigint"))


def wasted_tokens() -> Column:
    return F.when(F.col("status") == "error", F.greatest(
        effective_tokens(), F.coalesce(F.col("prompt_tokens_estimated"), F.lit(0)))).otherwise(F.lit(0).cast("bigint"))


def first_event_per_id(events: DataFrame) -> DataFrame:
    """Insert-or-ignore: the earliest row of each event id wins."""
    return first_per_key(events, ["event_id"], [F.col("ts_ms"), F.col("task_id")])


def token_hotspots(events: DataFrame, n: int = 10) -> DataFrame:
    """Top labels by token sum, for tools and for providers."""
    labels = F.explode(F.array(
        F.struct(F.lit("tool").alias("kind"), F.col("tool_name").alias("label")),
        F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("label"))))
    sums = (events.select(effective_tokens().alias("tokens"), labels.alias("l"))
            .filter(F.col("l.label").isNotNull())
            .groupBy("l.kind", "l.label").agg(F.sum("tokens").alias("tokens")))
    return top_n(sums, ["kind"], [F.desc("tokens"), F.col("label")], n, "rank")


def wasted_total(events: DataFrame) -> DataFrame:
    return events.agg(F.sum(wasted_tokens()).alias("wasted_tokens_estimated"))


def task_rollup(events: DataFrame) -> DataFrame:
    """One row per task: start, duration, tokens, outcome, repeated errors, waste, top category."""
    tagged = events.filter(F.col("task_id").isNotNull()).select(
        "task_id", "ts_ms", "event_id", "event_type", "category", "status", "error_code",
        effective_tokens().alias("tokens"), wasted_tokens().alias("wasted"))
    outcome = F.when(F.col("event_type").isin("task_completed", "task_failed"),
                     F.struct("ts_ms", "event_id"))
    fine = tagged.groupBy("task_id", "category").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.sum("tokens").alias("tokens"), F.sum("wasted").alias("wasted"),
        F.max(outcome).alias("last_outcome"),
        F.max_by("event_type", outcome).alias("outcome"))
    whole = fine.groupBy("task_id").agg(
        F.min("first_ms").alias("started_at"),
        (F.max("last_ms") - F.min("first_ms")).alias("duration_ms"),
        F.coalesce(F.max_by("outcome", "last_outcome") == "task_completed", F.lit(False)).alias("success"),
        F.sum("tokens").alias("total_tokens"), F.sum("wasted").alias("wasted_calls"),
        F.coalesce(F.min_by("category", F.when(F.col("category").isNotNull(),
                                               F.struct((-F.col("tokens")).alias("t"), F.col("category")))),
                   F.lit("uncategorized")).alias("top_category"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("category").isNotNull(), F.struct("category", "tokens"))))).alias("category_tokens"))
    repeats = (tagged.filter((F.col("status") == "error") & F.col("error_code").isNotNull())
               .groupBy("task_id", "error_code").agg((F.count("*") - 1).alias("extra"))
               .groupBy("task_id").agg(F.sum("extra").alias("repeated_errors")))
    return whole.join(repeats, "task_id", "left").withColumn(
        "repeated_errors", F.coalesce("repeated_errors", F.lit(0).cast("bigint")))


def daily_trend(events: DataFrame) -> DataFrame:
    """Tasks, tokens and success share per start day."""
    return (task_rollup(events)
            .groupBy(F.floor(F.col("started_at") / DAY_MS).cast("bigint").alias("day_index"))
            .agg(F.count("*").alias("tasks"), F.sum("total_tokens").alias("tokens"),
                 F.round(F.avg(F.col("success").cast("int")) * 100, 6).alias("success_rate_pct"))
            .withColumn("day", F.concat(F.lit("day-"), F.col("day_index").cast("string"))).drop("day_index"))


def task_timeline(events: DataFrame, task_ids: DataFrame | None = None) -> DataFrame:
    """Events of the wanted tasks with their effective tokens."""
    if task_ids is not None:
        events = events.join(task_ids, "task_id", "left_semi")
    return events.select("task_id", "ts_ms", "event_id", "event_type", "category", "tool_name", "provider",
                         "status", effective_tokens().alias("tokens"), "latency_ms", "error_code")


def task_hints(events: DataFrame) -> DataFrame:
    """Optimisation hints per task; tasks without a finding get the default hint."""
    tokens = effective_tokens()

    def total(category: str) -> Column:
        return F.sum(F.when(F.col("category") == category, tokens).otherwise(0))

    sums = events.filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(
        total("retrieval").alias("retrieval"), total("code_generation").alias("code"),
        total("wasted_calls").alias("wasted"))
    repeated = (events.filter(F.col("error_code").isNotNull() & F.col("task_id").isNotNull())
                .groupBy("task_id", "error_code").count().filter("count >= 2")
                .select("task_id").distinct().withColumn("repeats", F.lit(True)))
    hints = F.array_compact(F.array(
        F.when((F.col("retrieval") > F.col("code") * 2) & (F.col("retrieval") > 0), F.lit("retrieval_heavy")),
        F.when(F.col("repeats"), F.lit("repeated_error")),
        F.when(F.col("wasted") > 0, F.lit("wasted_calls"))))
    return (sums.join(repeated, "task_id", "left")
            .select("task_id", F.explode(F.when(F.size(hints) > 0, hints)
                                         .otherwise(F.array(F.lit("no_hotspot")))).alias("hint")))


def repeated_error_events(events: DataFrame) -> DataFrame:
    """Events that repeat an error already seen in their task: every one but the first."""
    errors = events.filter((F.col("status") == "error") & F.col("error_code").isNotNull())
    first = errors.groupBy("task_id", "error_code").agg(F.min(F.struct("ts_ms", "event_id")).alias("f"))
    return (errors.join(first, ["task_id", "error_code"])
            .filter(F.struct("ts_ms", "event_id") > F.col("f"))
            .select("task_id", "error_code", "event_id"))


def latest_samples(events: DataFrame, keep: int = 256) -> DataFrame:
    """The last ``keep`` latency samples of each operation."""
    return top_n(events.select("operation", "latency_ms", "ts_ms", "event_id"), ["operation"],
                 [F.desc("ts_ms"), F.desc("event_id")], keep)


def operation_latency(events: DataFrame, keep: int = 256) -> DataFrame:
    """Calls, mean, maximum and exact p95/p99 over the last ``keep`` samples per operation."""
    kept = latest_samples(events, keep)
    stats = kept.groupBy("operation").agg(
        F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"),
        F.max("latency_ms").alias("max_ms"))
    return stats.join(value_at_fraction(kept, ["operation"], "latency_ms",
                                        {"p95_ms": 0.95, "p99_ms": 0.99}), "operation")


def latency_alerts(latency: DataFrame, hits: Column, calls: Column, events: DataFrame,
                   min_hit_pct: float = 35.0, p95_ms: int = 60, p99_ms: int = 120) -> DataFrame:
    """Violated latency and cache-hit policies, one row per operation and rule; a rate of 0 means no cache in use."""
    ratio = events.groupBy("operation").agg(F.round(F.sum(hits) / F.sum(calls) * 100, 6).alias("hit_pct"))
    rules = F.array_compact(F.array(
        F.when((F.col("hit_pct") > 0) & (F.col("hit_pct") < min_hit_pct), F.struct(F.lit("cache_hit_rate").alias("rule"), F.col("hit_pct").alias("value"))),
        F.when(F.col("p95_ms") > p95_ms, F.struct(F.lit("p95").alias("rule"), F.col("p95_ms").cast("double").alias("value"))),
        F.when(F.col("p99_ms") > p99_ms, F.struct(F.lit("p99").alias("rule"), F.col("p99_ms").cast("double").alias("value")))))
    return (latency.join(ratio, "operation").select("operation", F.explode(rules).alias("r"))
            .select("operation", "r.rule", "r.value"))


def session_activity(events: DataFrame, gap_ms: int = 3_600_000) -> DataFrame:
    """Sessions per user, closed after ``gap_ms`` without events.

    Hour buckets keep a busy user on many tasks; a session may span any number of them.
    """
    rows = events.select("user_id", "event_id", "ts_ms", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    bucket = F.floor(F.col("us") / (gap_ms * 1000))
    order = ["us", "event_id"]
    seen = ordered_scan(rows, ["user_id"], order, bucket, lag={"prev": "us"})
    opens = F.when(F.col("us") - F.col("prev") <= gap_ms * 1000, 0).otherwise(1)
    numbered = ordered_scan(seen.withColumn("opens", opens), ["user_id"], order, bucket, running_sum={"session": "opens"})
    return numbered.groupBy("user_id", "session").agg(
        F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms")).drop("session")
