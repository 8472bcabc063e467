"""Quality gates: baseline comparison, movers, worst cases, trends, drift and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .outcomes import share
from .scale import ordered_scan, top_n, value_at_fraction

# Tolerances of the regression rules.
LATENCY_PCT, LATENCY_ABS_MS, TINY_BASE_MS, TINY_ABS_MS, CEILING_JITTER_MS = 0.25, 16.0, 5.0, 30.0, 5.0
TOKEN_PCT, EPSILON = 0.20, 1e-6
P95_REGRESSION_MS, P95_IMPROVEMENT_MS, FIXTURE_REGRESSION_MS, FIXTURE_IMPROVEMENT_MS = 1.0, 5.0, 2.0, 6.0
# Latency health limits.
MIN_P95_MS, MIN_AVG_MS, DRIFT_P95_MS, DRIFT_AVG_MS, WATCH_P95_MS, WATCH_AVG_MS = 8.0, 5.0, 5.0, 3.0, 1.0, 0.75

# Rule that applies to each summary metric.
RULES = {"target_match_rate": "non_decreasing", "top_file_match_rate": "non_decreasing", "top_span_match_rate": "non_decreasing",
         "omission_rate": "non_increasing", "overfetch_rate": "non_increasing", "avg_latency_ms": "latency",
         "p95_latency_ms": "latency", "avg_tokens": "tokens", "max_tokens": "tokens"}
FIXTURE_MODES = ("incomplete", "missing_files", "extra_files", "missing_symbols", "extra_symbols")
REPORTED_RATE = 0.005
DRIFT_MODES = ("missing_files", "extra_files", "missing_symbols", "extra_symbols")


def metric_rows(cases: DataFrame) -> DataFrame:
    """Long form (run, fixture, scope, metric, value): per fixture overall and per bucket."""
    both = cases.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("bucket"))))
    keys = ["run", "fixture", "scope"]
    wide = both.groupBy(*keys).agg(
        share(F.col("target_match")).alias("target_match_rate"), share(F.col("top_file_match")).alias("top_file_match_rate"),
        share(F.col("top_span_match")).alias("top_span_match_rate"), F.round(F.avg("omission_count"), 6).alias("omission_rate"),
        F.round(F.avg("overfetch_count"), 6).alias("overfetch_rate"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.avg("approx_tokens"), 4).alias("avg_tokens"), F.max("approx_tokens").cast("double").alias("max_tokens"))
    wide = wide.join(value_at_fraction(both, keys, "latency_ms", {"p95_latency_ms": 0.95}), keys)
    return wide.unpivot(keys, list(RULES), "metric", "value")


def compare_runs(metrics: DataFrame, baseline: str = "baseline", current: str = "current") -> DataFrame:
    """Every baseline metric with its current value; a missing counterpart stays visible."""
    keys = ["fixture", "scope", "metric"]
    base = metrics.filter(F.col("run") == baseline).select(*keys, F.col("value").alias("base"))
    now = metrics.filter(F.col("run") == current).select(*keys, F.col("value").alias("now"))
    return base.join(now, keys, "left")


def allowed_value(metric: Column, base: Column, ceiling: Column | None = None) -> Column:
    """Largest tolerated value of a latency or token metric."""
    slack = F.when(base <= TINY_BASE_MS, TINY_ABS_MS).otherwise(LATENCY_ABS_MS)
    latency = F.greatest(base * (1 + LATENCY_PCT), base + slack)
    if ceiling is not None:
        latency = F.coalesce(F.greatest(latency, ceiling + CEILING_JITTER_MS), latency)
    return F.when(metric.contains("latency"), latency).otherwise(base * (1 + TOKEN_PCT))


def _rule() -> Column:
    pairs = [F.lit(x) for kv in RULES.items() for x in kv]
    return F.create_map(*pairs)[F.col("metric")]


def regressions(compared: DataFrame) -> DataFrame:
    """Violated rules of a baseline comparison."""
    rule, base, now = _rule(), F.col("base"), F.col("now")
    bad = (F.when(now.isNull(), "missing")
           .when((rule == "non_decreasing") & (now + EPSILON < base), "decreased")
           .when((rule == "non_increasing") & (now > base + EPSILON), "increased")
           .when(rule.isin("latency", "tokens") & (base > EPSILON) & (now > allowed_value(F.col("metric"), base)), "beyond_tolerance"))
    return compared.withColumn("failure", bad).filter("failure IS NOT NULL")


def improvements(compared: DataFrame) -> DataFrame:
    """Metrics that got better by more than the rounding slack."""
    better = F.when(_rule() == "non_decreasing", F.col("now") > F.col("base") + EPSILON).otherwise(
        F.col("now") + EPSILON < F.col("base"))
    return compared.filter(better)


def p95_movers(compared: DataFrame) -> DataFrame:
    """Fixtures whose p95 moved materially: count and largest move per direction."""
    delta = F.round(F.col("now") - F.col("base"), 6)
    moved = compared.filter((F.col("metric") == "p95_latency_ms") & F.col("now").isNotNull()).withColumn("delta", delta)
    direction = (F.when(F.col("delta") > P95_REGRESSION_MS, "regression")
                 .when(F.col("delta") < -P95_IMPROVEMENT_MS, "improvement"))
    moved = moved.withColumn("direction", direction).filter("direction IS NOT NULL")
    out = moved.groupBy("fixture", "direction").agg(F.count("*").alias("moves"), F.max(F.abs("delta")).alias("max_ms"))
    limit = F.when(F.col("direction") == "regression", FIXTURE_REGRESSION_MS).otherwise(FIXTURE_IMPROVEMENT_MS)
    return out.filter(F.col("max_ms") >= limit)


def worst_cases(cases: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` worst cases per key by latency and by tokens."""
    both = cases.withColumn("m", F.explode(F.array(
        F.struct(F.lit("latency").alias("metric"), F.col("latency_ms").cast("double").alias("value")),
        F.struct(F.lit("tokens").alias("metric"), F.col("approx_tokens").cast("double").alias("value")))))
    flat = both.select(*keys, "m.metric", "m.value", "fixture", "case_name").distinct()
    return top_n(flat, [*keys, "metric"], [F.desc("value"), F.col("fixture"), F.col("case_name")], n, "rank")


def hotspot_changes(worst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases that entered the worst set materially, or got materially worse inside it."""
    ident = [*keys, "metric", "fixture", "case_name"]
    now = worst.filter("run = 'current'")
    before = worst.filter("run = 'baseline'").select(*ident, F.col("value").alias("previous")).groupBy(*ident).agg(F.max("previous").alias("previous"))
    group = [*keys, "metric"]
    cut = worst.filter("run = 'baseline'").select(*group, "rank", F.col("value").alias("cutoff"))
    last = cut.groupBy(*group).agg(F.max_by("cutoff", "rank").alias("last_cutoff"))
    joined = (now.join(before, ident, "left").join(cut, [*group, "rank"], "left").join(last, group, "left")
              .withColumn("cutoff", F.coalesce("cutoff", "last_cutoff")))
    delta = F.col("value") - F.col("previous")
    latency = F.col("metric") == "latency"
    grew = F.when(latency, delta > LATENCY_ABS_MS).otherwise(
        delta > F.greatest(F.ceil(F.col("previous") * TOKEN_PCT), F.lit(25)))
    limit = F.when(latency, F.greatest(F.col("cutoff") * (1 + LATENCY_PCT), F.col("cutoff") + LATENCY_ABS_MS)).otherwise(
        F.greatest(F.ceil(F.col("cutoff") * (1 + TOKEN_PCT)), F.col("cutoff") + 25))
    entered = F.col("cutoff").isNull() | (F.col("value") > limit)
    change = F.when(F.col("previous").isNotNull(), F.when(grew, "grew")).when(entered, "entered")
    return joined.withColumn("change", change).filter("change IS NOT NULL").select(
        *group, "rank", "fixture", "case_name", "value", "previous", "change")


def threshold_violations(values: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows outside the minimum or maximum given for their metric."""
    bad = (F.when(F.col("min_value").isNotNull() & (F.col("value") + EPSILON < F.col("min_value")), "below_minimum")
           .when(F.col("max_value").isNotNull() & (F.col("value") > F.col("max_value") + EPSILON), "above_maximum"))
    return values.join(thresholds, list(keys)).withColumn("violation", bad).filter("violation IS NOT NULL")


def case_report(results: DataFrame) -> DataFrame:
    """Target, top file and span matches with omission and overfetch counts; no expectation is a match."""
    def match(actual: str, expected: str) -> Column:
        return F.col(expected).isNull() | F.coalesce(F.col(actual) == F.col(expected), F.lit(False))
    span = match("top_file", "expected_file") & match("top_start", "expected_start") & match("top_end", "expected_end")
    return results.select(
        "case_name", match("symbol", "expected_symbol").alias("target_match"), match("top_file", "expected_file").alias("top_file_match"),
        span.alias("top_span_match"), F.size(F.array_except("must_include", "files")).alias("omission_count"),
        F.size(F.array_intersect("must_not_include", "files")).alias("overfetch_count"))


# ---- history -------------------------------------------------------------------------------

def capped_history(runs: DataFrame, keep: int = 25) -> DataFrame:
    return top_n(runs, ["suite"], [F.desc("run_id")], keep)


def trailing_average(runs: DataFrame, metrics: Sequence[str], n: int = 3) -> DataFrame:
    """Mean of the ``n`` runs before each run."""
    win = W.partitionBy("suite").orderBy("run_id").rowsBetween(-n, -1)
    return runs.withColumns({f"trailing_{m}": F.avg(m).over(win) for m in metrics})


def trend_direction(runs: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """Newest against oldest of the last ``n`` runs."""
    win = W.partitionBy("suite").orderBy("run_id")
    oldest = F.first(metric).over(win.rowsBetween(-(n - 1), 0))
    delta = F.col(metric) - oldest
    label = (F.when(F.row_number().over(win) < 2, "insufficient history").when(delta > 1.0, "worsening")
             .when(delta < -1.0, "improving").otherwise("flat"))
    return runs.withColumn("direction", label)


def drift_peak(prefix: str = "") -> Column:
    return F.greatest(*[F.col(f"{prefix}{m}_rate") for m in DRIFT_MODES])


def run_health(runs: DataFrame) -> DataFrame:
    """Latency health, drift score and health, diagnosis, recommendation and priority of every run."""
    metrics = ["avg_latency_ms", "p95_latency_ms", *[f"{m}_rate" for m in DRIFT_MODES]]
    h = trailing_average(runs, metrics)
    have = F.col("trailing_avg_latency_ms").isNotNull()
    d95 = F.col("p95_latency_ms") - F.col("trailing_p95_latency_ms")
    davg = F.col("avg_latency_ms") - F.col("trailing_avg_latency_ms")
    calm = (F.col("p95_latency_ms") <= MIN_P95_MS) & (F.col("avg_latency_ms") <= MIN_AVG_MS)
    marker = (F.when(F.col("status") != "clean", "drifting").when(~have, "stable").when(calm, "stable")
              .when((d95 > DRIFT_P95_MS) | (davg > DRIFT_AVG_MS), "drifting")
              .when((d95 > WATCH_P95_MS) | (davg > WATCH_AVG_MS), "watch").otherwise("stable"))
    win = W.partitionBy("suite").orderBy("run_id")
    h = h.withColumn("marker", marker)
    h = h.withColumns({"previous_marker": F.lag("marker").over(win), "nth": F.row_number().over(win)})
    persistent = (F.col("nth") >= 3) & F.col("previous_marker").isin("watch", "drifting")
    latency = F.when((F.col("marker") == "drifting") & (F.col("status") == "clean") & ~persistent, "watch").otherwise(F.col("marker"))
    peak, base = drift_peak(), F.when(have, drift_peak("trailing_")).otherwise(drift_peak())
    score = peak * 100 + F.greatest(peak - base, F.lit(0.0)) * 100
    h = h.withColumns({
        "latency_health": latency,
        "latency_score": F.round(F.when(have, F.greatest(d95, F.lit(0.0)) + 0.5 * F.greatest(davg, F.lit(0.0))).otherwise(0.0), 6),
        "drift_score": F.round(score, 6), "drift_delta": score - base * 100})
    h = h.withColumn("drift_health", F.when((F.col("drift_score") > 15) | (F.col("drift_delta") > 10), "drifting")
                     .when((F.col("drift_score") > 0) | (F.col("drift_delta") > 0), "watch").otherwise("stable"))
    worst = lambda level: (F.col("marker") == level) | (F.col("drift_health") == level)
    lat_bad, graph_bad = F.col("latency_health") != "stable", F.col("drift_health") != "stable"
    h = h.withColumns({
        "overall": F.when((F.col("status") != "clean") | worst("drifting"), "drifting").when(worst("watch"), "watch").otherwise("stable"),
        "diagnosis": F.when(lat_bad & graph_bad, "mixed_drift").when(lat_bad, "latency_only_drift")
        .when(graph_bad, "graph_only_drift").otherwise("clean")})
    diagnosis = F.col("diagnosis")
    severe_lat, severe_graph = F.col("latency_health") == "drifting", F.col("drift_health") == "drifting"
    return h.withColumns({
        "recommendation": F.when(diagnosis == "clean", "no_action").when(diagnosis == "mixed_drift", "investigate_mixed_regression")
        .when(diagnosis == "latency_only_drift", F.when(severe_lat, "investigate_latency_regression").otherwise("watch_latency"))
        .otherwise(F.when(severe_graph, "inspect_graph_drift").otherwise("watch_graph_drift")),
        "action_priority": F.when(diagnosis == "clean", "none").when(diagnosis == "mixed_drift", "high")
        .when(diagnosis == "graph_only_drift", F.when(severe_graph, "high").otherwise("medium"))
        .otherwise(F.when(severe_lat, "medium").otherwise("low"))})


def persistent_drift(health: DataFrame) -> DataFrame:
    """Runs that drift and whose previous run was already under watch, from the third run on."""
    return health.filter((F.col("marker") == "drifting") & (F.col("nth") >= 3)
                         & F.col("previous_marker").isin("watch", "drifting"))


def leading_drift(runs: DataFrame) -> DataFrame:
    """Leading drift mode of every run and its trend against the trailing average."""
    rates = [f"{m}_rate" for m in DRIFT_MODES]
    h = trailing_average(runs, rates)

    def leader(prefix: str) -> Column:
        # later modes win only when strictly larger
        best = F.struct(F.lit(None).cast("string").alias("mode"), F.lit(EPSILON).alias("rate"))
        for m in DRIFT_MODES:
            rate = F.coalesce(F.col(f"{prefix}{m}_rate"), F.lit(0.0))
            best = F.when(rate > best["rate"], F.struct(F.lit(m).alias("mode"), rate.alias("rate"))).otherwise(best)
        return best

    h = h.withColumns({"now": leader(""), "then": leader("trailing_")})
    trailing = F.coalesce(*[F.when(F.col("now.mode") == m, F.col(f"trailing_{m}_rate")) for m in DRIFT_MODES], F.lit(0.0))
    delta = F.col("now.rate") - trailing
    trend = (F.when(F.col("now.mode").isNull(), F.when(F.col("then.mode").isNotNull(), "cleared"))
             .when(trailing <= EPSILON, "new").when(delta > 0.01, "worsening").when(delta < -0.01, "improving").otherwise("flat"))
    return h.select("suite", "run_id", F.coalesce("now.mode", "then.mode").alias("mode"), trend.alias("trend"),
                    F.round(F.when(F.col("now.mode").isNull(), 0.0).otherwise(delta * 100), 6).alias("delta_points"))


def leading_fixture(fixture_runs: DataFrame, n: int = 3) -> DataFrame:
    """Fixture that drifts most in every run and its trend against its own mean over the ``n`` runs before.

    A fixture leads with its largest mode, the later of two equal ones; a run with the first by name of its largest
    fixtures. Fixtures without cases that change code take no part, and runs in which a fixture takes no part do not
    count towards its mean. A run without drift reports the largest fixture of the runs before as cleared (the oldest
    run, then the last name of equal ones), if there is one above the reporting limit; otherwise it has no row.

    Every run meets the runs before it by its number, so a long history is a join on (suite, number) and no window.
    """
    best = F.struct(F.lit(EPSILON).alias("rate"), F.lit(None).cast("string").alias("mode"))
    for m in FIXTURE_MODES:
        rate = F.coalesce(f"{m}_rate", F.lit(0.0))
        best = F.when((rate > EPSILON) & (rate >= best["rate"]), F.struct(rate.alias("rate"), F.lit(m).alias("mode"))).otherwise(best)
    runs = fixture_runs.select("suite", "run_id").distinct().withColumn("one", F.lit(1))
    numbers = ordered_scan(runs, ["suite"], ["run_id"], F.floor(F.col("run_id") / 4096), running_sum={"nth": "one"}).drop("one")
    entries = fixture_runs.filter("mutation_case_count > 0").withColumn("_best", best).select(
        "suite", "run_id", "fixture", F.col("_best.mode").alias("mode"), F.when(F.col("_best.mode").isNull(), 0.0).otherwise(F.col("_best.rate")).alias("rate"))
    entries = entries.join(numbers, ["suite", "run_id"])
    drifting = entries.filter("mode IS NOT NULL")
    leaders = drifting.groupBy("suite", "run_id", "nth").agg(
        F.min_by(F.struct("fixture", "mode", "rate"), F.struct(-F.col("rate"), F.col("fixture"))).alias("top")).select("suite", "run_id", "nth", "top.*")
    past = entries.select("suite", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("age"), "fixture", "mode", "rate", F.col("nth").alias("at"))
    past = past.withColumn("nth", F.col("at") + F.col("age")).drop("at")
    trail = past.join(leaders.select("suite", "nth", "fixture"), ["suite", "nth", "fixture"], "left_semi").groupBy("suite", "nth", "fixture").agg(F.avg("rate").alias("trail"))
    now = leaders.join(trail, ["suite", "nth", "fixture"], "left").withColumn("trail", F.coalesce("trail", F.lit(0.0)))
    points = (F.col("rate") - F.col("trail")) * 100
    trend = F.when(F.col("trail") <= EPSILON, "new").when(points > 1.0, "worsening").when(points < -1.0, "improving").otherwise("flat")
    now = now.select("suite", "run_id", "fixture", "mode", F.round("rate", 6).alias("rate"), trend.alias("trend"), F.round(points, 6).alias("delta_points"))
    calm = numbers.join(leaders.select("suite", "nth"), ["suite", "nth"], "left_anti")
    before = past.filter(F.col("rate") > REPORTED_RATE).join(calm, ["suite", "nth"])
    cleared = before.groupBy("suite", "run_id").agg(F.max(F.struct("rate", "age", "fixture", "mode")).alias("top"))
    return now.unionByName(cleared.select(
        "suite", "run_id", "top.fixture", "top.mode", F.lit(0.0).alias("rate"), F.lit("cleared").alias("trend"), F.round(-F.col("top.rate") * 100, 6).alias("delta_points")))
