"""Aggregation queries."""

from pyspark.sql import functions as F

from .registry import query
from ..operators import events as ev, outcomes as oc, scale, summaries as sm

TOK = """COALESCE(total_tokens_reported, prompt_tokens_estimated + COALESCE(completion_tokens_estimated, 0), 0)"""
WASTE = f"CASE WHEN status = 'error' THEN greatest({TOK}, COALESCE(prompt_tokens_estimated, 0)) ELSE 0 END"
OK = "(approved_by_user AND validation_passed AND tests_passed AND NOT rollback_occurred)"


def pct(values: str, total: str, p: float) -> str:
    """Value at position min(floor(n*p), n-1) of a sorted list."""
    return f"list_extract(list_sort({values}), CAST(least(floor({total} * CAST({p} AS DOUBLE)), {total} - 1) AS BIGINT) + 1)"


@query("d01_hot_labels", f"""
WITH e AS (SELECT tool_name, provider, {TOK} AS tokens FROM m_telemetry),
s AS (SELECT 'tool' AS kind, tool_name AS label, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY 1, 2
      UNION ALL SELECT 'provider', provider, CAST(sum(tokens) AS BIGINT) FROM e GROUP BY 1, 2)
SELECT kind, label, tokens, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tokens DESC, label) AS r FROM s WHERE label IS NOT NULL) WHERE r <= 10""")
def _(t):
    return ev.token_hotspots(t.telemetry)


@query("d01_wasted_tokens", f"SELECT CAST(sum({WASTE}) AS BIGINT) AS wasted_tokens_estimated FROM m_telemetry")
def _(t):
    return ev.wasted_total(t.telemetry)


TASKS = f"""
e AS (SELECT *, {TOK} AS tokens, {WASTE} AS wasted FROM m_telemetry WHERE task_id IS NOT NULL),
base AS (SELECT task_id, min(ts_ms) AS started_at, max(ts_ms) - min(ts_ms) AS duration_ms,
           CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(wasted) AS BIGINT) AS wasted_calls,
           CAST(count(CASE WHEN status = 'error' THEN error_code END)
                - count(DISTINCT CASE WHEN status = 'error' THEN error_code END) AS BIGINT) AS repeated_errors FROM e GROUP BY 1),
outc AS (SELECT task_id, event_type = 'task_completed' AS success FROM (
           SELECT task_id, event_type, row_number() OVER (PARTITION BY task_id ORDER BY ts_ms DESC, event_id DESC) AS r
           FROM e WHERE event_type IN ('task_completed', 'task_failed')) WHERE r = 1),
cat AS (SELECT task_id, category, CAST(sum(tokens) AS BIGINT) AS tokens FROM e WHERE category IS NOT NULL GROUP BY 1, 2),
top AS (SELECT task_id, category AS top_category FROM (
          SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tokens DESC, category) AS r FROM cat) WHERE r = 1),
cats AS (SELECT task_id, string_agg(category || '=' || CAST(tokens AS STRING), ',' ORDER BY category) AS categories FROM cat GROUP BY 1),
tasks AS (SELECT base.*, COALESCE(success, false) AS success, COALESCE(top_category, 'uncategorized') AS top_category,
            COALESCE(categories, '') AS categories
          FROM base LEFT JOIN outc USING (task_id) LEFT JOIN top USING (task_id) LEFT JOIN cats USING (task_id))"""


@query("d02_task_rollup", f"WITH {TASKS} SELECT * FROM tasks")
def _(t):
    rolled = ev.task_rollup(t.telemetry)
    pairs = F.transform(F.array_sort(F.map_entries("category_tokens")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rolled.withColumn("categories", F.array_join(pairs, ",")).drop("category_tokens")


@query("d03_daily_trend", f"""
WITH {TASKS} SELECT 'day-' || CAST(CAST(floor(started_at / 86400000) AS BIGINT) AS STRING) AS day, count(*) AS tasks,
  CAST(sum(total_tokens) AS BIGINT) AS tokens, round(avg(CAST(success AS INT)) * 100, 6) AS success_rate_pct FROM tasks GROUP BY 1""")
def _(t):
    return ev.daily_trend(t.telemetry)


@query("d04_task_timeline", f"""SELECT task_id, ts_ms, event_id, event_type, category, tool_name, provider, status,
  {TOK} AS tokens, latency_ms, error_code FROM m_telemetry""")
def _(t):
    return ev.task_timeline(t.telemetry)


@query("d04_task_hints", f"""
WITH e AS (SELECT *, {TOK} AS tokens FROM m_telemetry WHERE task_id IS NOT NULL),
s AS (SELECT task_id, sum(CASE WHEN category = 'retrieval' THEN tokens ELSE 0 END) AS r,
        sum(CASE WHEN category = 'code_generation' THEN tokens ELSE 0 END) AS c,
        sum(CASE WHEN category = 'wasted_calls' THEN tokens ELSE 0 END) AS w FROM e GROUP BY 1),
rep AS (SELECT DISTINCT task_id FROM (SELECT task_id, error_code FROM e WHERE error_code IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)),
h AS (SELECT task_id, 'retrieval_heavy' AS hint FROM s WHERE r > 2 * c AND r > 0
      UNION ALL SELECT task_id, 'repeated_error' FROM rep
      UNION ALL SELECT task_id, 'wasted_calls' FROM s WHERE w > 0)
SELECT * FROM h UNION ALL SELECT task_id, 'no_hotspot' FROM s WHERE task_id NOT IN (SELECT task_id FROM h)""")
def _(t):
    return ev.task_hints(t.telemetry)


@query("d05_effective_tokens", f"SELECT event_id, {TOK} AS tokens, {WASTE} AS wasted FROM m_telemetry")
def _(t):
    return t.telemetry.select("event_id", ev.effective_tokens().alias("tokens"), ev.wasted_tokens().alias("wasted"))


@query("d06_patch_statistics", f"""
WITH p AS (SELECT *, {OK} AS ok FROM m_patches)
SELECT CASE WHEN g = 3 THEN 'overall' WHEN g = 1 THEN 'model' ELSE 'edit_type' END AS scope,
  COALESCE(model_used, edit_type, 'all') AS label, total, success_rate, rollback_rate FROM (
  SELECT model_used, edit_type, grouping_id(model_used, edit_type) AS g, count(*) AS total,
    round(avg(CAST(ok AS DOUBLE)), 6) AS success_rate, round(avg(CAST(rollback_occurred AS DOUBLE)), 6) AS rollback_rate
  FROM p GROUP BY GROUPING SETS ((), (model_used), (edit_type)))""")
def _(t):
    return oc.patch_statistics(t.patches)


@query("d07_model_performance", f"""
SELECT model_used, count(*) AS patches, round(avg(CAST({OK} AS DOUBLE)), 6) AS success_rate FROM m_patches GROUP BY 1""")
def _(t):
    return oc.model_performance(t.patches)


@query("d08_edit_risk", f"""
WITH k AS (SELECT DISTINCT edit_type FROM m_patches UNION SELECT DISTINCT l_linestatus || l_returnflag FROM lineitem),
r AS (SELECT edit_type, round(avg(CAST(NOT {OK} AS DOUBLE)), 6) AS risk FROM m_patches GROUP BY 1)
SELECT edit_type, COALESCE(risk, CAST(0 AS DOUBLE)) AS risk FROM k LEFT JOIN r USING (edit_type)""")
def _(t):
    other = t.lineitem.select(F.concat("l_linestatus", "l_returnflag").alias("edit_type"))
    return oc.edit_risk(t.patches, t.patches.select("edit_type").unionByName(other).distinct())


@query("d09_history_export", f"SELECT patch_id, ts_ms, repository, target_symbol, model_used, {OK} AS ok FROM m_patches")
def _(t):
    return oc.history_export(t.patches)


@query("d09_model_trends", f"""SELECT model_used, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS patches,
  round(avg(CAST({OK} AS DOUBLE)), 6) AS success_rate FROM m_patches JOIN orders ON patch_id = o_orderkey GROUP BY 1, 2""")
def _(t):
    return oc.model_trends(t.patches)


QUALITY = """count(*) AS case_count, round(avg(CAST(target_match AS DOUBLE)), 6) AS target_match_rate,
  round(avg(CAST(top_file_match AS DOUBLE)), 6) AS top_file_match_rate, round(avg(CAST(top_span_match AS DOUBLE)), 6) AS top_span_match_rate,
  round(avg(omission_count), 6) AS omission_rate, round(avg(overfetch_count), 6) AS overfetch_rate,
  round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(approx_tokens), 4) AS avg_tokens, max(approx_tokens) AS max_tokens"""


@query("d10_retrieval_quality", f"""
WITH c AS (SELECT 'overall' AS scope, * FROM m_cases UNION ALL SELECT bucket AS scope, * FROM m_cases WHERE bucket <> '')
SELECT scope, {QUALITY}, {pct('list(latency_ms)', 'count(*)', 0.95)} AS p95_latency_ms FROM c GROUP BY 1""")
def _(t):
    return oc.retrieval_quality(t.cases)


@query("d11_route_quality", """
SELECT COALESCE(intent, 'overall') AS scope, count(*) AS case_count,
  count(CASE WHEN intent0 IN ('implement', 'refactor') THEN 1 END) AS mutation_case_count,
  round(avg(CAST(target_match AS DOUBLE)), 6) AS target_match_rate, round(avg(CAST(top_file_match AS DOUBLE)), 6) AS top_file_match_rate,
  round(COALESCE(avg(CASE WHEN intent0 IN ('implement', 'refactor') THEN CAST(top_span_match AS DOUBLE) END), CAST(0 AS DOUBLE)), 6) AS mutation_top_span_match_rate,
  round(COALESCE(avg(CASE WHEN intent0 IN ('implement', 'refactor') THEN CAST(target_match AS DOUBLE) END), CAST(0 AS DOUBLE)), 6) AS mutation_target_match_rate,
  round(avg(latency_ms), 6) AS avg_latency_ms, max(approx_tokens) AS max_tokens
FROM (SELECT *, intent AS intent0 FROM m_cases) GROUP BY ROLLUP (intent)""")
def _(t):
    return oc.route_quality(t.cases, ["target_match", "top_file_match"], mutation_flags=["top_span_match", "target_match"])


MUTATES = "intent IN ('implement', 'refactor')"
ROUTE_RATES = ", ".join(
    [f"round(avg(CAST({f} AS DOUBLE)), 6) AS {f}_rate" for f in oc.CASE_FLAGS]
    + [f"round(COALESCE(avg(CASE WHEN {MUTATES} THEN CAST({f} AS DOUBLE) END), CAST(0 AS DOUBLE)), 6) AS mutation_{f}_rate" for f in oc.MUTATION_FLAGS])


@query("d11_route_report", f"""
WITH c AS (SELECT *, bundle_status = 'exact_ready' AS exact_ready, state = 'blocked' AS blocked FROM m_route_cases),
s AS (SELECT *, 'overall' AS scope FROM c UNION ALL SELECT *, intent AS scope FROM c)
SELECT scope, count(*) AS case_count, count(CASE WHEN {MUTATES} THEN 1 END) AS mutation_case_count, {ROUTE_RATES},
  round(avg(latency_ms), 6) AS avg_latency_ms, max(approx_tokens) AS max_tokens, round(avg(approx_tokens), 4) AS avg_tokens,
  {pct('list(latency_ms)', 'count(*)', 0.95)} AS p95_latency_ms FROM s GROUP BY 1""")
def _(t):
    return oc.route_report(t.route_cases)


@query("d12_weighted_mean", """
SELECT fixture, round(CAST(sum(CAST(latency_ms AS BIGINT) * approx_tokens) AS DOUBLE) / CAST(sum(approx_tokens) AS DOUBLE), 6) AS weighted_mean
FROM m_cases WHERE approx_tokens <> 0 GROUP BY 1""")
def _(t):
    cases = t.cases.withColumn("latency", F.col("latency_ms").cast("bigint"))
    return oc.weighted_mean(cases, ["fixture"], "latency", "approx_tokens")


@query("d13_dominant_language", """
WITH c AS (SELECT repo, lang, count(lang) AS n FROM m_docs GROUP BY 1, 2)
SELECT repo, COALESCE(lang, 'unknown') AS dominant FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, lang) AS r FROM c) WHERE r = 1""")
def _(t):
    return oc.dominant_label(t.docs, "repo", "lang")


@query("d14_module_symbol_counts", """
SELECT module, count(*) AS symbols, count(CASE WHEN starts_with(name, 'get') OR starts_with(name, 'set') OR starts_with(name, 'handle') THEN 1 END) AS entry_style,
  count(CASE WHEN type = 'function' THEN 1 END) AS functions FROM m_symbols JOIN m_modules USING (file) GROUP BY 1""")
def _(t):
    return sm.module_symbol_counts(t.symbols, t.modules)


@query("d15_module_fan_out", """
SELECT from_module AS module, count(DISTINCT to_module) AS targets, count(*) AS edges FROM m_module_edges GROUP BY 1""")
def _(t):
    return sm.fan_out(t.module_edges)


@query("d16_duplicate_lengths", """
SELECT symbol_id, name, file, CAST(len AS INT) AS length, n AS group_size FROM (
  SELECT symbol_id, name, file, end_line - start_line + 1 AS len, count(*) OVER (PARTITION BY end_line - start_line + 1) AS n
  FROM m_symbols WHERE type = 'function') WHERE len > 20 AND n > 2""")
def _(t):
    return sm.duplicate_lengths(t.symbols)


@query("d17_shared_libraries", """
SELECT to_repo AS library, count(DISTINCT from_repo) AS dependents, 'potential version mismatch' AS label
FROM m_repo_edges GROUP BY 1 HAVING count(DISTINCT from_repo) >= 2""")
def _(t):
    return sm.shared_libraries(t.repo_edges)


@query("d18_callee_hot_list", """
SELECT callee_symbol, count(*) AS calls FROM m_calls GROUP BY 1 ORDER BY calls DESC, callee_symbol LIMIT 5""")
def _(t):
    return sm.hot_callees(t.calls)


@query("d20_operation_latency", f"""
WITH k AS (SELECT operation, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts_ms DESC, event_id DESC) AS r
           FROM m_telemetry) WHERE r <= 256)
SELECT operation, count(*) AS calls, round(avg(latency_ms), 6) AS avg_ms, max(latency_ms) AS max_ms,
  {pct('list(latency_ms)', 'count(*)', 0.95)} AS p95_ms, {pct('list(latency_ms)', 'count(*)', 0.99)} AS p99_ms FROM k GROUP BY 1""")
def _(t):
    return ev.operation_latency(t.telemetry)


@query("d21_latency_alerts", f"""
WITH k AS (SELECT operation, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts_ms DESC, event_id DESC) AS r
           FROM m_telemetry) WHERE r <= 256),
s AS (SELECT operation, {pct('list(latency_ms)', 'count(*)', 0.95)} AS p95, {pct('list(latency_ms)', 'count(*)', 0.99)} AS p99 FROM k GROUP BY 1),
h AS (SELECT operation, round(CAST(count(CASE WHEN total_tokens_reported < 25 THEN 1 END) AS DOUBLE) / count(*) * 100, 6) AS hit FROM m_telemetry GROUP BY 1)
SELECT operation, 'cache_hit_rate' AS rule, hit AS value FROM h WHERE hit > 0 AND hit < 35
UNION ALL SELECT operation, 'p95', CAST(p95 AS DOUBLE) FROM s WHERE p95 > 60
UNION ALL SELECT operation, 'p99', CAST(p99 AS DOUBLE) FROM s WHERE p99 > 120""")
def _(t):
    hit = F.when(F.col("total_tokens_reported") < 25, 1).otherwise(0)
    return ev.latency_alerts(ev.operation_latency(t.telemetry), hit, F.lit(1), t.telemetry)


@query("d22_experiment_summary", """
WITH p AS (SELECT o_orderpriority AS suite, CAST(floor(o_totalprice / 10) AS BIGINT) AS tokens_without,
    CAST(floor(o_totalprice / 12) AS BIGINT) + o_custkey AS tokens_with, o_orderkey % 7 AS file_mentions, o_custkey % 5 AS impacted_files,
    o_orderkey % 4 AS hits_without, o_custkey % 4 AS hits_with, o_orderstatus <> 'F' AS validated, o_custkey % 3 <> 0 AS target_match FROM orders),
s AS (SELECT suite, count(*) AS task_count, CAST(sum(tokens_without) AS BIGINT) AS tokens_without, CAST(sum(tokens_with) AS BIGINT) AS tokens_with,
    CAST(sum(4 + least(file_mentions, 3)) AS BIGINT) AS steps_without,
    CAST(sum(3 + least(impacted_files, 3) + CAST(hits_with = 0 AS BIGINT)) AS BIGINT) AS steps_with,
    count(CASE WHEN hits_without >= 2 THEN 1 END) AS success_without, count(CASE WHEN hits_with >= 2 THEN 1 END) AS success_with,
    count(CASE WHEN hits_with >= 2 AND validated THEN 1 END) AS validated_success_with,
    round(avg(CAST(target_match AS DOUBLE)), 6) AS target_match_rate, round(avg(CAST(impacted_files = 0 AS DOUBLE)), 6) AS empty_ref_rate,
    round(avg(CAST(tokens_with > tokens_without AS DOUBLE)), 6) AS prompt_over_control_rate,
    round(avg(CAST(NOT target_match AND hits_with < 2 AS DOUBLE)), 6) AS misdirection_rate FROM p GROUP BY 1),
r AS (SELECT *, round(CAST(tokens_without - tokens_with AS DOUBLE) / CAST(tokens_without AS DOUBLE) * 100, 6) AS savings_pct,
    round(CAST(steps_without - steps_with AS DOUBLE) / CAST(steps_without AS DOUBLE) * 100, 6) AS step_savings_pct FROM s)
SELECT *, savings_pct < -25 OR step_savings_pct < -10 AS regression_alert FROM r""")
def _(t):
    tasks = t.orders.selectExpr(
        "o_orderpriority AS suite", "CAST(floor(o_totalprice / 10) AS BIGINT) AS tokens_without",
        "CAST(floor(o_totalprice / 12) AS BIGINT) + o_custkey AS tokens_with", "o_orderkey % 7 AS file_mentions",
        "o_custkey % 5 AS impacted_files", "o_orderkey % 4 AS hits_without", "o_custkey % 4 AS hits_with",
        "o_orderstatus <> 'F' AS validated", "o_custkey % 3 <> 0 AS target_match")
    return oc.experiment_summary(tasks)


EXPERIMENT_PCTS = ", ".join(f"round(CAST(count(CASE WHEN {flag} THEN 1 END) AS DOUBLE) / count(*) * 100, 6) AS {name}_pct" for name, flag in {
    "success_without": "hits_without >= 2", "success_with": "hits_with >= 2", "validated_success": "hits_with >= 2 AND validated", "executed": "executed",
    "validated": "validated", "tests_passed": "tests_passed", "target_match": "target_match", "heavy_first": "heavy_first", "escalated": "escalated",
    "escalation_skipped": "escalation_skipped", "trimmed": "trimmed", "empty_ref": "impacted_files = 0", "over_control": "tokens_with > tokens_without",
    "misdirection": "NOT target_match AND hits_with < 2"}.items())


@query("d22_experiment_rates", f"""
WITH s AS (SELECT suite, count(*) AS task_count, {EXPERIMENT_PCTS},
    round(CAST(sum(terms_found) AS DOUBLE) / CAST(sum(terms_expected) AS DOUBLE) * 100, 6) AS context_coverage_pct,
    CAST(floor(CAST(sum(retrieval_ms) AS DOUBLE) / count(*)) AS BIGINT) AS avg_retrieval_ms,
    CAST(sum(tokens_without) - sum(tokens_with) AS DOUBLE) / CAST(sum(tokens_without) AS DOUBLE) * 100 AS savings,
    CAST(sum(4 + least(file_mentions, 3)) - sum(3 + least(impacted_files, 3) + CAST(hits_with = 0 AS BIGINT)) AS DOUBLE)
      / CAST(sum(4 + least(file_mentions, 3)) AS DOUBLE) * 100 AS step_savings FROM m_experiments GROUP BY 1)
SELECT s.* EXCLUDE (savings, step_savings), round(savings, 6) AS savings_pct, round(step_savings, 6) AS step_savings_pct,
  savings < -25 OR step_savings < -10 AS regression_alert FROM s""")
def _(t):
    return oc.experiment_rates(t.experiments)


@query("d23_evolution_risk", f"""
SELECT round((SELECT avg(CAST(NOT {OK} AS DOUBLE)) FROM m_patches) * 0.5 + (SELECT least(count(*) / CAST(100 AS DOUBLE), 1) FROM m_repo_edges) * 0.3
  + (SELECT 1 - avg(CAST(contains(lower(file), 'test') OR contains(lower(file), 'spec') AS DOUBLE)) FROM m_modules) * 0.2, 6) AS risk_score""")
def _(t):
    return oc.evolution_risk(t.patches, t.repo_edges, t.modules, "file")


@query("d24_path_hints", """
SELECT dir, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, dir) AS r FROM (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n FROM m_docs GROUP BY 1)) WHERE r <= 8""")
def _(t):
    return sm.path_hints(t.docs, "path")


@query("d25_source_support", """
SELECT supported, count(*) AS files, string_agg(CASE WHEN r <= 8 THEN path END, ',' ORDER BY path) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY supported ORDER BY path) AS r FROM (
    SELECT path, regexp_matches(path, '\\.(py|js|jsx|ts|tsx)$') AS supported FROM m_docs)) GROUP BY 1""")
def _(t):
    return sm.source_support(t.docs, "path", ("py", "js", "jsx", "ts", "tsx"))


@query("d26_group_collapse", """
WITH m AS (SELECT repo AS module, count(*) AS files, max(n_chars) AS importance FROM m_docs GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, module) AS k FROM m)
SELECT CASE WHEN k > 6 THEN 'other' ELSE module END AS module, CAST(sum(files) AS BIGINT) AS files, max(importance) AS importance, count(*) AS members,
  string_agg(CASE WHEN k <= 6 OR k <= 14 THEN module END, ',' ORDER BY k) AS names FROM r GROUP BY 1""")
def _(t):
    modules = t.docs.groupBy(F.col("repo").alias("module")).agg(F.count("*").alias("files"), F.max("n_chars").alias("importance"))
    return sm.collapse_beyond(modules, 6, 8)


@query("d28_recurring_issues", """
SELECT error_code, hits FROM (SELECT error_code, count(*) AS hits FROM m_telemetry WHERE error_code IS NOT NULL GROUP BY 1
  ORDER BY hits DESC, error_code LIMIT 20) WHERE hits >= 3""")
def _(t):
    return sm.recurring(t.telemetry.filter("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("hits")), "error_code", 3)
