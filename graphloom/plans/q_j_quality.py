"""Quality gate queries."""

from pyspark.sql import functions as F

from .registry import query
from .q_d_aggregates import pct
from ..operators import quality as ql

METRICS = f"""c AS (SELECT 'overall' AS scope, * FROM m_cases UNION ALL SELECT bucket AS scope, * FROM m_cases),
w AS (SELECT run, fixture, scope, round(avg(CAST(target_match AS DOUBLE)), 6) AS target_match_rate, round(avg(CAST(top_file_match AS DOUBLE)), 6) AS top_file_match_rate,
  round(avg(CAST(top_span_match AS DOUBLE)), 6) AS top_span_match_rate, round(avg(omission_count), 6) AS omission_rate, round(avg(overfetch_count), 6) AS overfetch_rate,
  round(avg(latency_ms), 6) AS avg_latency_ms, {pct('list(latency_ms)', 'count(*)', 0.95)} AS p95_latency_ms, round(avg(approx_tokens), 4) AS avg_tokens,
  CAST(max(approx_tokens) AS DOUBLE) AS max_tokens FROM c GROUP BY 1, 2, 3),
m AS (UNPIVOT w ON target_match_rate, top_file_match_rate, top_span_match_rate, omission_rate, overfetch_rate, avg_latency_ms, p95_latency_ms, avg_tokens, max_tokens INTO NAME metric VALUE value),
cmp AS (SELECT b.fixture, b.scope, b.metric, b.value AS base, n.value AS now FROM (SELECT * FROM m WHERE run = 'baseline') b
  LEFT JOIN (SELECT * FROM m WHERE run = 'current') n USING (fixture, scope, metric))"""


@query("c16_baseline_comparison", f"WITH {METRICS} SELECT * FROM cmp")
def _(t):
    return ql.compare_runs(ql.metric_rows(t.cases))


@query("j09_regressions", f"""WITH {METRICS}, f AS (SELECT *, CASE WHEN now IS NULL THEN 'missing'
  WHEN metric IN ('target_match_rate', 'top_file_match_rate', 'top_span_match_rate') THEN CASE WHEN now + 0.000001 < base THEN 'decreased' END
  WHEN metric IN ('omission_rate', 'overfetch_rate') THEN CASE WHEN now > base + 0.000001 THEN 'increased' END
  WHEN base > 0.000001 AND now > CASE WHEN contains(metric, 'latency') THEN greatest(base * 1.25, base + CASE WHEN base <= 5 THEN 30 ELSE 16 END) ELSE base * 1.2 END THEN 'beyond_tolerance' END AS failure FROM cmp)
SELECT * FROM f WHERE failure IS NOT NULL""")
def _(t):
    return ql.regressions(ql.compare_runs(ql.metric_rows(t.cases)))


@query("j13_improvements", f"""WITH {METRICS} SELECT * FROM cmp WHERE CASE WHEN metric IN ('target_match_rate', 'top_file_match_rate', 'top_span_match_rate')
  THEN now > base + 0.000001 ELSE now + 0.000001 < base END""")
def _(t):
    return ql.improvements(ql.compare_runs(ql.metric_rows(t.cases)))


@query("d27_p95_movers", """
WITH c AS (SELECT suite, run_id, p95_latency_ms AS value, round(avg(p95_latency_ms) OVER (PARTITION BY suite ORDER BY run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS base FROM m_runs),
d AS (SELECT suite AS fixture, round(round(value * 10, 6) - round(base * 10, 6), 6) AS delta FROM c WHERE base IS NOT NULL),
k AS (SELECT fixture, CASE WHEN delta > 1 THEN 'regression' WHEN delta < -5 THEN 'improvement' END AS direction, delta FROM d)
SELECT fixture, direction, count(*) AS moves, max(abs(delta)) AS max_ms FROM k WHERE direction IS NOT NULL GROUP BY 1, 2
HAVING max(abs(delta)) >= CASE WHEN direction = 'regression' THEN 2 ELSE 6 END""")
def _(t):
    h = ql.trailing_average(t.runs, ["p95_latency_ms"]).filter("trailing_p95_latency_ms IS NOT NULL")
    compared = h.select(F.col("suite").alias("fixture"), F.lit("p95_latency_ms").alias("metric"),
                        F.round(F.round("trailing_p95_latency_ms", 6) * 10, 6).alias("base"), F.round(F.col("p95_latency_ms") * 10, 6).alias("now"))
    return ql.p95_movers(compared)


@query("j13_hotspot_changes", """
WITH mc AS (SELECT * REPLACE (latency_ms * CASE WHEN run = 'current' AND intent = 'debug' THEN 2 ELSE 1 END AS latency_ms, approx_tokens * CASE WHEN run = 'current' AND intent = 'refactor' THEN 2 ELSE 1 END AS approx_tokens) FROM m_cases),
u AS (SELECT DISTINCT run, intent, metric, value, fixture, case_name FROM (
  SELECT run, intent, 'latency' AS metric, CAST(latency_ms AS DOUBLE) AS value, fixture, case_name FROM mc
  UNION ALL SELECT run, intent, 'tokens', CAST(approx_tokens AS DOUBLE), fixture, case_name FROM mc)),
w AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run, intent, metric ORDER BY value DESC, fixture, case_name) AS INT) AS rank FROM u) WHERE rank <= 5),
b AS (SELECT * FROM w WHERE run = 'baseline'), n AS (SELECT * FROM w WHERE run = 'current'),
p AS (SELECT intent, metric, fixture, case_name, max(value) AS previous FROM b GROUP BY ALL),
l AS (SELECT intent, metric, arg_max(value, rank) AS last_cutoff FROM b GROUP BY 1, 2),
j AS (SELECT n.*, p.previous, COALESCE(b.value, l.last_cutoff) AS cutoff FROM n LEFT JOIN p USING (intent, metric, fixture, case_name)
  LEFT JOIN b USING (intent, metric, rank) LEFT JOIN l USING (intent, metric)),
k AS (SELECT *, CASE WHEN previous IS NOT NULL THEN CASE WHEN CASE WHEN metric = 'latency' THEN value - previous > 16 ELSE value - previous > greatest(ceil(previous * 0.2), 25) END THEN 'grew' END
  WHEN cutoff IS NULL OR value > CASE WHEN metric = 'latency' THEN greatest(cutoff * 1.25, cutoff + 16) ELSE greatest(ceil(cutoff * 1.2), cutoff + 25) END THEN 'entered' END AS change FROM j)
SELECT intent, metric, rank, fixture, case_name, value, previous, change FROM k WHERE change IS NOT NULL""")
def _(t):
    slower = lambda intent: F.when((F.col("run") == "current") & (F.col("intent") == intent), 2).otherwise(1)
    cases = t.cases.withColumns({"latency_ms": F.col("latency_ms") * slower("debug"), "approx_tokens": F.col("approx_tokens") * slower("refactor")})
    return ql.hotspot_changes(ql.worst_cases(cases, ["run", "intent"]), ["intent"])


@query("j10_threshold_checks", f"""WITH {METRICS}, th AS (SELECT metric, CASE WHEN metric LIKE '%match%' THEN avg(value) END AS min_value, CASE WHEN metric NOT LIKE '%match%' THEN avg(value) END AS max_value
  FROM m WHERE run = 'baseline' AND scope = 'overall' GROUP BY 1),
v AS (SELECT run, fixture, scope, metric, value, CASE WHEN min_value IS NOT NULL AND value + 0.000001 < round(min_value, 4) THEN 'below_minimum'
  WHEN max_value IS NOT NULL AND value > round(max_value, 4) + 0.000001 THEN 'above_maximum' END AS violation FROM m JOIN th USING (metric))
SELECT * FROM v WHERE violation IS NOT NULL""")
def _(t):
    m = ql.metric_rows(t.cases)
    base = m.filter("run = 'baseline' AND scope = 'overall'").groupBy("metric").agg(F.round(F.avg("value"), 4).alias("v"))
    is_min = F.col("metric").contains("match")
    th = base.select("metric", F.when(is_min, F.col("v")).alias("min_value"), F.when(~is_min, F.col("v")).alias("max_value"))
    return ql.threshold_violations(m, th, ["metric"]).drop("min_value", "max_value")


@query("j10_case_thresholds", """SELECT case_name, fixture, 'latency' AS metric, latency_ms AS value FROM m_cases JOIN (SELECT fixture, round(avg(latency_ms), 4) AS t FROM m_cases GROUP BY 1) USING (fixture)
WHERE latency_ms > t + 0.000001""")
def _(t):
    th = t.cases.groupBy("fixture").agg(F.lit(None).cast("double").alias("min_value"), F.round(F.avg("latency_ms"), 4).alias("max_value"))
    v = t.cases.select("case_name", "fixture", F.lit("latency").alias("metric"), F.col("latency_ms").alias("value"))
    return ql.threshold_violations(v, th, ["fixture"]).select("case_name", "fixture", "metric", "value")


@query("j14_case_report", """
WITH c AS (SELECT l_orderkey AS case_name, max(l_partkey) AS symbol, max(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS expected_symbol,
  CAST(arg_min(l_suppkey % 10, (l_linenumber, l_suppkey)) AS BIGINT) AS top_file, CAST(min(CASE WHEN l_linestatus = 'F' THEN l_suppkey % 10 END) AS BIGINT) AS expected_file,
  list_distinct(list(l_suppkey % 10)) AS files, list_distinct(list(CASE WHEN l_linenumber = 1 THEN l_partkey % 10 END)) AS inc,
  list_distinct(list(CASE WHEN l_linenumber = 2 THEN l_partkey % 10 END)) AS exc, min(l_linenumber) AS s, max(l_linenumber) AS e FROM lineitem GROUP BY 1)
SELECT case_name, COALESCE(symbol = expected_symbol, true) AS target_match, COALESCE(top_file = expected_file, true) AS top_file_match,
  COALESCE(top_file = expected_file, true) AND s = 1 AND e = 7 AS top_span_match,
  CAST(len(list_filter(inc, lambda x: x IS NOT NULL AND NOT list_contains(files, x))) AS INT) AS omission_count,
  CAST(len(list_filter(exc, lambda x: x IS NOT NULL AND list_contains(files, x))) AS INT) AS overfetch_count FROM c""")
def _(t):
    f = F.col("l_suppkey") % 10
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("case_name")).agg(
        F.max("l_partkey").alias("symbol"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("expected_symbol"),
        F.min_by(f, F.struct("l_linenumber", "l_suppkey")).alias("top_file"), F.min(F.when(F.col("l_linestatus") == "F", f)).alias("expected_file"),
        F.collect_set(f).alias("files"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey") % 10)).alias("must_include"),
        F.collect_set(F.when(F.col("l_linenumber") == 2, F.col("l_partkey") % 10)).alias("must_not_include"),
        F.min("l_linenumber").alias("top_start"), F.max("l_linenumber").alias("top_end"))
    results = results.withColumns({"expected_start": F.lit(1), "expected_end": F.lit(7)})
    return ql.case_report(results)
