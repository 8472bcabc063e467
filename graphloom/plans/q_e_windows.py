"""Window, interval and flow queries."""

from pyspark.sql import functions as F

from .registry import query
from ..functions import classify as cl
from ..operators import events as ev, flow, intervals as iv, quality as ql, scale

ORD = "start_line, end_line, pos"
NODES = f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY {ORD}) AS idx FROM m_nodes)"""
CONTROL = f"""{NODES},
nx AS (SELECT a.symbol_id, a.pos AS from_pos, b.pos AS to_pos FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND b.idx = a.idx + 1),
br AS (SELECT a.symbol_id, a.pos AS from_pos, b.pos AS to_pos FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND b.idx = a.idx + 1
         WHERE a.node_type IN ('Conditional', 'Switch', 'Case')
       UNION SELECT symbol_id, from_pos, arg_min(to_pos, idx) FROM (
         SELECT a.symbol_id, a.pos AS from_pos, b.pos AS to_pos, b.idx FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND b.idx >= a.idx + 2 AND b.start_line > a.start_line
         WHERE a.node_type IN ('Conditional', 'Switch', 'Case')) GROUP BY 1, 2),
lb AS (SELECT a.symbol_id, arg_max(b.pos, b.idx) AS from_pos, a.pos AS to_pos FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND b.idx > a.idx
         AND b.start_line <= a.end_line AND b.end_line <= a.end_line WHERE a.node_type = 'Loop' GROUP BY a.symbol_id, a.pos),
ex AS (SELECT a.symbol_id, a.pos AS from_pos, arg_min(b.pos, b.idx) AS to_pos FROM n a JOIN n b ON a.symbol_id = b.symbol_id AND b.idx > a.idx
         AND b.start_line <= a.end_line AND b.node_type IN ('Catch', 'Finally') WHERE a.node_type = 'Try' GROUP BY a.symbol_id, a.pos)"""


@query("e01_next_edges", f"WITH {CONTROL} SELECT *, 'Next' AS kind FROM nx")
def _(t):
    return flow.next_edges(t.nodes)


@query("e02_branch_edges", f"WITH {CONTROL} SELECT *, 'Branch' AS kind FROM br")
def _(t):
    return flow.branch_edges(t.nodes)


@query("e03_loop_back_edges", f"WITH {CONTROL} SELECT *, 'LoopBack' AS kind FROM lb")
def _(t):
    return flow.loop_back_edges(t.nodes)


@query("e04_exception_edges", f"WITH {CONTROL} SELECT *, 'Exception' AS kind FROM ex")
def _(t):
    return flow.exception_edges(t.nodes)


LABEL = """CASE node_type WHEN 'Conditional' THEN CASE WHEN regexp_matches(lower(text), 'return|throw') THEN 'guard_clause' ELSE 'branch_decision' END
  WHEN 'Assignment' THEN CASE WHEN regexp_matches(lower(text), 'state|cache') THEN 'state_update' ELSE 'value_assignment' END
  WHEN 'Loop' THEN 'iteration' WHEN 'Try' THEN 'risky_operation' WHEN 'Catch' THEN 'error_recovery' WHEN 'Finally' THEN 'error_recovery'
  WHEN 'Return' THEN 'result_exit' WHEN 'Call' THEN 'side_effect_call' ELSE 'logic' END"""
BLOCK = """CASE WHEN node_label IN ('guard_clause', 'branch_decision') THEN 'decision_block' WHEN node_label = 'iteration' THEN 'iteration_block'
  WHEN node_label IN ('error_recovery', 'risky_operation') THEN 'error_path' WHEN node_label = 'side_effect_call' THEN 'side_effects'
  WHEN node_label IN ('state_update', 'value_assignment') THEN 'state_changes' WHEN node_label = 'result_exit' THEN 'result_path' ELSE 'logic_block' END"""
LABELED = f"lab AS (SELECT *, {LABEL} AS node_label FROM m_nodes), blk AS (SELECT *, {BLOCK} AS block FROM lab)"
CLUSTERS = f"""{LABELED},
c1 AS (SELECT *, lag(block) OVER w AS pb, lag(end_line) OVER w AS pe FROM blk WINDOW w AS (PARTITION BY symbol_id ORDER BY {ORD})),
c2 AS (SELECT *, sum(CASE WHEN pb = block AND start_line <= pe + 4 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol_id ORDER BY {ORD}) AS run FROM c1),
clusters AS (SELECT symbol_id, min(block) AS label, min(start_line) AS start_line, arg_max(end_line, pos) AS end_line, count(*) AS node_count FROM c2 GROUP BY symbol_id, run)"""


@query("e05_logic_clusters", f"WITH {CLUSTERS} SELECT * FROM clusters")
def _(t):
    return flow.logic_clusters(cl.with_effective_label(t.nodes))


IDS = """list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda w: lower(w)),
  lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('return', 'await', 'throw', 'true', 'false', 'null', 'none',
  'self', 'this', 'let', 'const', 'var', 'if', 'else', 'for', 'while', 'switch', 'case', 'try', 'catch', 'finally', 'new')))"""
DATA = f"""s AS (SELECT symbol_id, {ORD}, node_type, {IDS.format('text')} AS every,
  {IDS.format("CASE WHEN instr(text, '=') > 0 THEN substr(text, 1, instr(text, '=') - 1) ELSE text END")} AS lhs,
  {IDS.format("CASE WHEN instr(text, '=') > 0 THEN substr(text, instr(text, '=') + 1) ELSE '' END")} AS rhs FROM m_nodes),
d AS (SELECT symbol_id, {ORD}, unnest(CASE WHEN len(lhs) > 0 THEN lhs ELSE every END) AS variable FROM s WHERE node_type = 'Assignment'),
u AS (SELECT symbol_id, {ORD}, node_type, unnest(CASE WHEN node_type = 'Assignment' THEN rhs ELSE every END) AS variable FROM s),
p AS (SELECT u.symbol_id, u.pos AS to_pos, u.node_type, u.variable, d.pos AS from_pos,
  row_number() OVER (PARTITION BY u.symbol_id, u.pos, u.variable ORDER BY d.start_line DESC, d.end_line DESC, d.pos DESC) AS r
  FROM u JOIN d ON u.symbol_id = d.symbol_id AND u.variable = d.variable AND (d.start_line, d.end_line, d.pos) <= (u.start_line, u.end_line, u.pos)),
df AS (SELECT symbol_id, from_pos, to_pos, CASE node_type WHEN 'Return' THEN 'AssignmentToReturn' WHEN 'Call' THEN 'CallResult' ELSE 'AssignmentToUse' END AS kind, variable FROM p WHERE r = 1)"""


@query("c17_last_assignment", f"WITH {DATA} SELECT * FROM df")
def _(t):
    return flow.data_flow(t.nodes)


@query("d19_flow_metrics", f"""WITH {CONTROL}, {DATA},
e AS (SELECT symbol_id, 'Next' AS kind FROM nx UNION ALL SELECT symbol_id, 'Branch' FROM br UNION ALL SELECT symbol_id, 'LoopBack' FROM lb
      UNION ALL SELECT symbol_id, 'Exception' FROM ex UNION ALL SELECT symbol_id, kind FROM df)
SELECT symbol_id, count(CASE WHEN kind = 'Branch' THEN 1 END) AS branch_points, count(CASE WHEN kind = 'LoopBack' THEN 1 END) AS loop_points,
  count(CASE WHEN kind = 'AssignmentToUse' THEN 1 END) AS assignments, count(CASE WHEN kind = 'CallResult' THEN 1 END) AS calls,
  count(CASE WHEN kind = 'AssignmentToReturn' THEN 1 END) AS returns FROM e GROUP BY 1""")
def _(t):
    return flow.flow_metrics(t.nodes)


@query("d19_top_variables", f"""WITH {DATA} SELECT symbol_id, variable, links, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY links DESC, variable) AS r FROM (
    SELECT symbol_id, variable, count(*) AS links FROM df GROUP BY 1, 2)) WHERE r <= 10""")
def _(t):
    return flow.top_variables(t.nodes)


@query("e06_merge_ranges", """
WITH r AS (SELECT file, start_line, end_line, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m_symbols),
i AS (SELECT *, sum(CASE WHEN start_line <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT file, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY file, island""")
def _(t):
    return iv.merge_ranges(t.symbols, ["file"])


PRUNED = """sp AS (SELECT request_id, file, start_line, end_line, min(priority) AS priority FROM m_items GROUP BY 1, 2, 3, 4),
kept AS (SELECT * FROM sp a WHERE NOT EXISTS (SELECT 1 FROM sp b WHERE a.request_id = b.request_id AND a.file = b.file
  AND b.priority <= a.priority AND b.start_line <= a.start_line AND b.end_line >= a.end_line
  AND (b.start_line < a.start_line OR b.end_line > a.end_line)))"""


@query("c12_containment_prune", f"WITH {PRUNED} SELECT * FROM kept")
def _(t):
    return iv.prune_contained(t.items, ["request_id", "file"])


@query("c12_not_covered", """SELECT DISTINCT request_id, file, start_line, end_line FROM m_items a WHERE priority = 3 AND NOT EXISTS (
  SELECT 1 FROM m_items b WHERE b.priority < 3 AND a.request_id = b.request_id AND a.file = b.file AND b.start_line <= a.start_line AND b.end_line >= a.end_line)""")
def _(t):
    cols = ["request_id", "file", "start_line", "end_line"]
    return iv.not_covered(t.items.filter("priority = 3").select(*cols).distinct(), t.items.filter("priority < 3"), cols[:2])


@query("c13_overlap", """SELECT DISTINCT request_id, file, start_line, end_line FROM m_items a WHERE priority = 0 AND EXISTS (
  SELECT 1 FROM m_items b WHERE b.priority > 0 AND a.request_id = b.request_id AND a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line)""")
def _(t):
    cols = ["request_id", "file", "start_line", "end_line"]
    return iv.overlapping(t.items.filter("priority = 0").select(*cols).distinct(), t.items.filter("priority > 0"), cols[:2])


COST = "CAST(ceil(least(greatest((end_line - start_line + 1) * 40, 120), 4000) / CAST(3 AS DOUBLE)) AS BIGINT)"


@query("e07_running_budget", f"""WITH c AS (SELECT request_id, file, start_line, end_line, priority, {COST} AS cost,
  sum({COST}) OVER (PARTITION BY request_id ORDER BY priority, file, start_line, end_line ROWS UNBOUNDED PRECEDING) AS used FROM (
    SELECT request_id, file, start_line, end_line, min(priority) AS priority FROM m_items GROUP BY 1, 2, 3, 4))
SELECT request_id, file, start_line, end_line, priority, cost, CAST(used AS BIGINT) AS used FROM c WHERE used <= 700""")
def _(t):
    items = iv.best_per_span(t.items, ["request_id", "file"]).withColumn("cost", iv.item_cost())
    return iv.within_budget(items, ["request_id"], [F.col(c) for c in ("priority", "file", "start_line", "end_line")], "cost", 700, 40)


@query("e08_rank_gaps", """
WITH m AS (SELECT repo, lang, CAST(sum(n_chars) AS BIGINT) AS score FROM m_docs GROUP BY 1, 2),
r AS (SELECT repo, lang, score, CAST(row_number() OVER w AS INT) AS rank, lag(score) OVER w - score AS gap_from_previous,
  score - lead(score) OVER w AS gap_to_next FROM m WINDOW w AS (PARTITION BY repo ORDER BY score DESC, lang))
SELECT *, CASE WHEN gap_from_previous IS NULL AND gap_to_next IS NULL THEN 'solo' WHEN gap_to_next >= 5 THEN 'clear_lead'
  WHEN gap_to_next IS NULL AND gap_from_previous >= 5 THEN 'clear_trailing_gap' WHEN gap_to_next IS NULL THEN 'close_trailing_gap' ELSE 'close_cluster' END AS separation FROM r""")
def _(t):
    scores = t.docs.groupBy("repo", "lang").agg(F.sum("n_chars").alias("score"))
    from ..operators.ranking import rank_with_gaps
    return rank_with_gaps(scores, ["repo"], "score", ["lang"])


RUNS = "runs AS (SELECT *, CASE WHEN failures * 100 < case_count * 36 THEN 'clean' ELSE 'regressed' END AS status FROM m_runs)"


def runs(t):
    return t.runs.withColumn("status", F.when(F.col("failures") * 100 < F.col("case_count") * 36, "clean").otherwise("regressed"))


@query("e09_trailing_average", """SELECT suite, run_id, round(avg(avg_latency_ms) OVER w, 6) AS trailing_avg, round(avg(p95_latency_ms) OVER w, 6) AS trailing_p95
FROM m_runs WINDOW w AS (PARTITION BY suite ORDER BY run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(t):
    h = ql.trailing_average(t.runs, ["avg_latency_ms", "p95_latency_ms"])
    return h.select("suite", "run_id", F.round("trailing_avg_latency_ms", 6).alias("trailing_avg"),
                    F.round("trailing_p95_latency_ms", 6).alias("trailing_p95"))


@query("e10_trend_direction", """
WITH w AS (SELECT suite, run_id, p95_latency_ms - first_value(p95_latency_ms) OVER (PARTITION BY suite ORDER BY run_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS delta,
  row_number() OVER (PARTITION BY suite ORDER BY run_id) AS n FROM m_runs)
SELECT suite, run_id, CASE WHEN n < 2 THEN 'insufficient history' WHEN delta > 1 THEN 'worsening' WHEN delta < -1 THEN 'improving' ELSE 'flat' END AS direction FROM w""")
def _(t):
    return ql.trend_direction(t.runs, "p95_latency_ms").select("suite", "run_id", "direction")


@query("e11_history_cap", """SELECT suite, run_id, case_count FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY run_id DESC) AS r FROM m_runs) WHERE r <= 25""")
def _(t):
    return ql.capped_history(t.runs).select("suite", "run_id", "case_count")


PEAK = "greatest({0}missing_files_rate, {0}extra_files_rate, {0}missing_symbols_rate, {0}extra_symbols_rate)"
HEALTH = f"""{RUNS},
h1 AS (SELECT *, avg(avg_latency_ms) OVER w AS t_avg, avg(p95_latency_ms) OVER w AS t_p95, avg(missing_files_rate) OVER w AS t_missing_files_rate,
  avg(extra_files_rate) OVER w AS t_extra_files_rate, avg(missing_symbols_rate) OVER w AS t_missing_symbols_rate, avg(extra_symbols_rate) OVER w AS t_extra_symbols_rate,
  row_number() OVER (PARTITION BY suite ORDER BY run_id) AS nth FROM runs WINDOW w AS (PARTITION BY suite ORDER BY run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
h2 AS (SELECT *, p95_latency_ms - t_p95 AS d95, avg_latency_ms - t_avg AS davg FROM h1),
h3 AS (SELECT *, CASE WHEN status <> 'clean' THEN 'drifting' WHEN t_avg IS NULL THEN 'stable' WHEN p95_latency_ms <= 8 AND avg_latency_ms <= 5 THEN 'stable'
  WHEN d95 > 5 OR davg > 3 THEN 'drifting' WHEN d95 > 1 OR davg > 0.75 THEN 'watch' ELSE 'stable' END AS marker FROM h2),
h4 AS (SELECT *, lag(marker) OVER (PARTITION BY suite ORDER BY run_id) AS previous_marker, {PEAK.format('')} AS peak,
  CASE WHEN t_avg IS NULL THEN {PEAK.format('')} ELSE {PEAK.format('t_')} END AS tpeak FROM h3),
h5 AS (SELECT *, CASE WHEN marker = 'drifting' AND status = 'clean' AND NOT (nth >= 3 AND COALESCE(previous_marker, '') IN ('watch', 'drifting')) THEN 'watch' ELSE marker END AS latency_health,
  round(CASE WHEN t_avg IS NULL THEN 0 ELSE greatest(d95, 0) + 0.5 * greatest(davg, 0) END, 6) AS latency_score,
  peak * 100 + greatest(peak - tpeak, 0) * 100 AS score FROM h4),
h6 AS (SELECT *, CASE WHEN round(score, 6) > 15 OR score - tpeak * 100 > 10 THEN 'drifting' WHEN round(score, 6) > 0 OR score - tpeak * 100 > 0 THEN 'watch' ELSE 'stable' END AS drift_health FROM h5),
h7 AS (SELECT *, CASE WHEN latency_health <> 'stable' AND drift_health <> 'stable' THEN 'mixed_drift' WHEN latency_health <> 'stable' THEN 'latency_only_drift'
  WHEN drift_health <> 'stable' THEN 'graph_only_drift' ELSE 'clean' END AS diagnosis FROM h6)"""


@query("e12_persistent_drift", f"WITH {HEALTH} SELECT suite, run_id FROM h7 WHERE marker = 'drifting' AND nth >= 3 AND previous_marker IN ('watch', 'drifting')")
def _(t):
    return ql.persistent_drift(ql.run_health(runs(t))).select("suite", "run_id")


@query("j11_run_health", f"""WITH {HEALTH} SELECT suite, run_id, marker, latency_health, latency_score, round(score, 6) AS drift_score, drift_health,
  CASE WHEN status <> 'clean' OR marker = 'drifting' OR drift_health = 'drifting' THEN 'drifting' WHEN marker = 'watch' OR drift_health = 'watch' THEN 'watch' ELSE 'stable' END AS overall,
  diagnosis, CASE diagnosis WHEN 'clean' THEN 'no_action' WHEN 'mixed_drift' THEN 'investigate_mixed_regression'
    WHEN 'latency_only_drift' THEN CASE WHEN latency_health = 'drifting' THEN 'investigate_latency_regression' ELSE 'watch_latency' END
    ELSE CASE WHEN drift_health = 'drifting' THEN 'inspect_graph_drift' ELSE 'watch_graph_drift' END END AS recommendation,
  CASE diagnosis WHEN 'clean' THEN 'none' WHEN 'mixed_drift' THEN 'high' WHEN 'graph_only_drift' THEN CASE WHEN drift_health = 'drifting' THEN 'high' ELSE 'medium' END
    ELSE CASE WHEN latency_health = 'drifting' THEN 'medium' ELSE 'low' END END AS action_priority FROM h7""")
def _(t):
    return ql.run_health(runs(t)).select("suite", "run_id", "marker", "latency_health", "latency_score", "drift_score", "drift_health",
                                         "overall", "diagnosis", "recommendation", "action_priority")


@query("j12_leading_drift", """
WITH h AS (SELECT *, avg(missing_files_rate) OVER w AS t1, avg(extra_files_rate) OVER w AS t2, avg(missing_symbols_rate) OVER w AS t3, avg(extra_symbols_rate) OVER w AS t4
  FROM m_runs WINDOW w AS (PARTITION BY suite ORDER BY run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
u AS (SELECT suite, run_id, 1 AS o, 'missing_files' AS mode, missing_files_rate AS rate, t1 AS trail FROM h UNION ALL SELECT suite, run_id, 2, 'extra_files', extra_files_rate, t2 FROM h
  UNION ALL SELECT suite, run_id, 3, 'missing_symbols', missing_symbols_rate, t3 FROM h UNION ALL SELECT suite, run_id, 4, 'extra_symbols', extra_symbols_rate, t4 FROM h),
l AS (SELECT *, row_number() OVER (PARTITION BY suite, run_id ORDER BY rate DESC, o) AS r FROM u)
SELECT suite, run_id, mode, CASE WHEN COALESCE(trail, 0) <= 0.000001 THEN 'new' WHEN rate - trail > 0.01 THEN 'worsening' WHEN rate - trail < -0.01 THEN 'improving' ELSE 'flat' END AS trend,
  round((rate - COALESCE(trail, 0)) * 100, 6) AS delta_points FROM l WHERE r = 1 AND rate > 0.000001
UNION ALL SELECT suite, run_id, mode, 'cleared', CAST(0 AS DOUBLE) FROM (SELECT u.*, row_number() OVER (PARTITION BY suite, run_id ORDER BY COALESCE(trail, 0) DESC, o) AS r,
  max(rate) OVER (PARTITION BY suite, run_id) AS top FROM u) WHERE r = 1 AND top <= 0.000001 AND trail > 0.000001""")
def _(t):
    return ql.leading_drift(t.runs)


@query("j12_leading_fixture", """
WITH nr AS (SELECT suite, run_id, row_number() OVER (PARTITION BY suite ORDER BY run_id) AS nth FROM (SELECT DISTINCT suite, run_id FROM m_fixture_runs)),
f AS (SELECT f.*, nth FROM m_fixture_runs f JOIN nr USING (suite, run_id) WHERE mutation_case_count > 0),
u AS (SELECT suite, nth, fixture, 1 AS o, 'incomplete' AS mode, incomplete_rate AS rate FROM f UNION ALL SELECT suite, nth, fixture, 2, 'missing_files', missing_files_rate FROM f
  UNION ALL SELECT suite, nth, fixture, 3, 'extra_files', extra_files_rate FROM f UNION ALL SELECT suite, nth, fixture, 4, 'missing_symbols', missing_symbols_rate FROM f
  UNION ALL SELECT suite, nth, fixture, 5, 'extra_symbols', extra_symbols_rate FROM f),
e AS (SELECT suite, nth, fixture, CASE WHEN rate > 0.000001 THEN mode END AS mode, CASE WHEN rate > 0.000001 THEN rate ELSE 0 END AS rate
  FROM (SELECT *, row_number() OVER (PARTITION BY suite, nth, fixture ORDER BY rate DESC, o DESC) AS r FROM u) WHERE r = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite, nth ORDER BY rate DESC, fixture) AS r FROM e WHERE mode IS NOT NULL) WHERE r = 1),
w AS (SELECT l.*, COALESCE((SELECT avg(e.rate) FROM e WHERE e.suite = l.suite AND e.fixture = l.fixture AND e.nth BETWEEN l.nth - 3 AND l.nth - 1), CAST(0 AS DOUBLE)) AS trail FROM l),
c AS (SELECT nr.suite, nr.run_id, e.fixture, e.mode, e.rate, row_number() OVER (PARTITION BY nr.suite, nr.nth ORDER BY e.rate DESC, e.nth, e.fixture DESC) AS r
  FROM nr JOIN e ON e.suite = nr.suite AND e.nth BETWEEN nr.nth - 3 AND nr.nth - 1 AND e.rate > 0.005 WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.suite = nr.suite AND l.nth = nr.nth))
SELECT suite, run_id, fixture, mode, round(rate, 6) AS rate, CASE WHEN trail <= 0.000001 THEN 'new' WHEN (rate - trail) * 100 > 1 THEN 'worsening'
  WHEN (rate - trail) * 100 < -1 THEN 'improving' ELSE 'flat' END AS trend, round((rate - trail) * 100, 6) AS delta_points FROM w JOIN nr USING (suite, nth)
UNION ALL SELECT suite, run_id, fixture, mode, CAST(0 AS DOUBLE), 'cleared', round(-rate * 100, 6) FROM c WHERE r = 1""")
def _(t):
    return ql.leading_fixture(t.fixture_runs)


@query("e13_symbols_per_file", """
WITH c AS (SELECT callee_symbol AS name, count(*) AS calls FROM m_calls GROUP BY 1)
SELECT file, name, symbol_id, calls FROM (SELECT file, name, symbol_id, COALESCE(calls, 0) AS calls,
  row_number() OVER (PARTITION BY file ORDER BY COALESCE(calls, 0) DESC, name, symbol_id) AS r FROM m_symbols LEFT JOIN c USING (name)) WHERE r <= 6""")
def _(t):
    from ..operators.ranking import symbols_per_file
    return symbols_per_file(t.symbols, t.calls, 6)


@query("e14_first_definition", """SELECT name, file, start_line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, start_line, symbol_id) AS r FROM m_symbols) WHERE r = 1""")
def _(t):
    return scale.first_per_key(t.symbols, ["name"], [F.col("file"), F.col("start_line"), F.col("symbol_id")]).select("name", "file", "start_line")


@query("e16_repeated_errors", """SELECT task_id, error_code, event_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id, error_code ORDER BY ts_ms, event_id) AS r
  FROM m_telemetry WHERE status = 'error' AND error_code IS NOT NULL) WHERE r > 1""")
def _(t):
    return ev.repeated_error_events(t.telemetry)
