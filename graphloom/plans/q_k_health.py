"""Health, planning and context queries."""

from pyspark.sql import functions as F

from .registry import query
from .q_c_joins import HOT, NEXT, RES  # noqa: F401
from .q_e_windows import CLUSTERS, CONTROL, DATA
from ..operators import callgraph as cg, context as cx, flow, health as hl, outcomes as oc, scale, summaries as sm
from ..functions import classify as cl
from ..session import cut_lineage

DEPTH = """ch AS (SELECT path, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT path, regexp_replace(replace(content, ', ', '{'), '[^{:}\\n]', '', 'g') AS t FROM m_docs) WHERE t <> ''),
cp AS (SELECT path, i, sum(CASE WHEN c IN ('{', ':') THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i) AS s FROM ch),
dp AS (SELECT path, CAST(max(s - least(0, m)) AS INT) AS depth FROM (SELECT path, s, min(s) OVER (PARTITION BY path ORDER BY i) AS m FROM cp) GROUP BY 1)"""
# Calls as written, before imports resolve them: some names are never called.
RAW = "cl AS (SELECT file, caller_symbol, raw_name AS callee_symbol FROM m_rawcalls)"
CODE = f"""{DEPTH}, {RAW}, un AS (SELECT * FROM m_symbols WHERE name NOT IN (SELECT callee_symbol FROM cl)),
fn AS (SELECT *, greatest(end_line - start_line, 0) + 1 AS len FROM m_symbols WHERE type = 'function'),
ld AS (SELECT name, arg_max(file, symbol_id) AS f FROM m_symbols GROUP BY 1),
fg AS (SELECT DISTINCT a.f AS x, b.f AS y FROM cl JOIN ld a ON a.name = caller_symbol JOIN ld b ON b.name = callee_symbol),
mc AS (SELECT module, count(*) AS n, count(CASE WHEN starts_with(name, 'get') OR starts_with(name, 'set') OR starts_with(name, 'handle') OR starts_with(name, 'small') THEN 1 END) AS e FROM m_symbols JOIN m_modules USING (file) GROUP BY 1),
code AS (SELECT file AS file_path, name AS symbol, 'LargeFunction' AS issue_type, 'High' AS severity, CAST(len AS STRING) AS detail FROM fn WHERE len > 120
  UNION ALL SELECT file, name, 'DeadCode', 'Medium', '' FROM un WHERE type = 'function' AND NOT starts_with(name, 'test')
  UNION ALL SELECT file, name, 'UnusedImport', 'Low', '' FROM un WHERE type = 'import'
  UNION ALL SELECT 'src/' || module, NULL, 'LargeModule', 'High', CAST(n AS STRING) FROM mc WHERE n > 80
  UNION ALL SELECT file, name, 'DuplicateLogic', 'Medium', CAST(len AS STRING) FROM (SELECT *, count(*) OVER (PARTITION BY len) AS n FROM fn) WHERE len > 20 AND n > 2
  UNION ALL SELECT p.x, NULL, 'CircularDependency', 'High', p.y FROM fg p JOIN fg r ON r.x = p.y AND r.y = p.x WHERE p.x < p.y
  UNION ALL SELECT path, NULL, 'DeepNesting', 'Medium', CAST(depth AS STRING) FROM dp WHERE depth >= 6)"""
ARCHI = """ou AS (SELECT from_module AS m, count(DISTINCT to_module) AS n, max(contains(to_module, 'api')) AS a FROM m_module_edges GROUP BY 1),
mk AS (SELECT module, count(*) AS n FROM m_symbols JOIN m_modules USING (file) GROUP BY 1),
arch AS (SELECT m AS module, 'TightCoupling' AS issue_type, CAST(n AS STRING) AS detail FROM ou WHERE n > 4
  UNION ALL SELECT m, 'LayerViolation', '' FROM ou WHERE contains(m, 'domain') AND a
  UNION ALL SELECT p.from_module, 'CyclicModuleDependency', p.to_module FROM m_module_edges p JOIN m_module_edges r ON r.from_module = p.to_module AND r.to_module = p.from_module WHERE p.from_module < p.to_module
  UNION ALL SELECT module, 'GodModule', CAST(n AS STRING) FROM mk WHERE n > 100)"""


def code_issues(t):
    files = t.docs.select("path", F.replace("content", F.lit(", "), F.lit("{")).alias("content"))
    return hl.code_health(t.symbols, t.rawcalls.withColumnRenamed("raw_name", "callee_symbol"), t.modules, files)


def arch_issues(t):
    return hl.architecture_issues(t.module_edges, t.symbols, t.modules)


@query("j01_code_health", f"WITH {CODE} SELECT * FROM code")
def _(t):
    return code_issues(t)


@query("j02_architecture_issues", f"WITH {ARCHI} SELECT * FROM arch")
def _(t):
    return arch_issues(t)


PLANS = """pt(issue_type, improvement_type, expected_benefit) AS (VALUES """ + ", ".join(
    f"('{k}', '{a}', '{b}')" for k, (a, b) in hl.PLAN_TYPES.items()) + """),
pl AS (SELECT 'imp_code_' || regexp_replace(concat_ws(':', file_path, COALESCE(symbol, 'module'), issue_type), '[^A-Za-z0-9]', '_', 'g') AS plan_id, improvement_type, symbol AS target, expected_benefit FROM code JOIN pt USING (issue_type)
  UNION ALL SELECT 'imp_arch_' || regexp_replace(module, '[^A-Za-z0-9]', '_', 'g'), improvement_type, module, expected_benefit FROM arch JOIN pt USING (issue_type))"""


@query("j03_improvement_plans", f"WITH {CODE}, {ARCHI}, {PLANS} SELECT * FROM pl")
def _(t):
    return hl.improvement_plans(code_issues(t), arch_issues(t))


EVO = "ev AS (SELECT *, row_number() OVER (ORDER BY plan_id, improvement_type, COALESCE(target, ''), expected_benefit) - 1 AS position FROM pl)"


@query("j04_evolution_graph", f"""WITH {CODE}, {ARCHI}, {PLANS}, {EVO} SELECT 'ev_' || CAST(position AS STRING) AS node_id, CASE WHEN position > 0 THEN 'ev_' || CAST(position - 1 AS STRING) END AS depends_on, position, plan_id, improvement_type, target, expected_benefit FROM ev""")
def _(t):
    plans = hl.improvement_plans(code_issues(t), arch_issues(t)).withColumn("_t", F.coalesce("target", F.lit("")))
    return hl.evolution_graph(plans, ["plan_id", "improvement_type", "_t", "expected_benefit"]).drop("_t")


@query("j04_evolution_preview", f"""WITH {CODE}, {ARCHI}, {PLANS}, {EVO} SELECT 'ev_' || CAST(position AS STRING) AS node_id, plan_id FROM ev ORDER BY position LIMIT 20""")
def _(t):
    plans = hl.improvement_plans(code_issues(t), arch_issues(t)).withColumn("_t", F.coalesce("target", F.lit("")))
    return hl.evolution_preview(hl.evolution_graph(plans, ["plan_id", "improvement_type", "_t", "expected_benefit"])).select("node_id", "plan_id")


TESTED = """tn AS (SELECT DISTINCT lower(name) AS t FROM m_symbols WHERE regexp_matches(lower(file), 'test|_spec\\.rs$|\\.spec\\.ts$|\\.test\\.ts$')),
cv AS (SELECT DISTINCT n FROM (SELECT DISTINCT lower(name) AS n FROM m_symbols) JOIN tn ON contains(t, n)), al AS (SELECT COALESCE(max(contains(t, 'test')), false) AS a FROM tn)"""


@query("c15_substring_tests", f"WITH {TESTED} SELECT n AS name FROM cv")
def _(t):
    low = t.symbols.select(F.lower("name").alias("name"), "file")
    tests = low.filter(cl.is_test_path_strict(F.col("file"))).select(F.col("name").alias("test_name"))
    return scale.any_text_contains(low, "name", tests, "test_name")


@query("j05_test_gaps", f"""WITH {TESTED}, r AS (SELECT symbol_id, name, file, lower(name) AS l, a OR n IS NOT NULL AS has FROM m_symbols CROSS JOIN al LEFT JOIN cv ON n = lower(name))
SELECT symbol_id, name, file, 'NoTests' AS gap_type FROM r WHERE NOT has UNION ALL SELECT symbol_id, name, file, 'MissingEdgeCases' FROM r WHERE has AND NOT regexp_matches(l, 'edge|boundary')
UNION ALL SELECT symbol_id, name, file, 'MissingErrorTests' FROM r WHERE has AND NOT regexp_matches(l, 'error|fail')""")
def _(t):
    return hl.test_gaps(t.symbols)


RISK = """rk AS (SELECT edit_type, round(avg(CAST(NOT (approved_by_user AND validation_passed AND tests_passed AND NOT rollback_occurred) AS DOUBLE)), 6) AS risk FROM m_patches GROUP BY 1),
tg AS (SELECT name, name AS request_id, CASE WHEN length(name) % 2 = 0 THEN (SELECT max(risk) FROM rk) ELSE 0.1::DOUBLE END AS risk FROM hot)"""


@query("j06_edit_context", f"""WITH {RES}, {HOT}, {RISK},
own AS (SELECT request_id, s.file, s.start_line, s.end_line, 0 AS priority FROM tg JOIN ba USING (name) JOIN m_symbols s ON s.symbol_id = aid),
im AS (SELECT request_id, s.file, s.start_line, s.end_line, 1 FROM tg JOIN m_calls c ON c.callee_symbol = tg.name JOIN ba ON ba.name = c.caller_symbol JOIN m_symbols s ON s.symbol_id = aid),
ca AS (SELECT request_id, s.file, s.start_line, s.end_line, 2 FROM tg JOIN ba USING (name) JOIN inn ON inn.a = aid JOIN m_symbols s ON s.symbol_id = inn.b WHERE risk >= 0.4)
SELECT * FROM own UNION SELECT * FROM im UNION SELECT * FROM ca""")
def _(t):
    hot = sm.hot_callees(t.kept("calls")).select(F.col("callee_symbol").alias("name"), F.lit(1).alias("k"))
    top = oc.edit_risk(t.patches).agg(F.max("risk").alias("top")).withColumn("k", F.lit(1))
    targets = hot.join(top, "k").select(F.col("name").alias("request_id"), "name", F.when(F.length("name") % 2 == 0, F.col("top")).otherwise(0.1).alias("risk"))
    return cx.edit_context(targets, t.symbols, t.kept("calls"))


FAILED = """SELECT event_id AS failure_id, CASE event_type WHEN 'error' THEN 'unit_tests' WHEN 'click' THEN 'build' ELSE 'deploy' END AS failure_stage,
  CASE WHEN value > 40 THEN concat('Timeout after ', CAST(user_id AS STRING)) ELSE 'exit 1' END AS failure_message FROM {0}"""


@query("j07_stage_analysis", f"""WITH f AS ({FAILED.format('events')}), s AS (SELECT unnest(['checkout', 'build', 'unit_tests', 'integration_tests', 'deploy']) AS stage)
SELECT failure_id, stage, 'slow_stage' AS finding FROM f CROSS JOIN s WHERE contains(stage, 'integration') UNION ALL SELECT failure_id, stage, 'redundant_build' FROM f CROSS JOIN s WHERE contains(stage, 'build') AND contains(failure_stage, 'test')
UNION ALL SELECT failure_id, stage, 'unused_test' FROM f CROSS JOIN s WHERE contains(stage, 'test') AND contains(lower(failure_message), 'timeout')""")
def _(t):
    return hl.stage_analysis(t.spark.sql(FAILED.format("{events}"), events=t.events))


# ---- context -------------------------------------------------------------------------------

REQ = "rq AS (SELECT symbol_id AS request_id, symbol_id FROM m_symbols WHERE type = 'class' AND file LIKE 'src/auth%')"


def requests(t, radius=2):
    return t.symbols.filter("type = 'class' AND file LIKE 'src/auth%'").select(
        F.col("symbol_id").alias("request_id"), "symbol_id", F.when(F.col("end_line") % 2 == 0, radius).otherwise(1).alias("radius"))


def planned_sql(req: str, callers: str, budget: int) -> str:
    return f"""dir AS (SELECT DISTINCT request_id, outn.b FROM {req} JOIN outn ON outn.a = symbol_id),
n1 AS (SELECT DISTINCT request_id, radius, e.b FROM {req} JOIN {callers} e ON e.a = symbol_id WHERE e.b <> symbol_id),
n2 AS (SELECT DISTINCT request_id, e.b FROM n1 JOIN {callers} e ON e.a = n1.b WHERE radius >= 2),
nn AS (SELECT request_id, b FROM n1 UNION SELECT request_id, b FROM n2),
it AS (SELECT request_id, file, start_line, end_line, 0 AS priority FROM {req} JOIN m_symbols USING (symbol_id)
  UNION ALL SELECT request_id, s.file, n.start_line, n.end_line, 1 FROM {req} JOIN m_nodes n USING (symbol_id) JOIN m_symbols s USING (symbol_id)
  UNION ALL SELECT request_id, s.file, s.start_line, s.end_line, 2 FROM dir JOIN m_symbols s ON s.symbol_id = b
  UNION ALL SELECT nn.request_id, s.file, s.start_line, s.end_line, 3 FROM nn JOIN m_symbols s ON s.symbol_id = b
    WHERE (nn.request_id, b) NOT IN (SELECT (request_id, b) FROM dir) AND (nn.request_id, b) NOT IN (SELECT (request_id, symbol_id) FROM {req})),
un AS (SELECT request_id, file, start_line, end_line, min(priority) AS priority FROM it GROUP BY ALL),
kp AS (SELECT * FROM un a WHERE NOT EXISTS (SELECT 1 FROM un b WHERE a.request_id = b.request_id AND a.file = b.file AND b.priority <= a.priority AND b.start_line <= a.start_line AND b.end_line >= a.end_line
  AND (b.start_line < a.start_line OR b.end_line > a.end_line))),
hm AS (SELECT request_id, split_part(file, '/', 2) AS hmod FROM {req} JOIN m_symbols USING (symbol_id)),
mr AS (SELECT kp.*, CASE WHEN split_part(kp.file, '/', 2) = hmod THEN 0 WHEN e.to_module IS NOT NULL THEN 1 ELSE 2 END AS module_rank,
  CAST(ceil(least(greatest((end_line - start_line + 1) * 40, 120), 4000) / 3.0::DOUBLE) AS BIGINT) AS cost
  FROM kp JOIN hm USING (request_id) LEFT JOIN m_module_edges e ON e.from_module = hmod AND e.to_module = split_part(kp.file, '/', 2)),
bg AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY request_id ORDER BY priority, module_rank, file, start_line, end_line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM mr),
pc AS (SELECT * FROM bg WHERE used <= {budget})"""


REQ_R = "rq AS (SELECT symbol_id AS request_id, symbol_id, CASE WHEN end_line % 2 = 0 THEN 2 ELSE 1 END AS radius FROM m_symbols WHERE type = 'class' AND file LIKE 'src/auth%')"


@query("i11_planned_context", f"WITH {RES}, {REQ_R}, {planned_sql('rq', 'outn', 2200)} SELECT request_id, file, start_line, end_line, priority, module_rank, cost, used FROM pc")
def _(t):
    return cx.planned_context(requests(t), t.symbols, t.kept("calls"), t.nodes, t.module_edges, 3200, 2).select(
        "request_id", "file", "start_line", "end_line", "priority", "module_rank", "cost", "used")


NREQ = "rq AS (SELECT DISTINCT symbol_id AS request_id, symbol_id, 1 AS radius FROM m_nodes WHERE symbol_id IN (SELECT symbol_id FROM m_symbols))"


def node_requests(t):
    """Written once: every use would bring the symbols' ids together again. By merging, as one column of a file looks small."""
    ids = t.symbols.select("symbol_id").hint("merge")
    return cut_lineage(t.nodes.select("symbol_id").distinct().join(ids, "symbol_id", "left_semi").select(
        F.col("symbol_id").alias("request_id"), "symbol_id", F.lit(1).alias("radius")))


@query("i12_reasoning_context", f"""WITH {RES}, {NREQ},
rg AS (SELECT request_id, s.file, n.start_line, n.end_line, max(n.end_line) OVER (PARTITION BY request_id ORDER BY n.start_line, n.end_line, n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, n.pos FROM rq JOIN m_nodes n USING (symbol_id) JOIN m_symbols s USING (symbol_id)),
ig AS (SELECT *, sum(CASE WHEN start_line <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY request_id ORDER BY start_line, end_line, pos ROWS UNBOUNDED PRECEDING) AS island FROM rg),
sp AS (SELECT request_id, file, min(start_line) AS start_line, max(end_line) AS end_line FROM ig GROUP BY request_id, file, island),
dp AS (SELECT DISTINCT request_id, s.file, s.start_line, s.end_line FROM rq JOIN nb ON nb.a = rq.symbol_id JOIN m_symbols s ON s.symbol_id = nb.b WHERE nb.b <> rq.symbol_id)
SELECT request_id, file, start_line, end_line, 'logic' AS kind FROM sp UNION ALL
SELECT request_id, file, start_line, end_line, CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.request_id = dp.request_id AND sp.file = dp.file AND sp.start_line <= dp.start_line AND sp.end_line >= dp.end_line) THEN 'covered_dependency' ELSE 'dependency' END FROM dp""")
def _(t):
    return cx.reasoning_context(node_requests(t), t.symbols, t.kept("calls"), t.nodes)


@query("i13_hybrid_context", f"""WITH {RES}, {NREQ}, {planned_sql('rq', 'outn', 2200)}, {CONTROL}, {DATA}, {CLUSTERS},
c1x AS (SELECT symbol_id, count(*) AS cf FROM (SELECT symbol_id FROM nx UNION ALL SELECT symbol_id FROM br UNION ALL SELECT symbol_id FROM lb UNION ALL SELECT symbol_id FROM ex) GROUP BY 1),
c2x AS (SELECT symbol_id, count(*) AS dfn FROM df GROUP BY 1), c3x AS (SELECT symbol_id, count(*) AS cl FROM clusters GROUP BY 1)
SELECT request_id, pc.file, pc.start_line, pc.end_line, priority, CAST(100 - priority * 10 + CASE WHEN used * 3 <= 11200 THEN 5 ELSE 0 END + CASE WHEN COALESCE(cl, 0) > 0 AND s.file = pc.file THEN 12 ELSE 0 END
  + floor(least(COALESCE(cf, 0), 20) / 4.0) + floor(least(COALESCE(dfn, 0), 20) / 5.0) + least(COALESCE(cl, 0), 6) AS BIGINT) AS hybrid_score
FROM pc JOIN rq USING (request_id) JOIN m_symbols s ON s.symbol_id = rq.symbol_id LEFT JOIN c1x ON c1x.symbol_id = s.symbol_id LEFT JOIN c2x ON c2x.symbol_id = s.symbol_id LEFT JOIN c3x ON c3x.symbol_id = s.symbol_id""")
def _(t):
    req = node_requests(t)
    planned = cx.planned_context(req, t.symbols, t.kept("calls"), t.nodes, t.module_edges, 3200, 1)
    return cx.hybrid_context(planned, req, t.symbols, cl.with_effective_label(t.nodes), 3200)


@query("i25_workspace_context", f"""WITH {RES}, {REQ_R}, {planned_sql('rq', 'outn', 2200)},
rp AS (SELECT DISTINCT 'repo_' || CAST(repo_id AS STRING) AS name, 'workspace/' || CAST(repo_id AS STRING) AS path, repo_id FROM m_symbols), w AS (SELECT * FROM rp WHERE name = 'repo_1' OR path = 'workspace/2'),
fr AS (SELECT file, min(repo_id) AS repo_id FROM m_symbols GROUP BY 1)
SELECT w.name, w.path, request_id, pc.file, start_line, end_line FROM pc JOIN fr USING (file) JOIN w USING (repo_id)""")
def _(t):
    planned = cx.planned_context(requests(t), t.symbols, t.kept("calls"), t.nodes, t.module_edges, 3200, 2)
    home = t.symbols.groupBy("file").agg(F.concat(F.lit("repo_"), F.min("repo_id").cast("string")).alias("repo"))
    repos = t.symbols.select(F.concat(F.lit("repo_"), F.col("repo_id").cast("string")).alias("name"), F.concat(F.lit("workspace/"), F.col("repo_id").cast("string")).alias("path")).distinct()
    scope = t.spark.createDataFrame([("repo_1",), ("workspace/2",)], "entry string")
    return cx.workspace_context(planned.join(home, "file"), repos, scope).select("name", "path", "request_id", "file", "start_line", "end_line")
