"""Sort, top-k and set queries."""

from pyspark.sql import functions as F

from .registry import query
from ..operators import quality as ql, ranking as rk, sets as st


@query("f01_canonical_order", "SELECT symbol_id, file, start_line, name FROM m_symbols ORDER BY file, start_line, name, symbol_id")
def _(t):
    return rk.canonical_order(t.symbols.select("symbol_id", "file", "start_line", "name"))


@query("f04_worst_cases", """
WITH u AS (SELECT DISTINCT run, metric, value, fixture, case_name FROM (
  SELECT run, 'latency' AS metric, CAST(latency_ms AS DOUBLE) AS value, fixture, case_name FROM m_cases
  UNION ALL SELECT run, 'tokens', CAST(approx_tokens AS DOUBLE), fixture, case_name FROM m_cases))
SELECT run, metric, value, fixture, case_name, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value DESC, fixture, case_name) AS r FROM u) WHERE r <= 5""")
def _(t):
    return ql.worst_cases(t.cases, ["run"])


@query("f05_architecture_order", """
SELECT repo AS name, importance, support_rank FROM (
  SELECT repo, CASE WHEN count(DISTINCT lang) >= 4 THEN 'high' ELSE 'medium' END AS importance, CAST(min(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS INT) AS support_rank,
    count(DISTINCT lang) AS n FROM m_docs GROUP BY 1)""")
def _(t):
    m = t.docs.groupBy(F.col("repo").alias("name")).agg(
        F.collect_set("lang").alias("signals"), F.min(F.when(F.col("lang") == "es", 1).otherwise(0)).alias("support_rank"))
    m = m.withColumn("importance", F.when(F.size("signals") >= 4, "high").otherwise("medium"))
    return rk.architecture_order(m).select("name", "importance", "support_rank")


@query("f06_evict_oldest", """SELECT operation, event_id FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts_ms DESC, event_id DESC) AS r FROM m_telemetry) WHERE r <= 100""")
def _(t):
    return rk.evict_oldest(t.telemetry, "operation", "ts_ms", "event_id", 100).select("operation", "event_id")


@query("f07_recent_modules", """SELECT module, modified FROM (SELECT model_used AS module, max(ts_ms) AS modified FROM m_patches GROUP BY 1) ORDER BY modified DESC, module LIMIT 3""")
def _(t):
    return rk.recent_modules(t.patches, "model_used", F.col("ts_ms"))


@query("f08_priority_modules", """
WITH m AS (SELECT repo AS module, count(DISTINCT lang) < 4 AS is_group, CAST(sum(n_chars) AS BIGINT) AS score FROM m_docs GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY is_group, score DESC, module) AS INT) AS rank FROM m ORDER BY is_group, score DESC, module LIMIT 3""")
def _(t):
    m = t.docs.groupBy(F.col("repo").alias("module")).agg((F.count_distinct("lang") < 4).alias("is_group"), F.sum("n_chars").alias("score"))
    return rk.priority_modules(m)


@query("g02_expected_vs_actual", """
WITH e AS (SELECT DISTINCT l_orderkey AS request_id, lower(p_name) AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'),
a AS (SELECT DISTINCT l_orderkey AS request_id, lower(p_name) AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
j AS (SELECT request_id, i, CASE WHEN e.i IS NOT NULL AND a.i IS NOT NULL THEN 3 WHEN e.i IS NOT NULL THEN 1 ELSE 2 END AS s FROM e FULL JOIN a USING (request_id, i))
SELECT request_id, count(CASE WHEN s = 1 THEN 1 END) AS missing, count(CASE WHEN s = 2 THEN 1 END) AS extra, count(CASE WHEN s = 3 THEN 1 END) AS shared,
  count(CASE WHEN s <> 3 THEN 1 END) = 0 AS aligned, count(CASE WHEN s = 1 THEN 1 END) = 0 AS complete FROM j GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("request_id"), F.col("p_name").alias("item"), "l_linestatus", "l_returnflag")
    return st.expected_vs_actual(rows.filter("l_linestatus = 'F'"), rows.filter("l_returnflag <> 'R'"), ["request_id"], "item", True)


@query("g03_context_delta", """
WITH s AS (SELECT c_custkey AS session_id, o_orderkey AS step, list_distinct(list(l_suppkey % 10)) AS refs FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT *, COALESCE(lag(refs) OVER (PARTITION BY session_id ORDER BY step), []) AS prev FROM s),
d AS (SELECT session_id, step, list_sort(list_filter(refs, lambda x: NOT list_contains(prev, x))) AS added, list_sort(list_filter(prev, lambda x: NOT list_contains(refs, x))) AS removed FROM p)
SELECT session_id, step, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM d WHERE len(added) + len(removed) BETWEEN 1 AND 4""")
def _(t):
    steps = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_custkey").alias("session_id"), F.col("o_orderkey").alias("step"))
             .agg(F.collect_set(F.col("l_suppkey") % 10).alias("refs")))
    out = st.context_delta(steps, "session_id", "step", "refs")
    return out.select("session_id", "step", F.array_join(F.col("added").cast("array<string>"), ",").alias("added"),
                      F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("g05_edge_dedupe", "SELECT DISTINCT symbol_id, pos % 3 AS from_pos, pos % 2 AS to_pos, node_type AS kind FROM m_nodes")
def _(t):
    edges = t.nodes.selectExpr("symbol_id", "pos % 3 AS from_pos", "pos % 2 AS to_pos", "node_type AS kind")
    return edges.dropDuplicates(["symbol_id", "from_pos", "to_pos", "kind"])


@query("g06_omission_overfetch", """
WITH c AS (SELECT l_orderkey AS case_id, list_distinct(list(CASE WHEN l_linestatus = 'O' THEN l_suppkey % 20 END)) AS inc,
  list_distinct(list(CASE WHEN l_returnflag = 'R' THEN l_suppkey % 20 END)) AS exc, list_distinct(list(l_partkey % 20)) AS act FROM lineitem GROUP BY 1)
SELECT case_id, CAST(len(list_filter(inc, lambda x: x IS NOT NULL AND NOT list_contains(act, x))) AS INT) AS omission_count,
  CAST(len(list_filter(exc, lambda x: x IS NOT NULL AND list_contains(act, x))) AS INT) AS overfetch_count FROM c""")
def _(t):
    cases = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey") % 20)).alias("must_include"),
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 20)).alias("must_not_include"),
        F.collect_set(F.col("l_partkey") % 20).alias("actual"))
    return st.omission_overfetch(cases)
