"""Join, call graph and graph traversal queries."""

from pyspark.sql import functions as F

from .registry import query
from ..operators import callgraph as cg, graph as gr, search as se, summaries as sm

RANK = "CASE type WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, symbol_id DESC"
RES = f"""bl AS (SELECT name, file, symbol_id AS lid FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY {RANK}) AS r FROM m_symbols) WHERE r = 1),
ba AS (SELECT name, symbol_id AS aid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {RANK}) AS r FROM m_symbols) WHERE r = 1),
rc AS (SELECT c.*, COALESCE(bl.lid, CASE WHEN c.callee_file IS NULL THEN ba.aid END) AS callee_id FROM m_calls c
  LEFT JOIN bl ON bl.name = c.callee_symbol AND bl.file = COALESCE(c.callee_file, c.file) LEFT JOIN ba ON ba.name = c.callee_symbol),
rr AS (SELECT c.*, COALESCE(bl.lid, ba.aid) AS caller_id FROM m_calls c LEFT JOIN bl ON bl.name = c.caller_symbol AND bl.file = c.file LEFT JOIN ba ON ba.name = c.caller_symbol),
outn AS (SELECT DISTINCT s.symbol_id AS a, callee_id AS b FROM m_symbols s JOIN rc ON rc.caller_symbol = s.name AND rc.file = s.file WHERE callee_id IS NOT NULL),
inn AS (SELECT DISTINCT s.symbol_id AS a, caller_id AS b FROM m_symbols s JOIN rr ON rr.callee_symbol = s.name AND rr.callee_file IS NULL
  UNION SELECT DISTINCT s.symbol_id, caller_id FROM m_symbols s JOIN rr ON rr.callee_symbol = s.name AND rr.callee_file = s.file),
nb AS (SELECT * FROM outn UNION SELECT * FROM inn)"""
HOT = "hot AS (SELECT callee_symbol AS name FROM m_calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"


def hops(seed_sql: str, edges: str, radius: int, name: str = "hop") -> str:
    """Breadth-first levels as one table ``name`` (seed, node, depth)."""
    out = [f"{name}0 AS ({seed_sql})", f"{name}v0 AS (SELECT seed, node, 0 AS depth FROM {name}0)"]
    for i in range(1, radius + 1):
        out.append(f"{name}{i} AS (SELECT DISTINCT p.seed, e.b AS node FROM {name}{i - 1} p JOIN {edges} e ON e.a = p.node "
                   f"WHERE (p.seed, e.b) NOT IN (SELECT (seed, node) FROM {name}v{i - 1}))")
        out.append(f"{name}v{i} AS (SELECT * FROM {name}v{i - 1} UNION ALL SELECT seed, node, {i} FROM {name}{i})")
    out.append(f"{name} AS (SELECT seed, node, CAST(depth AS INT) AS depth FROM {name}v{radius})")
    return ", ".join(out)


@query("c01_metadata_search", """
WITH q AS (SELECT DISTINCT 'm' || CAST(CAST(substr(p_brand, 7) AS INT) AS STRING) AS query FROM part UNION SELECT DISTINCT 'owner_' || substr(p_brand, 7) FROM part
  UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part UNION SELECT DISTINCT 'trait_' || lower(p_type) FROM part),
d AS (SELECT * FROM m_symbols JOIN m_meta USING (symbol_id)),
h AS (SELECT query, symbol_id, file, start_line, end_line, row_number() OVER (PARTITION BY query ORDER BY file, start_line, end_line, symbol_id) AS r FROM q JOIN d ON
  lower(name) = lower(query) OR contains(lower(name), lower(query)) OR lower(owner_name) = lower(query) OR lower(trait_name) = lower(query) OR contains(lower(module_path), lower(query)) OR lower(crate_name) = lower(query))
SELECT query, symbol_id, file, CAST(r AS INT) AS rank FROM h WHERE r <= 20""")
def _(t):
    p = t.part
    q = (p.select(F.concat(F.lit("m"), F.substring("p_brand", 7, 9)).alias("query")).union(p.select(F.concat(F.lit("owner_"), F.substring("p_brand", 7, 9))))
         .union(p.select(F.replace("p_name", F.lit(" "), F.lit("_")))).union(p.select(F.concat(F.lit("trait_"), F.lower("p_type"))))).distinct()
    return se.metadata_search(q, t.symbols.join(t.meta, "symbol_id"), 20).select("query", "symbol_id", "file", "rank")


@query("c02_module_of_symbol", "SELECT symbol_id, module, module_path FROM m_symbols LEFT JOIN (SELECT file, min(module) AS module, min(module_path) AS module_path FROM m_modules GROUP BY 1) USING (file)")
def _(t):
    first = t.modules.groupBy("file").agg(F.min("module").alias("module"), F.min("module_path").alias("module_path"))
    return t.symbols.select("symbol_id", "file").join(first, "file", "left").drop("file")


@query("c03_named_edges", "SELECT DISTINCT a.name AS from_name, b.name AS to_name FROM m_edges JOIN m_symbols a ON src = a.symbol_id JOIN m_symbols b ON dst = b.symbol_id")
def _(t):
    return cg.named_edges(t.edges, t.symbols, "symbol_id", "name")


@query("c04_callee_resolution", f"WITH {RES} SELECT caller_symbol, file, callee_symbol, callee_file, callee_id FROM rc")
def _(t):
    return cg.resolve_callees(t.calls, t.symbols).select("caller_symbol", "file", "callee_symbol", "callee_file", "callee_id")


@query("c05_caller_resolution", f"WITH {RES} SELECT caller_symbol, file, callee_symbol, callee_file, caller_id FROM rr")
def _(t):
    return cg.resolve_callers(t.calls, t.symbols).select("caller_symbol", "file", "callee_symbol", "callee_file", "caller_id")


@query("c05_caller_counts", """SELECT s.symbol_id, COALESCE(a.n, 0) + COALESCE(b.n, 0) AS callers FROM m_symbols s
LEFT JOIN (SELECT callee_symbol, count(*) AS n FROM m_calls WHERE callee_file IS NULL GROUP BY 1) a ON a.callee_symbol = s.name
LEFT JOIN (SELECT callee_symbol, callee_file, count(*) AS n FROM m_calls WHERE callee_file IS NOT NULL GROUP BY 1, 2) b ON b.callee_symbol = s.name AND b.callee_file = s.file""")
def _(t):
    return cg.caller_counts(t.calls, t.symbols)


@query("c05_callers_of_hot_symbols", f"WITH {RES}, {HOT} SELECT a AS symbol_id, b AS caller_id FROM inn WHERE a IN (SELECT aid FROM hot JOIN ba USING (name))")
def _(t):
    hot = sm.hot_callees(t.kept("calls")).select(F.col("callee_symbol").alias("name"))
    ids = cg.seeds_by_name(hot, t.symbols).select(F.col("node").alias("symbol_id"))
    return cg.callers_of(t.symbols.join(ids, "symbol_id", "left_semi"), t.kept("calls"), t.symbols)


IMPORT_SQL = """b AS (SELECT file, local_name, target_file, source_symbol FROM (SELECT *, row_number() OVER (PARTITION BY file, local_name ORDER BY position DESC) AS r FROM m_imports) WHERE r = 1),
c AS (SELECT *, CASE WHEN contains(raw_name, '.') THEN regexp_replace(regexp_replace(raw_name, '\\.[^.]*$', ''), '[.?]+$', '') ELSE '' END AS base,
  CASE WHEN contains(raw_name, '.') THEN regexp_extract(raw_name, '\\.([^.]*)$', 1) ELSE '' END AS member FROM m_rawcalls),
r AS (SELECT c.file, c.caller_symbol, c.raw_name, CASE WHEN x.file IS NOT NULL THEN COALESCE(x.source_symbol, c.raw_name) WHEN y.file IS NOT NULL AND member <> '' THEN member ELSE c.raw_name END AS callee_symbol,
  CASE WHEN x.file IS NOT NULL THEN x.target_file WHEN y.file IS NOT NULL AND member <> '' THEN y.target_file END AS callee_file
  FROM c LEFT JOIN b x ON x.file = c.file AND x.local_name = c.raw_name LEFT JOIN b y ON y.file = c.file AND y.local_name = c.base)"""


@query("c06_import_targets", f"WITH {IMPORT_SQL} SELECT * FROM r")
def _(t):
    return cg.import_targets(t.rawcalls, t.imports)


@query("c07_local_targets", """SELECT caller_symbol, callee_symbol, file, CASE WHEN EXISTS (SELECT 1 FROM m_symbols s WHERE s.file = c.file AND s.name = c.callee_symbol) THEN file ELSE callee_file END AS callee_file FROM m_calls c""")
def _(t):
    return cg.annotate_local_targets(t.calls, t.symbols)


def _chase() -> str:
    out = ["""n AS (SELECT file, exported_name, source_name, target_file, position FROM (SELECT *, row_number() OVER (PARTITION BY file, exported_name ORDER BY position) AS r FROM m_reexports WHERE kind = 'named') WHERE r = 1),
s AS (SELECT file, target_file, position FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS r FROM m_reexports WHERE kind = 'star') WHERE r = 1),
d AS (SELECT file, exported_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS r FROM m_reexports WHERE kind = 'default') WHERE r = 1),
h0 AS (SELECT callee_symbol, callee_file, callee_symbol AS cn, callee_file AS cf FROM (SELECT DISTINCT callee_symbol, callee_file FROM m_calls WHERE callee_file IS NOT NULL UNION SELECT DISTINCT 'default', file FROM m_symbols))"""]
    for i in range(1, 5):
        out.append(f"""h{i} AS (SELECT callee_symbol, callee_file,
  CASE WHEN cn = 'default' AND d.file IS NOT NULL THEN d.name WHEN n.file IS NOT NULL AND (s.file IS NULL OR n.position <= s.position) THEN n.source_name ELSE cn END AS cn,
  CASE WHEN cn = 'default' AND d.file IS NOT NULL THEN cf WHEN n.file IS NOT NULL AND (s.file IS NULL OR n.position <= s.position) THEN n.target_file WHEN s.file IS NOT NULL THEN s.target_file ELSE cf END AS cf
  FROM h{i - 1} LEFT JOIN n ON n.file = cf AND n.exported_name = cn LEFT JOIN s ON s.file = cf LEFT JOIN d ON d.file = cf)""")
    return ", ".join(out)


@query("c08_reexport_chase", f"WITH {_chase()} SELECT callee_symbol, callee_file, cn AS final_symbol, cf AS final_file FROM h4")
def _(t):
    r = t.reexports
    targets = t.calls.filter("callee_file IS NOT NULL").select("callee_symbol", "callee_file").union(
        t.symbols.select(F.lit("default"), "file")).distinct()
    return cg.chase_reexports(targets, r.filter("kind = 'named'"), r.filter("kind = 'star'"),
                              r.filter("kind = 'default'").select("file", F.col("exported_name").alias("name"), "position"))


@query("c09_uncalled_symbols", "SELECT symbol_id, name, file FROM m_symbols WHERE name NOT IN (SELECT raw_name FROM m_rawcalls)")
def _(t):
    return cg.uncalled_symbols(t.symbols, t.rawcalls.withColumnRenamed("raw_name", "callee_symbol")).select("symbol_id", "name", "file")


@query("c10_impacted_files", "SELECT DISTINCT file FROM m_symbols WHERE name IN (SELECT caller_symbol FROM m_calls WHERE callee_file LIKE 'src/auth%')")
def _(t):
    hit = t.calls.filter(F.col("callee_file").startswith("src/auth")).select(F.col("caller_symbol").alias("name"))
    return t.symbols.join(hit, "name", "left_semi").select("file").distinct()


@query("c11_reciprocal_edges", "SELECT a.src AS a, a.dst AS b FROM m_edges a JOIN m_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def _(t):
    return cg.reciprocal(t.edges, "src", "dst")


@query("c14_sdk_usage", """
WITH sh AS (SELECT to_repo FROM m_repo_edges GROUP BY 1 HAVING count(DISTINCT from_repo) >= 2)
SELECT r.name, (SELECT count(DISTINCT to_repo) FROM m_repo_edges e WHERE e.from_repo = r.name AND to_repo IN (SELECT to_repo FROM sh)) AS used,
  (SELECT count(*) FROM sh WHERE to_repo <> r.name) AS available FROM m_repos r""")
def _(t):
    return cg.sdk_usage(t.repos, t.repo_edges)


@query("c18_file_evidence", """
WITH i AS (SELECT file, count(DISTINCT target_file) AS imported_files, count(DISTINCT local_name) AS imported_names, min(target_file) AS first_import FROM m_imports GROUP BY 1)
SELECT symbol_id, COALESCE(imported_files, 0) AS imported_files, COALESCE(imported_names, 0) AS imported_names, first_import FROM m_symbols LEFT JOIN i USING (file)""")
def _(t):
    return se.file_evidence(t.symbols, t.imports).select("symbol_id", "imported_files", "imported_names", "first_import")


@query("g01_impacted_tests", "SELECT DISTINCT file FROM m_calls WHERE regexp_matches(lower(file), 'test|spec')")
def _(t):
    return cg.impact(t.symbols, t.calls).filter("is_test").select("file").distinct()


@query("g04_neighbour_union", f"WITH {RES} SELECT a AS symbol_id, b AS neighbour_id FROM nb WHERE a IN (SELECT aid FROM ba WHERE name IN (SELECT callee_symbol FROM m_calls WHERE callee_file LIKE 'src/auth%'))")
def _(t):
    from ..operators import sets as st
    wanted = t.kept("calls").filter(F.col("callee_file").startswith("src/auth")).select(F.col("callee_symbol").alias("name")).distinct()
    seeds = cg.best_anywhere(t.symbols).join(wanted, "name", "left_semi").select(F.col("any_id").alias("symbol_id"))
    s = t.symbols.join(seeds, "symbol_id", "left_semi").select("symbol_id", "name", "file")
    out = cg.resolve_callees(t.kept("calls"), t.symbols).filter("callee_id IS NOT NULL").select(
        F.col("caller_symbol").alias("name"), "file", F.col("callee_id").alias("neighbour_id")).distinct()
    callees = s.join(out, ["name", "file"])
    return st.neighbour_union(callees, cg.callers_of(s, t.kept("calls"), t.symbols).withColumnRenamed("caller_id", "neighbour_id"))


@query("h01_dependency_neighbourhood", f"WITH {RES}, {HOT}, {hops('SELECT hot.name AS seed, aid AS node FROM hot JOIN ba USING (name)', 'nb', 2)} SELECT * FROM hop")
def _(t):
    hot = sm.hot_callees(t.kept("calls")).select(F.col("callee_symbol").alias("name"))
    return cg.neighbourhood(t.kept("calls"), t.symbols, cg.seeds_by_name(hot, t.symbols), 2)


SIZES = "SELECT seed, depth, count(*) AS nodes FROM hop GROUP BY 1, 2"


@query("h01_thousand_neighbourhoods", f"WITH {RES}, {HOT.replace('LIMIT 5', 'LIMIT 1000')}, {hops('SELECT hot.name AS seed, aid AS node FROM hot JOIN ba USING (name)', 'nb', 2)} {SIZES}")
def _(t):
    hot = sm.hot_callees(t.kept("calls"), 1000).select(F.col("callee_symbol").alias("name"))
    return cg.neighbourhood_sizes(t.kept("calls"), t.symbols, cg.seeds_by_name(hot, t.symbols), 2)


@query("h02_directed_neighbourhood", f"WITH {RES}, {HOT}, {hops('SELECT hot.name AS seed, aid AS node FROM hot JOIN ba USING (name)', 'outn', 3)} SELECT * FROM hop")
def _(t):
    hot = sm.hot_callees(t.kept("calls")).select(F.col("callee_symbol").alias("name"))
    return cg.neighbourhood(t.kept("calls"), t.symbols, cg.seeds_by_name(hot, t.symbols), 3, callers=False)


NEXT = """lg AS (SELECT symbol_id || ':' || pos AS a, symbol_id || ':' || lead(pos) OVER (PARTITION BY symbol_id ORDER BY start_line, end_line, pos) AS b FROM m_nodes),
lgu AS (SELECT a, b FROM lg WHERE b IS NOT NULL UNION SELECT b, a FROM lg WHERE b IS NOT NULL)"""
TRY = "SELECT symbol_id || ':' || pos AS seed, symbol_id || ':' || pos AS node FROM m_nodes WHERE node_type = 'Try'"


@query("h03_logic_neighbourhood", f"WITH {NEXT}, {hops(TRY, 'lgu', 2)} SELECT * FROM hop")
def _(t):
    from ..operators import flow
    key = lambda c: F.concat_ws(":", "symbol_id", c)
    e = flow.next_edges(t.nodes).select(key("from_pos").alias("src"), key("to_pos").alias("dst"))
    seeds = t.nodes.filter("node_type = 'Try'").select(key("pos").alias("seed"), key("pos").alias("node"))
    return gr.k_hop(seeds, gr.links_of(e, directed=False), 2)


CHANGED = "SELECT DISTINCT name, file FROM m_symbols WHERE file LIKE 'src/auth%' AND type = 'class'"


@query("h04_one_hop_impact", f"""SELECT DISTINCT callee_symbol AS changed, caller_symbol AS impacted_symbol, file, regexp_matches(lower(file), 'test|spec') AS is_test
FROM m_calls WHERE callee_symbol IN (SELECT name FROM ({CHANGED}))""")
def _(t):
    return cg.impact(t.symbols.filter("file LIKE 'src/auth%' AND type = 'class'"), t.calls)


@query("h05_file_scoped_impact", f"""WITH {RES}, ch AS ({CHANGED} UNION SELECT DISTINCT upper(name), 'src/nowhere.ts' FROM m_symbols WHERE type = 'function'
   UNION SELECT DISTINCT name, 'src/gone.ts' FROM m_symbols WHERE type = 'class' AND file LIKE 'src/billing%'),
tg AS (SELECT file, lower(name) AS l, symbol_id, name FROM (SELECT *, row_number() OVER (PARTITION BY file, lower(name) ORDER BY start_line, name, symbol_id) AS r FROM m_symbols) WHERE r = 1),
f AS (SELECT ch.name AS changed, ch.file, tg.symbol_id FROM ch LEFT JOIN tg ON tg.file = ch.file AND tg.l = lower(ch.name))
SELECT DISTINCT changed, f.file, s.name AS impacted_symbol, s.file AS impacted_file FROM f JOIN inn ON inn.a = f.symbol_id JOIN m_symbols s ON s.symbol_id = inn.b
UNION SELECT changed, f.file, caller_symbol, c.file FROM f JOIN m_calls c ON c.callee_symbol = f.changed WHERE f.symbol_id IS NULL""")
def _(t):
    s = t.symbols
    changed = (s.filter("file LIKE 'src/auth%' AND type = 'class'").select("name", "file")
               .union(s.filter("type = 'function'").select(F.upper("name"), F.lit("src/nowhere.ts")))
               .union(s.filter("type = 'class' AND file LIKE 'src/billing%'").select("name", F.lit("src/gone.ts")))).distinct()
    return cg.impact_in_file(changed, t.kept("calls"), s)


ORIGIN = "org AS (SELECT to_repo AS seed FROM m_repo_edges GROUP BY 1 ORDER BY count(DISTINCT from_repo) DESC, 1 LIMIT 1)"


def origin(t):
    return sm.shared_libraries(t.repo_edges).orderBy(F.desc("dependents"), "library").limit(1).select(
        F.col("library").alias("seed"), F.col("library").alias("node"))


@query("h06_reachability", f"""WITH RECURSIVE {ORIGIN}, reach AS (SELECT seed, seed AS node FROM org UNION SELECT reach.seed, to_repo FROM reach JOIN m_repo_edges ON from_repo = node)
SELECT seed, node FROM reach WHERE node <> seed""")
def _(t):
    return gr.reachable(t.repo_edges.select(F.col("from_repo").alias("src"), F.col("to_repo").alias("dst")), origin(t))


PLAN_NODES = "pn AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS node FROM lineitem)"
PLAN_DEPS = "pd AS (SELECT a.plan_id, a.node, b.node AS dep FROM pn a JOIN pn b ON a.plan_id = b.plan_id AND (b.node = a.node - 1 OR b.node = a.node - 3))"


@query("h07_topological_levels", f"""WITH RECURSIVE {PLAN_NODES}, {PLAN_DEPS},
lv AS (SELECT plan_id, node, 0 AS level FROM pn UNION SELECT pd.plan_id, pd.node, lv.level + 1 FROM lv JOIN pd ON pd.plan_id = lv.plan_id AND pd.dep = lv.node)
SELECT plan_id, node, max(level) AS level FROM lv GROUP BY 1, 2""")
def _(t):
    nodes = t.lineitem.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("node")).distinct()
    wanted = nodes.select("plan_id", "node", F.explode(F.array(F.col("node") - 1, F.col("node") - 3)).alias("dep"))
    deps = wanted.join(nodes.select("plan_id", F.col("node").alias("dep")), ["plan_id", "dep"], "left_semi")
    return gr.topological_levels(nodes, deps, "plan_id")


@query("h08_module_graph", """
WITH f AS (SELECT name, file AS ff FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, start_line) AS r FROM m_symbols) WHERE r = 1),
p AS (SELECT DISTINCT split_part(COALESCE(a.ff, c.file), '/', 2) AS from_module, split_part(b.ff, '/', 2) AS to_module FROM m_calls c JOIN f b ON b.name = c.callee_symbol LEFT JOIN f a ON a.name = c.caller_symbol)
SELECT * FROM p WHERE from_module <> to_module""")
def _(t):
    return cg.module_graph(t.calls, t.symbols)


FAIL = """fe AS (SELECT o_orderkey AS event_id, CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS ts_s FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 64),
fr AS (SELECT DISTINCT l_orderkey AS event_id, s.name AS symbol FROM lineitem JOIN m_symbols s ON s.symbol_id = l_partkey WHERE l_orderkey IN (SELECT event_id FROM fe))"""


def failures(t, newest=None):
    """Failures and the symbols on their stacks; ``newest`` is a report on the latest ones."""
    events = t.orders.filter("o_orderstatus = 'F'")
    if newest:
        events = events.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(newest)
    events = events.select(F.col("o_orderkey").alias("event_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_s"))
    lines = t.lineitem.join(events, F.col("l_orderkey") == F.col("event_id"), "left_semi").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("symbol_id"))
    return events, lines.join(t.symbols.select("symbol_id", F.col("name").alias("symbol")), "symbol_id").select("event_id", "symbol").distinct()


FAIL_HOPS = hops("SELECT DISTINCT event_id AS seed, aid AS node FROM fr JOIN ba ON ba.name = fr.symbol", "nb", 2)


@query("h09_debug_graph", f"WITH {RES}, {FAIL}, {FAIL_HOPS} SELECT seed AS event_id, node, depth FROM hop")
def _(t):
    _, frames = failures(t, 64)
    return cg.debug_graph(frames, t.kept("calls"), t.symbols)


@query("h09_debug_graph_sizes", f"WITH {RES}, {FAIL.replace('LIMIT 64', '')}, {FAIL_HOPS} {SIZES.replace('seed', 'seed AS event_id')}")
def _(t):
    """Every failure."""
    _, frames = failures(t)
    seeds = cg.seeds_by_name(frames.select(F.col("symbol").alias("name"), "event_id"), t.symbols, "event_id")
    return cg.neighbourhood_sizes(t.kept("calls"), t.symbols, seeds, 2).withColumnRenamed("seed", "event_id")


ROOT = f"""{RES}, {FAIL}, {FAIL_HOPS},
dg AS (SELECT s.symbol_id AS id, count(rc.callee_id) AS n FROM m_symbols s LEFT JOIN rc ON rc.caller_symbol = s.name AND rc.file = s.file GROUP BY 1),
pa AS (SELECT s.name AS symbol, count(*) AS changes, max(CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT)) AS last_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN m_symbols s ON s.symbol_id = l_partkey
  WHERE l_returnflag = 'R' GROUP BY 1),
ns AS (SELECT DISTINCT fr.event_id, rc.caller_symbol AS symbol, rc.file FROM rc JOIN m_symbols c ON c.symbol_id = rc.callee_id JOIN fr ON fr.symbol = c.name),
sc AS (SELECT h.seed AS event_id, h.node, s.name AS symbol,
  CASE WHEN fr.symbol IS NOT NULL THEN 1.0::DOUBLE WHEN ns.symbol IS NOT NULL THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END * 0.45::DOUBLE
  + COALESCE(1.0::DOUBLE / (1.0::DOUBLE + greatest(fe.ts_s - pa.last_s, 0) / 86400.0::DOUBLE), 0.2::DOUBLE) * 0.2::DOUBLE
  + COALESCE(least(pa.changes / 10.0::DOUBLE, 1.0::DOUBLE), 0.1::DOUBLE) * 0.2::DOUBLE
  + CASE WHEN dg.n = 0 THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE / (1.0::DOUBLE + dg.n), 0.1::DOUBLE) END * 0.15::DOUBLE AS score
  FROM hop h JOIN m_symbols s ON s.symbol_id = h.node JOIN fe ON fe.event_id = h.seed JOIN dg ON dg.id = h.node LEFT JOIN pa ON pa.symbol = s.name
  LEFT JOIN fr ON fr.event_id = h.seed AND fr.symbol = s.name LEFT JOIN ns ON ns.event_id = h.seed AND ns.symbol = s.name AND ns.file = s.file)"""


@query("h10_root_causes", f"WITH {ROOT} SELECT event_id, node, symbol, round(score / max(score) OVER (PARTITION BY event_id), 6) AS probability FROM sc")
def _(t):
    events, frames = failures(t, 64)
    patches = (t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
               .join(t.symbols.select("symbol_id", F.col("name").alias("symbol")), F.col("l_partkey") == F.col("symbol_id"))
               .select("symbol", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_s")))
    return cg.rank_root_causes(cg.debug_graph(frames, t.kept("calls"), t.symbols), frames, events, patches, t.kept("calls"), t.symbols)


@query("e15_max_normalised", """SELECT event_id, event_type, round(value / max(value) OVER (PARTITION BY event_type), 6) AS share FROM events""")
def _(t):
    return cg.max_normalised(t.events.select("event_id", "event_type", "value"), "event_type", "value", "share")


@query("h11_organisation_graph", "SELECT r.name, e.to_repo AS depends_on FROM m_repos r LEFT JOIN m_repo_edges e ON e.from_repo = r.name")
def _(t):
    return cg.organisation_graph(t.repos, t.repo_edges)


@query("h12_service_graph", """
WITH m AS (SELECT DISTINCT split_part(file, '/', 2) AS from_module, repo_id FROM m_symbols),
d AS (SELECT DISTINCT repo_id, to_module || '_service' AS depends_on FROM m_module_edges JOIN m USING (from_module) WHERE contains(from_module, 'api') OR contains(from_module, 'service'))
SELECT DISTINCT CASE WHEN contains(name, 'service') THEN name ELSE name || '_service' END AS service, depends_on FROM m_repos r LEFT JOIN d ON d.repo_id = r.repo_id % 4""")
def _(t):
    mods = t.symbols.select(F.split("file", "/")[1].alias("from_module"), "repo_id").distinct()
    return cg.service_graph(t.repos.withColumn("repo_id", F.col("repo_id") % 4), t.module_edges.join(mods, "from_module"))


@query("h13_staged_order", f"""WITH RECURSIVE {ORIGIN}, reach AS (SELECT seed AS node FROM org UNION SELECT to_repo FROM reach JOIN m_repo_edges ON from_repo = node)
SELECT node AS repository, CASE WHEN regexp_matches(node, 'lib|sdk') THEN 0 WHEN regexp_matches(node, 'service|api') THEN 1 WHEN regexp_matches(node, 'client|app') THEN 2 ELSE 3 END AS stage_rank,
  CASE WHEN regexp_matches(node, 'lib|sdk') THEN 'libraries' WHEN regexp_matches(node, 'service|api') THEN 'services' WHEN regexp_matches(node, 'client|app') THEN 'clients' ELSE 'others' END AS stage FROM reach""")
def _(t):
    start = origin(t)
    hit = gr.reachable(t.repo_edges.select(F.col("from_repo").alias("src"), F.col("to_repo").alias("dst")), start)
    return cg.staged_order(hit.select("node").union(start.select("node")), "node")


@query("h14_symbol_bundle", f"""WITH {RES}, {HOT}, sd AS (SELECT aid AS id FROM hot JOIN ba USING (name))
SELECT id AS symbol_id, 'neighbour' AS kind, CAST(b AS STRING) AS item FROM sd JOIN nb ON nb.a = id WHERE b <> id
UNION SELECT id, 'logic_node', CAST(pos AS STRING) FROM sd JOIN m_nodes n ON n.symbol_id = id""")
def _(t):
    hot = sm.hot_callees(t.kept("calls")).select(F.col("callee_symbol").alias("name"))
    seeds = cg.seeds_by_name(hot, t.symbols)
    return se.symbol_bundle(seeds, cg.neighbourhood(t.kept("calls"), t.symbols, seeds, 1), t.nodes)


@query("h15_adaptive_radius", f"""WITH {RES},
o AS (SELECT s.symbol_id AS id, count(rc.callee_id) AS n FROM m_symbols s LEFT JOIN rc ON rc.caller_symbol = s.name AND rc.file = s.file GROUP BY 1),
i1 AS (SELECT callee_symbol AS name, count(*) AS n FROM m_calls WHERE callee_file IS NULL GROUP BY 1), i2 AS (SELECT callee_symbol AS name, callee_file AS file, count(*) AS n FROM m_calls WHERE callee_file IS NOT NULL GROUP BY 1, 2),
l AS (SELECT symbol_id AS id, count(*) AS n FROM m_nodes GROUP BY 1),
a AS (SELECT s.symbol_id, o.n + COALESCE(i1.n, 0) + COALESCE(i2.n, 0) AS fan_out, COALESCE(l.n, 0) AS logic_nodes FROM m_symbols s JOIN o ON o.id = s.symbol_id LEFT JOIN i1 ON i1.name = s.name
  LEFT JOIN i2 ON i2.name = s.name AND i2.file = s.file LEFT JOIN l ON l.id = s.symbol_id)
SELECT *, CASE WHEN logic_nodes > 24 THEN 1 WHEN logic_nodes < 8 THEN 2 ELSE 1 END AS logic_radius, CASE WHEN fan_out > 12 THEN 1 WHEN fan_out < 4 THEN 2 ELSE 1 END AS dependency_radius FROM a""")
def _(t):
    return cg.adaptive_radius(t.symbols, t.kept("calls"), t.nodes, 3200)


@query("h16_ownership_edges", """
SELECT owner_name AS caller_symbol, name AS callee_symbol, file, file AS callee_file FROM m_symbols JOIN m_meta USING (symbol_id) WHERE kind IN ('ImplBlock', 'Method') AND owner_name IS NOT NULL
UNION ALL SELECT trait_name, name, file, file FROM m_symbols JOIN m_meta USING (symbol_id) WHERE kind = 'ImplBlock' AND trait_name IS NOT NULL""")
def _(t):
    return cg.ownership_edges(t.symbols.join(t.meta, "symbol_id"))
