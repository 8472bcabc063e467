"""Search, ranking and summary queries."""

from pyspark.sql import functions as F

from .registry import query
from .q_c_joins import HOT, RES
from ..operators import callgraph as cg, context as cx, outcomes as oc, ranking as rk, search as se, summaries as sm
from ..session import cut_lineage

ASK = """q AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || CAST(p_size AS STRING) AS query FROM part
  UNION SELECT DISTINCT upper(split_part(p_name, ' ', 2)) FROM part UNION SELECT DISTINCT substr(p_name, 2, 4) || 'x' || substr(p_brand, 7) FROM part)"""


def asked(t):
    p = t.part
    return (p.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("query"))
            .union(p.select(F.upper(F.split("p_name", " ")[1]))).union(p.select(F.concat(F.substring("p_name", 2, 4), F.lit("x"), F.substring("p_brand", 7, 9))))).distinct()


CASCADE = f"""{ASK},
ex AS (SELECT query, 'exact' AS tier, s.name, s.file, s.start_line, s.symbol_id FROM q JOIN m_symbols s ON lower(s.name) = lower(query)),
co AS (SELECT query, 'contains' AS tier, s.name, s.file, s.start_line, s.symbol_id FROM q JOIN m_symbols s ON contains(lower(s.name), lower(query)) WHERE query NOT IN (SELECT query FROM ex)),
hits AS (SELECT * EXCLUDE (r), CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name, file, start_line, symbol_id) AS r FROM (SELECT * FROM ex UNION ALL SELECT * FROM co)) WHERE r <= 20)"""
SIM = "round(1 - levenshtein(lower({0}), lower({1})) / greatest(strlen({0}), strlen({1}))::DOUBLE, 6)"


@query("i01_search_cascade", f"WITH {CASCADE} SELECT * FROM hits")
def _(t):
    return se.search_cascade(asked(t), t.symbols, 20)


@query("i02_similarity", f"SELECT DISTINCT caller_symbol, callee_symbol, {SIM.format('caller_symbol', 'callee_symbol')} AS score FROM m_calls")
def _(t):
    return t.calls.select("caller_symbol", "callee_symbol").distinct().withColumn("score", F.round(se.similarity(F.col("caller_symbol"), F.col("callee_symbol")), 6))


FUZZY = f"""fz AS (SELECT query, s.name, s.file, s.start_line, s.symbol_id, {SIM.format('query', 's.name')} AS score FROM {{0}} CROSS JOIN m_symbols s),
fuzzy AS (SELECT * EXCLUDE (r), CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name, file, start_line, symbol_id) AS r FROM fz) WHERE r <= 8)"""


@query("f02_top_similar", f"""WITH q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS query FROM part), {FUZZY.format('q')} SELECT query, score, name, file, start_line, symbol_id, rank FROM fuzzy""")
def _(t):
    return se.fuzzy_top_k(t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query")).distinct(), t.symbols, 8)


@query("i03_search_with_fallback", f"""WITH {CASCADE}, rest AS (SELECT query FROM q WHERE query NOT IN (SELECT query FROM hits)), {FUZZY.format('rest')}
SELECT query, tier, name, file, start_line, symbol_id, rank FROM hits UNION ALL SELECT query, 'fuzzy', name, file, start_line, symbol_id, rank FROM fuzzy""")
def _(t):
    return se.search_with_fallback(asked(t), t.symbols)


@query("i04_term_search", """
WITH n AS (SELECT name, count(*) AS copies, list_filter(list_transform(regexp_extract_all(name, '[\\p{L}\\p{N}]+'), lambda w: lower(w)), lambda w: strlen(w) < 40) AS t FROM m_symbols GROUP BY 1),
st AS (SELECT CAST(sum(copies) AS DOUBLE) AS docs, CAST(sum(len(t) * copies) AS DOUBLE) / CAST(sum(copies) AS DOUBLE) AS avg FROM n),
p AS (SELECT name, copies, len(t) AS len, term, count(*) AS tf FROM (SELECT name, copies, t, unnest(t) AS term FROM n) GROUP BY 1, 2, 3, 4),
d AS (SELECT term, CAST(sum(copies) AS DOUBLE) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT p_name || ' ' || CAST(p_size AS STRING) AS query FROM part), qt AS (SELECT query, unnest(regexp_extract_all(query, '[\\p{L}\\p{N}]+')) AS term FROM q),
s AS (SELECT query, name, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score
  FROM qt JOIN p USING (term) JOIN d USING (term) CROSS JOIN st GROUP BY 1, 2)
SELECT query, name, score, symbol_id, file, CAST(r AS INT) AS rank FROM (SELECT query, s.name, score, symbol_id, file, row_number() OVER (PARTITION BY query ORDER BY score DESC, s.name, symbol_id) AS r
  FROM s JOIN m_symbols y ON y.name = s.name) WHERE r <= 10""")
def _(t):
    q = t.part.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("query")).distinct()
    return se.bm25(q, t.symbols, 10)


NORM = "trim(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
CAND = """c AS (SELECT DISTINCT task_id, text, callee_symbol AS symbol FROM m_tasks JOIN m_calls ON caller_symbol = symbol UNION SELECT DISTINCT task_id, text, symbol FROM m_tasks)"""


@query("i05_target_scorer", f"""WITH {CAND},
n AS (SELECT *, lower(text) AS ql, lower(symbol) AS sl, {NORM.format('text')} AS qn, {NORM.format('symbol')} AS sn FROM c),
k AS (SELECT *, string_split(qn, ' ') AS qt, list_filter(string_split(sn, ' '), lambda w: w <> '') AS st FROM n),
m AS (SELECT *, len(list_filter(st, lambda w: list_contains(qt, w))) AS known FROM k),
s AS (SELECT task_id, symbol, CASE WHEN contains(ql, sl) THEN CASE WHEN len(st) >= 2 THEN 90 ELSE 20 END + strlen(sl) ELSE 0 END
  + CASE WHEN sn <> '' AND contains(qn, sn) THEN CASE WHEN len(st) >= 2 THEN 220 ELSE 60 END + strlen(sn) ELSE 0 END
  + CASE WHEN len(st) > 0 AND known = len(st) THEN CASE WHEN len(st) >= 2 THEN 120 + 3 * len(st) ELSE 25 END ELSE 0 END + known * 5
  - CASE WHEN len(st) = 1 AND strlen(st[1]) <= 3 THEN 30 ELSE 0 END AS score FROM m)
SELECT task_id, symbol AS target, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, strlen(symbol) DESC, symbol) AS r FROM s WHERE score > 0) WHERE r = 1""")
def _(t):
    calls = t.calls.select(F.col("caller_symbol").alias("own"), F.col("callee_symbol").alias("symbol")).distinct()
    tasks = t.tasks.select("task_id", "text", F.col("symbol").alias("own"))
    cand = tasks.join(calls, "own").select("task_id", "text", "symbol").unionByName(tasks.select("task_id", "text", F.col("own").alias("symbol"))).distinct()
    return se.best_target(cand)


OBJ = """CASE WHEN regexp_matches(lower(file), 'test|spec') THEN 'tests' WHEN regexp_matches(lower(file), 'api|server|route') THEN 'api_surface'
  WHEN regexp_matches(lower(file), 'store|repo|db') THEN 'data_layer' WHEN regexp_matches(lower(file), 'ui|component|view') THEN 'ui_layer' ELSE 'application_logic' END"""
QF = f"""q AS (SELECT DISTINCT p_name || ' in ' || lower(p_type) || ' tests' AS query FROM part),
tk AS (SELECT query, token, count(*) AS times FROM (SELECT query, unnest(string_split(trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM q) WHERE length(token) >= 2 GROUP BY 1, 2),
wt AS (SELECT DISTINCT token FROM tk), f AS (SELECT DISTINCT file, {OBJ} AS objective FROM m_symbols),
y AS (SELECT DISTINCT file, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM m_symbols),
pt AS (SELECT token, file, 8 AS p FROM wt JOIN f ON contains(lower(file), token) UNION ALL SELECT token, file, 6 FROM wt JOIN f ON contains(objective, token)
  UNION ALL SELECT DISTINCT token, file, 10 FROM wt JOIN y ON contains(n, token)),
sc AS (SELECT query, file, CAST(sum(p * times) AS BIGINT) AS score FROM tk JOIN (SELECT token, file, sum(p) AS p FROM pt GROUP BY 1, 2) USING (token) GROUP BY 1, 2),
cf AS (SELECT query, file, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file) AS r FROM sc) WHERE r <= 18)"""


def wanted_files(t):
    q = t.part.select(F.concat(F.col("p_name"), F.lit(" in "), F.lower("p_type"), F.lit(" tests")).alias("query")).distinct()
    return q, se.candidate_files(q, sm.footprint(t.modules, t.symbols), t.symbols)


@query("i06_candidate_files", f"WITH {QF} SELECT * FROM cf")
def _(t):
    return wanted_files(t)[1]


@query("i06_candidate_symbols", f"""WITH {QF}, r AS (SELECT query, rank, file, name, symbol_id, row_number() OVER (PARTITION BY query, lower(name) ORDER BY rank, symbol_id) AS k FROM cf JOIN m_symbols USING (file))
SELECT query, name, file, CAST(s AS INT) AS symbol_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, symbol_id) AS s FROM r WHERE k = 1) WHERE s <= 64""")
def _(t):
    return se.candidate_symbols(wanted_files(t)[1], t.symbols.withColumn("place", F.col("symbol_id")))


TOP8 = "t8 AS (SELECT file, string_agg(name, ',' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_line, name, symbol_id) AS r FROM m_symbols) WHERE r <= {0} GROUP BY 1)"


@query("i07_project_footprint", f"""WITH {TOP8.format(8)} SELECT file, module, {OBJ} AS objective, COALESCE(names, '') AS top_symbols FROM m_modules LEFT JOIN t8 USING (file)""")
def _(t):
    return sm.footprint(t.modules, t.symbols).select("file", "module", "objective", F.array_join("names", ",").alias("top_symbols"))


@query("i08_definition_choice", f"""WITH {QF},
w AS (SELECT DISTINCT p_name || ' in ' || lower(p_type) || ' tests' AS query, s.name AS target FROM part JOIN m_symbols s ON s.symbol_id = p_partkey),
fs AS (SELECT lower(name) AS t, file, start_line, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), file ORDER BY start_line, symbol_id) AS r FROM m_symbols) WHERE r = 1),
j AS (SELECT w.query, target, fs.*, CASE WHEN cf.file IS NOT NULL THEN 120 ELSE 0 END AS base, string_split(trim(regexp_replace(lower(fs.file), '[^a-z0-9]+', ' ', 'g')), ' ') AS parts,
  trim(regexp_replace(lower(fs.file), '[^a-z0-9]+', ' ', 'g')) AS fn, string_split(trim(regexp_replace(lower(w.query), '[^a-z0-9]+', ' ', 'g')), ' ') AS toks
  FROM w JOIN fs ON fs.t = lower(target) LEFT JOIN cf ON cf.query = w.query AND cf.file = fs.file),
s AS (SELECT *, base + list_sum(list_transform(toks, lambda x: CASE WHEN list_contains(parts, x) THEN 20 WHEN contains(fn, x) THEN 8 ELSE 0 END)) AS score FROM j)
SELECT query, target, symbol_id, file, start_line, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, target ORDER BY score DESC, file, start_line) AS r FROM s) WHERE r = 1""")
def _(t):
    q, cand = wanted_files(t)
    w = t.part.join(t.symbols, F.col("p_partkey") == F.col("symbol_id")).select(
        F.concat(F.col("p_name"), F.lit(" in "), F.lower("p_type"), F.lit(" tests")).alias("query"), F.col("name").alias("target")).distinct()
    return se.pick_definition(w, t.symbols, cand)


@query("i09_context_confidence", f"""WITH {RES}, nbc AS (SELECT DISTINCT s.name FROM nb JOIN m_symbols s ON s.symbol_id = nb.a),
f AS (SELECT t.task_id, text, symbol AS target, contains(lower(symbol), lower(p_name)) AS l, p_size > 25 AS c, EXISTS (SELECT 1 FROM nbc WHERE nbc.name = t.symbol) AS n, p_size % 2 = 0 AS p FROM m_tasks t JOIN part ON p_partkey = task_id)
SELECT task_id, target, round(least(greatest(CASE WHEN {NORM.format('target')} <> '' AND contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g'))) THEN 0.35::DOUBLE ELSE 0 END
  + CASE WHEN l THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN p THEN 0.1::DOUBLE ELSE 0 END, 0), 1), 6) AS confidence FROM f""")
def _(t):
    counts = cg.caller_counts(t.calls, t.symbols).join(cg.callee_counts(t.calls, t.symbols), "symbol_id").join(t.symbols.select("symbol_id", "name"), "symbol_id")
    near = counts.filter("callers + callees > 0").select(F.col("name").alias("target")).distinct().withColumn("has_neighbours", F.lit(True))
    rows = t.tasks.join(t.part, F.col("p_partkey") == F.col("task_id")).select(
        "task_id", "text", F.col("symbol").alias("target"), F.contains(F.lower("symbol"), F.lower("p_name")).alias("lexical_hit"),
        (F.col("p_size") > 25).alias("is_candidate"), (F.col("p_size") % 2 == 0).alias("is_preferred"))
    rows = rows.join(near, "target", "left").withColumn("has_neighbours", F.coalesce("has_neighbours", F.lit(False)))
    return se.context_confidence(rows).select("task_id", "target", "confidence")


@query("i10_module_rank", """
SELECT DISTINCT c.file, c.callee_file, CASE WHEN split_part(c.callee_file, '/', 2) = split_part(c.file, '/', 2) THEN 0 WHEN e.to_module IS NOT NULL THEN 1 ELSE 2 END AS module_rank
FROM m_calls c LEFT JOIN m_module_edges e ON e.from_module = split_part(c.file, '/', 2) AND e.to_module = split_part(c.callee_file, '/', 2) WHERE callee_file IS NOT NULL""")
def _(t):
    pairs = t.calls.filter("callee_file IS NOT NULL").select("file", "callee_file").distinct()
    req = pairs.select(F.concat_ws("|", "file", "callee_file").alias("request_id"), F.col("callee_file").alias("f"), "file")
    home = req.select("request_id", F.col("file").alias("hf"))
    items = req.select("request_id", F.col("f").alias("file"))
    sym = home.select(F.col("request_id").alias("symbol_id"), F.col("hf").alias("file"))
    ranked = cx.with_module_rank(items, home.select("request_id", F.col("request_id").alias("symbol_id")), sym, t.module_edges)
    return ranked.select(F.split("request_id", r"\|")[0].alias("file"), F.split("request_id", r"\|")[1].alias("callee_file"), "module_rank")


@query("i14_query_hints", """
WITH q AS (SELECT DISTINCT symbol_id, module_path || '::' || owner_name AS query FROM m_meta UNION ALL SELECT symbol_id, crate_name FROM m_meta),
s AS (SELECT symbol_id, query, list_filter(string_split(lower(query), '::'), lambda x: x <> '') AS g FROM q)
SELECT symbol_id, query, g[len(g)] AS leaf, CASE WHEN len(g) > 1 THEN array_to_string(g[1:len(g) - 1], '::') END AS module_hint, CASE WHEN len(g) > 1 THEN g[1] END AS crate_hint FROM s""")
def _(t):
    q = t.meta.select("symbol_id", F.concat_ws("::", "module_path", "owner_name").alias("query")).union(t.meta.select("symbol_id", "crate_name"))
    h = se.query_hints(F.col("query"))
    return q.select("symbol_id", "query", h["leaf"].alias("leaf"), h["module_hint"].alias("module_hint"), h["crate_hint"].alias("crate_hint"))


TQ = "q AS (SELECT DISTINCT owner_name AS query FROM m_meta UNION SELECT DISTINCT module_path || '::' || replace(p_name, ' ', '_') FROM m_meta JOIN part ON p_partkey = symbol_id)"
MATCH = f"""{TQ}, h AS (SELECT query, lower(query) AS n, list_filter(string_split(lower(query), '::'), lambda x: x <> '') AS g FROM q),
h2 AS (SELECT query, n, g[len(g)] AS leaf, CASE WHEN len(g) > 1 THEN array_to_string(g[1:len(g) - 1], '::') END AS mh, CASE WHEN len(g) > 1 THEN g[1] END AS ch FROM h),
d AS (SELECT *, lower(name) AS ln, COALESCE(lower(owner_name), '') AS lo, COALESCE(lower(trait_name), '') AS lt, lower(module_path) AS lm, lower(crate_name) AS lc FROM m_symbols JOIN m_meta USING (symbol_id)),
mt AS (SELECT * FROM h2 JOIN d ON contains(ln, n) OR lo = n OR lt = n OR contains(lm, n) OR lc = n OR ((contains(ln, leaf) OR lo = leaf OR lt = leaf) AND (mh IS NULL OR contains(lm, mh) OR lc = ch OR starts_with(lm, ch))))"""


def typed_queries(t):
    a = t.meta.select(F.col("owner_name").alias("query"))
    b = t.meta.join(t.part, F.col("p_partkey") == F.col("symbol_id")).select(F.concat(F.col("module_path"), F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    return a.union(b).distinct()


@query("f03_tuple_rank", f"""WITH {MATCH},
k AS (SELECT mt.*, CASE WHEN mh IS NULL THEN 1 WHEN lm = mh OR ends_with(lm, '::' || mh) OR ln = n THEN 0 WHEN contains(lm, mh) OR contains(ln, mh) THEN 1 ELSE 2 END AS a, CASE WHEN lc = ch THEN 0 ELSE 1 END AS b,
  CASE WHEN EXISTS (SELECT 1 FROM m_imports i WHERE i.file = mt.file AND lower(i.local_name) IN (leaf, lt)) THEN 0 ELSE 2 END AS c, CASE WHEN mt.file IN (SELECT file FROM m_imports WHERE file = target_file) THEN 0 ELSE 2 END AS dd,
  CASE WHEN ln = n THEN 0 ELSE 1 END AS e, CASE WHEN lo = n OR lt = n THEN 0 WHEN contains(ln, n) THEN 1 ELSE 2 END AS f,
  CASE kind WHEN 'Struct' THEN 0 WHEN 'ImplBlock' THEN 1 WHEN 'Method' THEN 2 WHEN 'Function' THEN 3 ELSE 5 END AS gk, CASE type WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 2 END AS ht FROM mt),
u AS (SELECT *, row_number() OVER (PARTITION BY query, name, file, start_line ORDER BY a, b, c, dd, e, f, gk, ht, crate_name, file, start_line, symbol_id) AS r1 FROM k)
SELECT query, symbol_id, name, file, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a, b, c, dd, e, f, gk, ht, crate_name, file, start_line, symbol_id) AS r FROM u WHERE r1 = 1) WHERE r <= 10""")
def _(t):
    return se.ranked_symbols(typed_queries(t), t.symbols.join(t.meta, "symbol_id"), t.imports, 10).select("query", "symbol_id", "name", "file", "rank")


KEYS = "a, b, c, dd, e, f, gk, ht, crate_name, file, start_line, symbol_id"


def evidence(rows):
    """Rows with the columns they are ordered by, one of equal name, file and line."""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, name, file, start_line ORDER BY {KEYS}) AS r1 FROM (SELECT z.*,
  CASE WHEN mh IS NULL THEN 1 WHEN lm = mh OR ends_with(lm, '::' || mh) OR ln = n THEN 0 WHEN contains(lm, mh) OR contains(ln, mh) THEN 1 ELSE 2 END AS a, CASE WHEN lc = ch THEN 0 ELSE 1 END AS b,
  CASE WHEN EXISTS (SELECT 1 FROM m_imports i WHERE i.file = z.file AND lower(i.local_name) IN (leaf, lt)) THEN 0 ELSE 2 END AS c, CASE WHEN z.file IN (SELECT file FROM m_imports WHERE file = target_file) THEN 0 ELSE 2 END AS dd,
  CASE WHEN ln = n THEN 0 ELSE 1 END AS e, CASE WHEN lo = n OR lt = n THEN 0 WHEN contains(ln, n) THEN 1 ELSE 2 END AS f,
  CASE kind WHEN 'Struct' THEN 0 WHEN 'ImplBlock' THEN 1 WHEN 'Method' THEN 2 WHEN 'Function' THEN 3 ELSE 5 END AS gk, CASE type WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 2 END AS ht FROM ({rows}) z)) WHERE r1 = 1)"""


def shown(rows):
    """Ten best rows per query: those without support only where none has it."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ok DESC, {KEYS}) AS r, bool_or(ok) OVER (PARTITION BY query) AS found
  FROM (SELECT *, mh IS NULL OR a = 0 OR c = 0 OR dd = 0 AS ok FROM {evidence(rows)})) WHERE r <= 10 AND (ok OR NOT found)"""


# Two thirds of the typed symbols belong to a symbol of the table. Owners, traits, names and qualified names are asked for.
OWNED = """y AS (SELECT s.*, kind, trait_name, module_path, crate_name, CASE WHEN s.symbol_id % 3 = 0 OR o.name IS NULL THEN owner_name ELSE o.name END AS owner_name
  FROM m_symbols s JOIN m_meta USING (symbol_id) LEFT JOIN m_symbols o ON o.symbol_id = s.symbol_id - s.symbol_id % 4),
q AS (SELECT owner_name AS query FROM y UNION SELECT trait_name FROM y WHERE trait_name IS NOT NULL UNION SELECT upper(name) FROM y WHERE kind IN ('Struct', 'Function') UNION SELECT module_path || '::' || name FROM y WHERE kind = 'Struct')"""


@query("i15_type_context", f"""
WITH {OWNED}, h1 AS (SELECT query, lower(query) AS n, list_filter(string_split(lower(query), '::'), lambda x: x <> '') AS g FROM q),
h AS (SELECT query, n, g[len(g)] AS leaf, CASE WHEN len(g) > 1 THEN array_to_string(g[1:len(g) - 1], '::') END AS mh, CASE WHEN len(g) > 1 THEN g[1] END AS ch FROM h1),
d AS (SELECT *, lower(name) AS ln, COALESCE(lower(owner_name), '') AS lo, COALESCE(lower(trait_name), '') AS lt, lower(module_path) AS lm, lower(crate_name) AS lc FROM y),
de AS {evidence("SELECT * FROM h JOIN d ON ln = leaf WHERE kind IN ('Struct', 'Function') AND (mh IS NULL OR contains(lm, mh) AND (lc = ch OR starts_with(lm, ch)))")},
an AS (SELECT query, crate_name AS preferred_crate FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {KEYS}) AS r FROM de) WHERE r = 1),
hh AS (SELECT * FROM h LEFT JOIN an USING (query)), dx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {KEYS}) AS r FROM de JOIN an USING (query) WHERE crate_name = preferred_crate) WHERE r <= 10),
ib AS ({shown("SELECT * FROM hh JOIN d ON lo = leaf OR lt = leaf WHERE kind = 'ImplBlock' AND (preferred_crate IS NULL OR crate_name = preferred_crate)")}),
mp AS (SELECT query, symbol_id FROM hh JOIN d ON lo = leaf OR lt = leaf OR contains(ln, leaf) WHERE kind = 'Method' UNION SELECT ib.query, d.symbol_id FROM ib JOIN d ON d.lo = ib.lo WHERE d.kind = 'Method' AND d.lo <> ''),
me AS ({shown("SELECT * FROM hh JOIN mp USING (query) JOIN d USING (symbol_id) WHERE preferred_crate IS NULL OR crate_name = preferred_crate")}),
al AS (SELECT query, 'definition' AS "group", r, symbol_id, name, file, preferred_crate, module_path FROM dx UNION ALL SELECT query, 'impl_block', r, symbol_id, name, file, preferred_crate, module_path FROM ib
  UNION ALL SELECT query, 'method', r, symbol_id, name, file, preferred_crate, module_path FROM me)
SELECT query, "group", CAST(r AS INT) AS rank, symbol_id, name, file, preferred_crate, 'expanded_span' AS detail FROM al
UNION ALL SELECT query, 'module', CAST(row_number() OVER (PARTITION BY query ORDER BY module_path) AS INT), NULL, module_path, NULL, preferred_crate, 'expanded_span' FROM (SELECT DISTINCT query, module_path, preferred_crate FROM al)""")
def _(t):
    owner = t.symbols.select((F.col("symbol_id") + 0).alias("_o"), F.col("name").alias("_owner"))
    y = t.symbols.join(t.meta, "symbol_id").withColumn("_o", F.col("symbol_id") - F.col("symbol_id") % 4).join(owner, "_o", "left")
    y = y.withColumn("owner_name", F.when((F.col("symbol_id") % 3 == 0) | F.col("_owner").isNull(), F.col("owner_name")).otherwise(F.col("_owner"))).drop("_o", "_owner")
    y = se.cut_lineage(y)
    q = (y.select(F.col("owner_name").alias("query")).union(y.select("trait_name").filter("trait_name IS NOT NULL")).union(y.filter("kind IN ('Struct', 'Function')").select(F.upper("name")))
         .union(y.filter("kind = 'Struct'").select(F.concat_ws("::", "module_path", "name"))))
    return se.type_context(q, y, t.imports, 700).select("query", "group", "rank", "symbol_id", "name", "file", "preferred_crate", "detail")


@query("i16_repo_map", "SELECT module, file, name, type, start_line, end_line FROM m_modules LEFT JOIN m_symbols USING (file)")
def _(t):
    return sm.repo_map(t.modules, t.symbols)


@query("i17_file_brief", f"""WITH {TOP8.format(6)}, d AS (SELECT file, string_agg(callee_symbol, ',' ORDER BY r) AS key_dependencies FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY callee_symbol) AS r FROM (SELECT DISTINCT file, callee_symbol FROM m_calls)) WHERE r <= 8 GROUP BY 1)
SELECT file, {OBJ} AS objective, names AS top_symbols, COALESCE(key_dependencies, '') AS key_dependencies FROM t8 LEFT JOIN d USING (file)""")
def _(t):
    return sm.file_briefs(t.symbols, t.calls)


@query("i17_directory_brief", f"""WITH {TOP8.format(4)} SELECT dir, file, top_symbols FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY file) AS r FROM (
  SELECT regexp_replace(file, '/[^/]*$', '') AS dir, file, names AS top_symbols FROM t8)) WHERE r <= 20""")
def _(t):
    return sm.directory_briefs(t.symbols)


@query("i17_symbol_brief", f"""WITH {RES}, d AS (SELECT name, file, string_agg(callee_symbol, ',' ORDER BY r) AS touches FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY callee_symbol) AS r FROM
  (SELECT DISTINCT caller_symbol AS name, file, callee_symbol FROM m_calls)) WHERE r <= 6 GROUP BY 1, 2)
SELECT name, file, symbol_id, start_line, end_line, COALESCE(touches, '') AS touches FROM m_symbols LEFT JOIN d USING (name, file) WHERE symbol_id IN (SELECT aid FROM ba)""")
def _(t):
    return sm.symbol_briefs(t.symbols, t.calls)


PROJECT = """cc AS (SELECT callee_symbol AS name, count(*) AS calls FROM m_calls GROUP BY 1),
sc AS (SELECT s.*, COALESCE(calls, 0) AS calls FROM m_symbols s LEFT JOIN cc USING (name)),
rt AS (SELECT DISTINCT file FROM sc WHERE type <> 'import' AND calls = 0),
nm AS (SELECT file, list(name ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY calls DESC, name, symbol_id) AS r FROM sc) WHERE r <= 6 GROUP BY 1),
fl AS (SELECT module, file, CASE WHEN regexp_matches(module, 'test|spec') THEN 2 WHEN regexp_matches(module, 'api|server|app') THEN 0 ELSE 1 END AS priority FROM m_modules),
ob AS (SELECT fl.*, names, regexp_extract(file, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, CASE WHEN regexp_matches(lower(file), 'test|spec') THEN 'tests' WHEN regexp_matches(lower(file), 'route|handler|controller|api|server|endpoint') THEN 'api_surface'
  WHEN regexp_matches(lower(file), 'store|repo|db|model|migration|schema|seed') THEN 'data_layer' WHEN regexp_matches(lower(file), 'component|widget|view|\\.tsx$|\\.jsx$') THEN 'ui_layer' ELSE 'application_logic' END AS objective
  FROM fl LEFT JOIN nm USING (file)),
pj AS (SELECT module, file, priority, objective, CASE WHEN objective = 'tests' THEN 'test suite for ' || stem ELSE
  CASE objective WHEN 'api_surface' THEN 'API surface, entry: ' WHEN 'data_layer' THEN 'data layer, primary: ' WHEN 'ui_layer' THEN 'UI layer, primary: ' ELSE 'application logic, primary: ' END || names[1]
  || CASE WHEN len(list_filter(names, lambda x: x <> names[1])) > 0 THEN '; also ' || array_to_string(list_filter(names, lambda x: x <> names[1])[1:3], ', ') ELSE '' END END AS purpose,
  array_to_string(names, ',') AS top_symbols, regexp_matches(lower(file), 'main|/app\\.|index\\.|server\\.|entrypoint|entry\\.|app\\.tsx?$|app\\.js$') OR file IN (SELECT file FROM rt) AS is_entry_point FROM ob)"""


@query("i18_project_summary", f"WITH {PROJECT} SELECT * FROM pj")
def _(t):
    return sm.project_files(t.modules, t.symbols, t.calls)


@query("i18_project_summary_budget", f"WITH {PROJECT} SELECT * FROM pj ORDER BY priority, module, file LIMIT 58")
def _(t):
    return sm.project_files(t.modules, t.symbols, t.calls, 1000)


@query("i19_filtered_summary", f"""WITH {PROJECT}, {HOT}, rel AS (SELECT DISTINCT file FROM m_symbols WHERE name IN (SELECT name FROM hot))
SELECT * FROM pj WHERE module IN (SELECT module FROM pj WHERE file IN (SELECT file FROM rel))""")
def _(t):
    hot = sm.hot_callees(t.calls).select(F.col("callee_symbol").alias("name"))
    files = sm.project_files(t.modules, t.symbols, t.calls)
    return sm.filter_summary(files, t.symbols.join(hot, "name", "left_semi"))


ARCH = """en AS (SELECT DISTINCT module, name FROM m_symbols JOIN m_modules USING (file) WHERE type <> 'import' AND name NOT IN (SELECT raw_name FROM m_rawcalls)),
ep AS (SELECT module, string_agg(name, ',' ORDER BY name) AS entry_points FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY name) AS r FROM en) WHERE r <= 4 GROUP BY 1),
rm AS (SELECT module FROM (SELECT module, max(price) AS m FROM m_symbols JOIN m_modules USING (file) GROUP BY 1) ORDER BY m DESC, module LIMIT 3),
b AS (SELECT module, min(module_path) AS path, count(*) AS files, max(regexp_matches(lower(file), 'test|spec')) AS tested FROM m_modules GROUP BY 1),
fo AS (SELECT from_module AS module, count(*) AS fan_out FROM m_module_edges GROUP BY 1),
j AS (SELECT b.*, COALESCE(fan_out, 0) AS fan_out, COALESCE(entry_points, '') AS entry_points, lower(b.module || '/' || path) AS l, b.module IN (SELECT module FROM rm) AS active FROM b LEFT JOIN fo USING (module) LEFT JOIN ep USING (module)),
s AS (SELECT *, list_filter([CASE WHEN regexp_matches(l, 'auth|login|jwt|token|security') THEN 'security' END, CASE WHEN regexp_matches(l, 'billing|payment|invoice|stripe') THEN 'payments' END,
  CASE WHEN regexp_matches(l, 'infra|db|database|migration|deploy|config') THEN 'infrastructure' END, CASE WHEN active THEN 'high_activity' END, CASE WHEN fan_out >= 2 THEN 'high_fanout' END,
  CASE WHEN entry_points <> '' THEN 'entry_points' END, CASE WHEN files >= 2 AND NOT tested THEN 'weak_test_coverage' END], lambda x: x IS NOT NULL) AS g FROM j),
am AS (SELECT module, path, files, fan_out, entry_points, array_to_string(g, ',') AS signals, CASE WHEN list_has_any(g, ['security', 'payments', 'infrastructure', 'high_fanout', 'entry_points']) THEN 'high' WHEN len(g) = 0 THEN 'low' ELSE 'medium' END AS importance, len(g) AS n FROM s)"""


LEVELS = ["indexed", "unsupported_source", "unsupported_source_group"]


@query("i20_architecture_map", f"""WITH {ARCH}, lv AS (SELECT module, {LEVELS}[1 + length(module) % 4] AS support_level FROM b)
SELECT * EXCLUDE (n), CASE importance WHEN 'high' THEN 300 WHEN 'medium' THEN 200 ELSE 100 END
  + CASE support_level WHEN 'indexed' THEN 30 WHEN 'unsupported_source' THEN 20 WHEN 'unsupported_source_group' THEN 10 ELSE 0 END + n AS score
FROM (SELECT * EXCLUDE (support_level), COALESCE(support_level, 'filesystem_heuristic') AS support_level FROM am JOIN lv USING (module))""")
def _(t):
    recent = rk.recent_modules(t.symbols.join(t.modules, "file"), "module", F.col("price"))
    level = F.get(F.lit(LEVELS), F.length("module") % 4)
    support = t.modules.select("module").distinct().select("module", level.alias("support_level")).filter("support_level IS NOT NULL")
    return sm.architecture_map(t.modules, t.symbols, t.rawcalls.withColumnRenamed("raw_name", "callee_symbol"), t.module_edges, recent, support)


@query("i21_similar_errors", """
WITH p AS (SELECT CAST(k * 10 + length(event_type) AS BIGINT) * 1000 + ascii(event_type) AS pattern_id, event_type AS kind, event_type || '#' || CAST(k AS STRING) AS hash, hits FROM (
    SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, count(*) AS hits FROM events GROUP BY 1, 2)),
a AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'click' ELSE 'view' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'click' ELSE 'view' END || '#' || CAST(o_custkey % 200 AS STRING) AS hash FROM orders),
sl AS (SELECT p.pattern_id, CAST(e.user_id AS STRING) AS solution, CASE WHEN e.value > 40 THEN 'resolved' WHEN e.value > 15 THEN 'failed' ELSE 'partial' END AS outcome, CAST(floor(epoch_us(e.ts) / 1000) AS BIGINT) AS ts_ms
  FROM events e JOIN p ON p.hash = e.event_type || '#' || regexp_extract(props, '([0-9]+)', 1)),
m AS (SELECT request_id, pattern_id, hits, 'hash' AS matched_by FROM a JOIN p USING (hash)),
kf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY hits DESC, pattern_id) AS r FROM p) WHERE r <= 3),
u AS (SELECT * FROM m UNION ALL SELECT request_id, pattern_id, hits, 'kind' FROM a JOIN kf USING (kind) WHERE request_id NOT IN (SELECT request_id FROM m)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, pattern_id) AS INT) AS rank FROM u),
k AS (SELECT pattern_id, arg_max(solution, CASE WHEN outcome = 'resolved' THEN (ts_ms, solution) END) AS resolved_by, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed_attempts FROM sl GROUP BY 1)
SELECT request_id, pattern_id, hits, matched_by, rank, resolved_by, COALESCE(failed_attempts, 0) AS failed_attempts FROM f LEFT JOIN k USING (pattern_id) WHERE rank <= 3""")
def _(t):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    ev = t.events.withColumns({"k": k.cast("int"), "hash": F.concat_ws("#", "event_type", k)})
    p = ev.groupBy(F.col("event_type").alias("kind"), "k", "hash").agg(F.count("*").alias("hits"))
    p = p.withColumn("pattern_id", (F.col("k") * 10 + F.length("kind")).cast("bigint") * 1000 + F.ascii("kind"))
    kind = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "click").otherwise("view")
    a = t.orders.select(F.col("o_orderkey").alias("request_id"), kind.alias("kind"), F.concat(kind, F.lit("#"), (F.col("o_custkey") % 200).cast("string")).alias("hash"))
    sol = ev.join(p.select("hash", "pattern_id"), "hash").select(
        "pattern_id", F.col("user_id").cast("string").alias("solution"),
        F.when(F.col("value") > 40, "resolved").when(F.col("value") > 15, "failed").otherwise("partial").alias("outcome"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return cx.similar_errors(a, p, sol, 3)


VER = """v AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'implement' WHEN 1 THEN 'refactor' WHEN 2 THEN 'debug' ELSE 'understand' END AS intent,
  CASE WHEN o_custkey % 9 = 0 THEN 'fuzzy_symbol_search' ELSE 'get_planned_context' END AS selected_tool, o_custkey % 7 <> 0 AS has_target, o_custkey % 5 <> 0 AS has_top_file, o_orderkey % 11 <> 0 AS candidate_aligned,
  CAST(o_orderkey % 6 AS BIGINT) AS refs, (o_custkey % 100) / CAST(100 AS DOUBLE) AS confidence, o_orderstatus = 'P' AS escalated, o_orderkey % 13 = 0 AS raw_seed, o_orderkey % 17 = 0 AS low_confidence_raw,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 <> 1 END AS exact_target_in_top_context, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderkey % 10 <> 2 END AS exact_target_span_in_top_context,
  CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_orderkey % 10 <> 3 END AS exact_dependencies_in_reported_files, CASE WHEN o_custkey % 2 = 1 THEN NULL ELSE o_orderkey % 10 <> 4 END AS exact_impact_scope_alignment,
  CASE WHEN o_custkey % 5 = 1 THEN NULL ELSE o_orderkey % 10 <> 5 END AS exact_impact_scope_graph_alignment, CASE WHEN o_custkey % 5 = 2 THEN NULL ELSE o_orderkey % 10 <> 6 END AS exact_impact_scope_target_anchor,
  CASE WHEN o_custkey % 5 = 3 THEN NULL ELSE o_orderkey % 10 <> 7 END AS exact_impact_scope_graph_complete, CASE WHEN o_custkey % 5 = 4 THEN NULL ELSE o_orderkey % 10 <> 8 END AS workspace_boundary_alignment FROM {orders})"""
CHECKS = ["exact_target_in_top_context", "exact_target_span_in_top_context", "exact_dependencies_in_reported_files", "exact_impact_scope_alignment",
          "exact_impact_scope_graph_alignment", "exact_impact_scope_target_anchor", "exact_impact_scope_graph_complete", "workspace_boundary_alignment"]
BASIC = {"target_symbol_present": "has_target", "top_context_present": "has_top_file", "candidate_target_aligned": "candidate_aligned", "context_refs_present": "refs > 0"}


def _bad() -> str:
    parts = ["CASE WHEN NOT has_target AND NOT fb THEN 'missing_target_symbol' END", "CASE WHEN NOT has_top_file AND NOT fb AND refs > 0 THEN 'missing_top_context_file' END",
             "CASE WHEN NOT candidate_aligned THEN 'candidate_symbols_do_not_include_target' END"]
    parts += [f"CASE WHEN {c} = false THEN '{cx.ISSUES[c]}' END" for c in CHECKS]
    return ", ".join(parts + ["CASE WHEN refs = 0 AND NOT fb THEN 'no_context_refs' END"])


def _all(test: str) -> str:
    return " + ".join(f"CASE WHEN {test.format(v)} THEN 1 ELSE 0 END" for v in [*(f"({b})" for b in BASIC.values()), *CHECKS])


@query("i22_verification", f"""WITH {VER.replace('{orders}', 'orders')},
w AS (SELECT *, selected_tool = 'fuzzy_symbol_search' AS fb FROM v), x AS (SELECT *, list_filter([{_bad()}], lambda i: i IS NOT NULL) AS issues FROM w),
y AS (SELECT *, CASE WHEN fb THEN 'fallback_search' WHEN list_contains(issues, 'no_context_refs') THEN 'no_context_refs' WHEN len(issues) > 0 THEN 'needs_review' WHEN low_confidence_raw OR confidence < 0.5 THEN 'low_confidence'
  WHEN escalated OR raw_seed OR confidence < 0.75 THEN 'needs_review' ELSE 'high_confidence' END AS status, {_all('NOT {0}')} AS n_failed, {_all('{0}')} AS n_passed,
  CASE WHEN exact_target_in_top_context IS NULL THEN 1 ELSE 0 END + CASE WHEN exact_target_span_in_top_context IS NULL THEN 1 ELSE 0 END AS n_missing FROM x),
z AS (SELECT *, CASE WHEN intent NOT IN ('implement', 'refactor') THEN 'not_applicable' WHEN fb OR n_failed > 0 THEN 'blocked' WHEN n_missing > 0 THEN 'needs_retry' ELSE 'exact_ready' END AS bundle_status FROM y),
m AS (SELECT *, CASE WHEN intent NOT IN ('implement', 'refactor') THEN 'not_applicable' WHEN status = 'high_confidence' OR bundle_status = 'exact_ready' THEN 'ready' ELSE 'blocked' END AS mutation_state FROM z)
SELECT request_id, array_to_string(issues, ',') AS issues, status, n_failed AS failed, n_passed AS passed, n_missing AS missing, bundle_status, mutation_state,
  CASE WHEN mutation_state = 'blocked' THEN COALESCE(issues[1], status) END AS block_reason FROM m""")
def _(t):
    import re
    body = re.match(r"(?s)v AS \((.*)\)$", VER).group(1)
    rows = t.spark.sql(body, orders=t.orders)
    out = cx.verify(rows)
    return out.select("request_id", F.array_join("issues", ",").alias("issues"), "status", F.size("failed").alias("failed"), F.size("passed").alias("passed"),
                      F.size("missing").alias("missing"), "bundle_status", "mutation_state", "block_reason")


SCOPE = """i AS (SELECT o_orderkey AS request_id, s.file, s.name AS symbol, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN m_symbols s ON s.symbol_id = l_partkey),
ifl AS (SELECT DISTINCT request_id, CASE WHEN l_linenumber = 7 THEN file || '.missing' ELSE file END AS file FROM i),
ins AS (SELECT DISTINCT request_id, upper(symbol) AS symbol FROM i WHERE l_linenumber > 1),
sc AS (SELECT request_id, arg_min(symbol, (l_linenumber, symbol, file)) AS target_symbol, arg_min(file, (l_linenumber, symbol, file)) AS top_file, arg_max(symbol, (l_linenumber, symbol, file)) AS anchor_symbol,
  CASE WHEN count(*) % 2 = 0 THEN arg_max(file, (l_linenumber, symbol, file)) END AS anchor_file FROM i GROUP BY 1)"""


@query("i23_impact_alignment", f"""WITH {SCOPE},
h AS (SELECT DISTINCT f.request_id, f.file FROM ifl f JOIN m_symbols s ON s.file = f.file JOIN ins n ON n.request_id = f.request_id AND lower(n.symbol) = lower(s.name)),
r AS (SELECT f.request_id, f.file, s.file IS NULL AS unknown, h.file IS NULL AS nohit, f.request_id IN (SELECT request_id FROM ins) AS named FROM ifl f LEFT JOIN (SELECT DISTINCT file FROM m_symbols) s ON s.file = f.file LEFT JOIN h ON h.request_id = f.request_id AND h.file = f.file),
v AS (SELECT request_id, max(NOT unknown AND nohit AND named) AS bad, max(unknown) AS unk FROM r GROUP BY 1)
SELECT request_id, CASE WHEN bad THEN false WHEN unk THEN NULL ELSE true END AS aligned, CASE WHEN lower(anchor_symbol) <> lower(target_symbol) THEN false ELSE anchor_file IS NOT DISTINCT FROM top_file END AS anchored FROM sc JOIN v USING (request_id)""")
def _(t):
    i = cut_lineage(t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.symbols, F.col("symbol_id") == F.col("l_partkey"))
                    .select(F.col("o_orderkey").alias("request_id"), "file", F.col("name").alias("symbol"), "l_linenumber"))
    files = i.select("request_id", F.when(F.col("l_linenumber") == 7, F.concat("file", F.lit(".missing"))).otherwise(F.col("file")).alias("file"))
    key = F.struct("l_linenumber", "symbol", "file")
    ends = i.groupBy("request_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    scopes = ends.select("request_id", F.col("lo.symbol").alias("target_symbol"), F.col("lo.file").alias("top_file"), F.col("hi.symbol").alias("anchor_symbol"),
                         F.when(F.col("n") % 2 == 0, F.col("hi.file")).alias("anchor_file"))
    return cx.impact_scope_alignment(scopes, files, i.filter("l_linenumber > 1").select("request_id", F.upper("symbol").alias("symbol")), t.symbols)


@query("i24_provider_choice", """
WITH s AS (SELECT o_orderpriority AS task, 'provider_' || CAST(o_custkey % 9 AS STRING) AS provider, round(avg(CASE WHEN o_orderstatus <> 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS sr,
  round(avg(CAST(o_custkey AS DOUBLE)), 6) AS lat, round(avg(CAST(o_orderkey % 10 AS DOUBLE)), 6) AS c FROM orders GROUP BY 1, 2),
k AS (SELECT task, provider, round(sr * 0.6::DOUBLE + 0.2::DOUBLE / (1 + lat / 1000.0::DOUBLE) + 0.2::DOUBLE / (1 + c), 6) AS score FROM s)
SELECT task, provider, score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, provider) AS r FROM k) WHERE r = 1""")
def _(t):
    stats = t.orders.groupBy(F.col("o_orderpriority").alias("task"), F.concat(F.lit("provider_"), (F.col("o_custkey") % 9).cast("string")).alias("provider")).agg(
        F.round(F.avg(F.when(F.col("o_orderstatus") != "F", 1.0).otherwise(0.0)), 6).alias("success_rate"), F.lit(None).cast("double").alias("failure_rate"),
        F.round(F.avg(F.col("o_custkey").cast("double")), 6).alias("latency_ms"), F.round(F.avg((F.col("o_orderkey") % 10).cast("double")), 6).alias("token_cost"))
    return oc.provider_choice(stats)
