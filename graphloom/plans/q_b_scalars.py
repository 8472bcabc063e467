"""Projection, classification and extraction queries."""

from pyspark.sql import functions as F

from .registry import query
from .q_e_windows import BLOCK, IDS, LABEL
from ..functions import classify as cl, code, paths, text as tx
from ..operators import lookups as lk, outcomes as oc

PATHS = "p AS (SELECT path FROM m_docs UNION ALL SELECT path FROM m_notes UNION ALL SELECT path FROM m_contracts UNION ALL SELECT file FROM m_symbols)"


def all_paths(t):
    cols = lambda df, c: df.select(F.col(c).alias("path"))
    return cols(t.docs, "path").unionByName(cols(t.notes, "path")).unionByName(cols(t.contracts, "path")).unionByName(cols(t.symbols, "file"))


@query("b01_language", f"""WITH {PATHS} SELECT path, CASE lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript'
  WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' END AS language FROM p""")
def _(t):
    return all_paths(t).select("path", paths.language(F.col("path")).alias("language"))


@query("b02_content_kind", f"""WITH {PATHS} SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(md|txt|rst|adoc)$') THEN 'document' ELSE 'code' END AS kind FROM p""")
def _(t):
    return all_paths(t).select("path", paths.content_kind(F.col("path")).alias("kind"))


@query("b03_module_of_file", f"""WITH {PATHS}, q AS (SELECT path, string_split(path, '/') AS s FROM p)
SELECT path, CASE WHEN len(s) >= 3 AND s[1] IN ('src', 'lib') THEN s[2] WHEN len(s) >= 2 THEN s[1] ELSE 'root' END AS module,
  CASE WHEN len(s) >= 3 AND s[1] IN ('src', 'lib') THEN s[1] || '/' || s[2] WHEN len(s) >= 2 THEN s[1] ELSE 'root' END AS module_path FROM q""")
def _(t):
    m = paths.module_of(F.col("path"))
    return all_paths(t).select("path", m["name"].alias("module"), m["path"].alias("module_path"))


ROOTED = """r AS (SELECT CASE lang WHEN 'en' THEN 'packages' WHEN 'fr' THEN 'apps' WHEN 'de' THEN 'app' ELSE 'tools' END || substr(path, 4) AS path FROM m_docs
  UNION ALL SELECT url FROM pages)"""


def rooted(t):
    root = F.when(F.col("lang") == "en", "packages").when(F.col("lang") == "fr", "apps").when(F.col("lang") == "de", "app").otherwise("tools")
    return t.docs.select(F.concat(root, F.substring("path", 4, 2**30)).alias("path")).unionByName(t.pages.select(F.col("url").alias("path")))


@query("b04_module_key", f"""WITH {ROOTED}, q AS (SELECT path, string_split(path, '/') AS s FROM r)
SELECT path, CASE WHEN len(s) >= 3 AND s[1] IN ('src', 'lib', 'app', 'packages', 'apps', 'services') THEN s[1] || '/' || s[2] ELSE s[1] END AS module_key FROM q""")
def _(t):
    return rooted(t).select("path", paths.module_key(F.col("path")).alias("module_key"))


@query("b05_workspace_boundary", f"""WITH {ROOTED}, q AS (SELECT path, string_split(path, '/') AS s FROM r)
SELECT path, CASE WHEN s[1] = 'packages' AND len(s) >= 2 THEN s[1] || '/' || s[2] END AS boundary FROM q""")
def _(t):
    return rooted(t).select("path", paths.workspace_boundary(F.col("path")).alias("boundary"))


@query("b06_token_estimates", """SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS budget_tokens, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS json_tokens,
  CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS event_tokens, greatest(CAST(floor(strlen(text) / 4.0) AS BIGINT), 1) AS summary_tokens FROM documents""")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", tx.estimate_tokens(c).alias("budget_tokens"), tx.estimate_tokens(c, "bytes").alias("json_tokens"),
                              tx.estimate_tokens(c, "bytes", 4).alias("event_tokens"), tx.estimate_tokens(c, "bytes", 4, floor=True, least=1).alias("summary_tokens"))


@query("b07_query_normaliser", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalise_query(F.col("text")).alias("norm"))


@query("b08_camel_normaliser", """SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[ .,]', '', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.normalise_camel(F.regexp_replace("text", "[ .,]", "")).alias("norm"))


@query("b09_negation_clipping", """SELECT task_id, CASE WHEN contains(text, ', not ') AND trim(split_part(text, ', not ', 1)) <> '' THEN trim(split_part(text, ', not ', 1))
  WHEN contains(text, ' but not ') AND trim(split_part(text, ' but not ', 1)) <> '' THEN trim(split_part(text, ' but not ', 1)) ELSE trim(text) END AS head FROM m_tasks""")
def _(t):
    return t.tasks.select("task_id", tx.clip_negation(F.col("text")).alias("head"))


@query("b10_identifiers", f"""SELECT identifier, count(*) AS docs FROM (SELECT unnest({IDS.format('text')}) AS identifier FROM documents) GROUP BY 1""")
def _(t):
    return t.documents.select(F.explode(tx.identifiers(F.col("text"))).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("docs"))


@query("b11_assignment_split", f"""SELECT symbol_id, pos, CAST(len({IDS.format("CASE WHEN instr(text, '=') > 0 THEN substr(text, 1, instr(text, '=') - 1) ELSE text END")}) AS INT) AS defs,
  CAST(len({IDS.format("CASE WHEN instr(text, '=') > 0 THEN substr(text, instr(text, '=') + 1) ELSE '' END")}) AS INT) AS uses FROM m_nodes""")
def _(t):
    lhs, rhs = tx.assignment_sides(F.col("text"))
    return t.nodes.select("symbol_id", "pos", F.size(lhs).alias("defs"), F.size(rhs).alias("uses"))


@query("b12_stack_symbols", r"""
WITH f AS (SELECT doc_id, unnest(string_split(text, '.')) AS frame FROM documents),
w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(regexp_replace(frame, '\(|\)|::', ' ', 'g'), '\s+')), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS w FROM f)
SELECT doc_id, count(DISTINCT w) AS symbols, min(w) AS first_symbol FROM w WHERE length(w) >= 3 AND NOT contains(w, '/') AND NOT contains(w, '\') AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY 1""")
def _(t):
    found = tx.stack_symbols(F.split("text", r"\."))
    return t.documents.select("doc_id", found.alias("s")).filter(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("bigint").alias("symbols"), F.get("s", F.lit(0)).alias("first_symbol"))


MESSAGE = "concat(event_type, ' at /srv/', CAST(user_id AS STRING), '  0x', CAST(event_id AS STRING), ' line ', CAST(event_id % 60 AS STRING), ':', CAST(user_id AS STRING), ' k=', props)"


@query("b13_error_normaliser", f"""
WITH w AS (SELECT event_id, unnest(regexp_split_to_array(trim({MESSAGE}), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(trim({MESSAGE}), '\\s+'), 1) AS i FROM events)
SELECT event_id, string_agg(CASE WHEN regexp_matches(w, '^(/|\\\\|0x)') OR regexp_matches(w, '^[0-9:]+$') THEN '<_>' ELSE w END, ' ' ORDER BY i) AS pattern FROM w GROUP BY 1""")
def _(t):
    return t.events.select("event_id", tx.normalise_error(F.expr(MESSAGE)).alias("pattern"))


@query("b14_redaction", """SELECT page_id, 'path:' || substr(sha256(url), 1, 16) AS page_path, CASE WHEN length(html) <= 120 THEN html ELSE substr(html, 1, 120) || '...' END AS content,
  'path:' || substr(sha256(url), 1, 16) AS file, CAST(page_id AS BIGINT) AS n, FALSE AS secret_left FROM pages""")
def _(t):
    raw = F.to_json(F.struct(F.col("url").alias("page_path"), F.lit("secret").alias("api_key"), F.substring("html", 1, 2**30).alias("content"),
                             F.struct(F.col("url").alias("file"), F.col("page_id").alias("n")).alias("nested")))
    done = t.pages.select("page_id", tx.redact_json("balanced")(raw).alias("redacted"))
    get = lambda path: F.get_json_object("redacted", path)
    return done.select("page_id", get("$.page_path").alias("page_path"), get("$.content").alias("content"), get("$.nested.file").alias("file"),
                       get("$.nested.n").cast("bigint").alias("n"), F.contains("redacted", F.lit("api_key")).alias("secret_left"))


@query("b15_content_hash", """SELECT copies, count(*) AS hashes FROM (SELECT count(*) AS copies FROM documents GROUP BY text) GROUP BY 1""")
def _(t):
    return (t.documents.groupBy(tx.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("copies"))
            .groupBy("copies").agg(F.count("*").alias("hashes")))


@query("b16_node_labels", f"SELECT symbol_id, pos, {LABEL} AS node_label FROM m_nodes")
def _(t):
    return cl.with_effective_label(t.nodes).select("symbol_id", "pos", "node_label")


@query("b17_cluster_labels", f"SELECT symbol_id, pos, {BLOCK} AS block FROM (SELECT *, {LABEL} AS node_label FROM m_nodes)")
def _(t):
    return cl.with_effective_label(t.nodes).select("symbol_id", "pos", "block")


@query("b18_file_objective", """SELECT symbol_id, CASE WHEN regexp_matches(lower(file), 'test|spec') THEN 'tests' WHEN regexp_matches(lower(file), 'api|server|route') THEN 'api_surface'
  WHEN regexp_matches(lower(file), 'store|repo|db') THEN 'data_layer' WHEN regexp_matches(lower(file), 'ui|component|view') THEN 'ui_layer'
  WHEN regexp_matches(lower(name), 'render|component') THEN 'ui_layer' ELSE 'application_logic' END AS objective,
  CASE WHEN regexp_matches(lower(file), 'test|spec') THEN 'tests' WHEN regexp_matches(lower(file), 'route|handler|controller|api|server|endpoint') THEN 'api_surface'
  WHEN regexp_matches(lower(file), 'store|repo|db|model|migration|schema|seed') THEN 'data_layer' WHEN regexp_matches(lower(file), 'component|widget|view|\\.tsx$|\\.jsx$') THEN 'ui_layer'
  WHEN regexp_matches(lower(name), 'render|component|view') THEN 'ui_layer' WHEN regexp_matches(lower(name), 'handler|route|endpoint') THEN 'api_surface'
  WHEN regexp_matches(lower(name), 'store|repo|query|insert|update|delete') THEN 'data_layer' ELSE 'application_logic' END AS rich FROM m_symbols""")
def _(t):
    names = F.array("name")
    return t.symbols.select("symbol_id", cl.file_objective(F.col("file"), names).alias("objective"), cl.file_objective_rich(F.col("file"), names).alias("rich"))


@query("b19_entry_paths", """SELECT path, regexp_matches(lower(path), 'main|/app\\.|index\\.|server\\.|entrypoint|entry\\.|app\\.tsx?$|app\\.js$') AS entry
FROM (SELECT url AS path FROM pages UNION ALL SELECT concat(repo, CASE lang WHEN 'en' THEN '/index.' WHEN 'fr' THEN '/myapp.' ELSE '/x.' END, 'ts') FROM m_docs)""")
def _(t):
    mid = F.when(F.col("lang") == "en", "/index.").when(F.col("lang") == "fr", "/myapp.").otherwise("/x.")
    p = t.pages.select(F.col("url").alias("path")).unionByName(t.docs.select(F.concat("repo", mid, F.lit("ts")).alias("path")))
    return p.select("path", cl.is_entry_path(F.col("path")).alias("entry"))


@query("b20_test_paths", """SELECT symbol_id, regexp_matches(lower(file), 'test|spec') AS test_like, regexp_matches(lower(file), 'test|_spec\\.rs$|\\.spec\\.ts$|\\.test\\.ts$') AS test_file FROM m_symbols""")
def _(t):
    return t.symbols.select("symbol_id", cl.is_test_path(F.col("file")).alias("test_like"), cl.is_test_path_strict(F.col("file")).alias("test_file"))


@query("b21_risk_signals", """SELECT symbol_id, concat_ws(',', CASE WHEN regexp_matches(lower(file), 'auth|login|jwt|token|security') THEN 'security' END,
  CASE WHEN regexp_matches(lower(file), 'billing|payment|invoice|stripe') THEN 'payments' END,
  CASE WHEN regexp_matches(lower(file), 'infra|db|database|migration|deploy|config') THEN 'infrastructure' END) AS signals FROM m_symbols""")
def _(t):
    return t.symbols.select("symbol_id", F.array_join(cl.risk_signals(F.col("file")), ",").alias("signals"))


@query("b22_edit_kind", """SELECT task_id, CASE WHEN contains(lower(text), 'rename') THEN 'RenameSymbol' WHEN regexp_matches(lower(text), 'signature|parameter') THEN 'ChangeSignature'
  WHEN contains(lower(text), 'refactor') THEN 'RefactorFunction' ELSE 'ModifyLogic' END AS edit_kind FROM m_tasks""")
def _(t):
    return t.tasks.select("task_id", cl.edit_kind(F.col("text")).alias("edit_kind"))


@query("b23_simple_intent", """SELECT task_id, CASE WHEN regexp_matches(lower(text), 'fix|bug|error') THEN 'debug' WHEN regexp_matches(lower(text), 'refactor|rewrite|optimize') THEN 'refactor'
  WHEN regexp_matches(lower(text), 'how does|explain') THEN 'understand' ELSE 'locate' END AS intent FROM m_tasks""")
def _(t):
    return t.tasks.select("task_id", cl.simple_intent(F.col("text")).alias("intent"))


def _weights() -> str:
    return ", ".join(f"('{i}', {w}, '{v}')" for i, ws in cl.INTENT_WEIGHTS.items() for w, words in ws.items() for v in words.split())


@query("b23_weighted_intent", f"""
WITH wt(intent, weight, word) AS (VALUES {_weights()}),
n AS (SELECT task_id, lower(text) AS low, regexp_matches(lower(text), 'fail|error|bug|crash|broken') AS failing FROM m_tasks),
k AS (SELECT task_id, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS word FROM n),
s AS (SELECT task_id, intent, sum(weight) AS score FROM k JOIN wt USING (word) GROUP BY 1, 2),
b AS (SELECT task_id, 'debug' AS intent, CASE WHEN regexp_matches(low, 'root cause|why is') THEN 3 ELSE 0 END
        + CASE WHEN contains(low, 'explain why') AND failing THEN 4 ELSE 0 END + CASE WHEN contains(low, 'why') AND failing THEN 2 ELSE 0 END
        + CASE WHEN regexp_matches(low, 'fix and explain|fix and refactor|debug and refactor|diagnose and rewrite|diagnose and refactor') THEN 2 ELSE 0 END AS score FROM n
      UNION ALL SELECT task_id, 'understand', CASE WHEN regexp_matches(low, 'how does|what does') THEN 3 ELSE 0 END FROM n
      UNION ALL SELECT task_id, 'refactor', CASE WHEN regexp_matches(low, 'refactor and optimize|rewrite for reuse') THEN 2 ELSE 0 END FROM n),
a AS (SELECT task_id, intent, sum(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT task_id, CASE WHEN score <= 0 THEN 'understand' ELSE intent END AS intent FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC,
  CASE intent WHEN 'debug' THEN 1 WHEN 'refactor' THEN 2 WHEN 'implement' THEN 3 ELSE 4 END) AS r FROM a) WHERE r = 1""")
def _(t):
    return t.tasks.select("task_id", cl.weighted_intent(F.col("text")).alias("intent"))


@query("b24_confidence_band", "SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.75 THEN 'high' WHEN p_size / 50.0 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM part")
def _(t):
    return t.part.select("p_partkey", cl.confidence_band(F.col("p_size") / 50.0).alias("band"))


@query("b25_patch_filter", """SELECT patch_id, repository, target_symbol, model_used, ts_ms FROM m_patches WHERE repository = 'repo_3' AND model_used = '2-HIGH'
  AND ts_ms >= 852076800000 AND ts_ms <= 946684800000""")
def _(t):
    out = oc.filter_patches(t.patches, repository="repo_3", model="2-HIGH", since_ms=852076800000, until_ms=946684800000)
    return out.select("patch_id", "repository", "target_symbol", "model_used", "ts_ms")


@query("b26_protected_paths", """SELECT s.symbol_id, s.file FROM m_symbols s WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT 'src/' || CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'auth_'
  WHEN 'MACHINERY' THEN 'billing_1' ELSE 'core/' END AS prefix FROM customer) p WHERE starts_with(s.file, p.prefix))""")
def _(t):
    seg = F.col("c_mktsegment")
    prefixes = t.customer.select(F.concat(F.lit("src/"), F.when(seg == "HOUSEHOLD", "auth_").when(seg == "MACHINERY", "billing_1").otherwise("core/")).alias("prefix"))
    return lk.protected(t.symbols.select("symbol_id", "file"), "file", prefixes, "prefix")


LINES = r"""ls AS (SELECT path, line, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (
  SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM m_code))"""


@query("b27_line_symbols", f"""WITH {LINES} SELECT path, regexp_extract(x, '^(export function|class|def|pub fn) +[^\\p{{L}}\\p{{N}}_$]*([\\p{{L}}\\p{{N}}_$]+)', 2) AS name,
  CASE WHEN starts_with(x, 'class ') THEN 'class' ELSE 'function' END AS type, CAST(line AS INT) AS line FROM ls WHERE regexp_matches(x, '^(export function|class|def|pub fn) ')""")
def _(t):
    return code.line_symbols(t.code)


@query("b28_import_bindings", """
WITH e AS (SELECT file, name, 'x_' || name AS alias, './' || type AS spec, symbol_id % 7 AS k FROM m_symbols)
SELECT file, spec AS specifier, alias AS local_name, name AS source_symbol FROM e WHERE k IN (0, 1) UNION ALL
SELECT file, spec, name, name FROM e WHERE k IN (2, 3, 1) UNION ALL SELECT file, spec, name, 'default' FROM e WHERE k IN (4, 6) UNION ALL
SELECT file, spec, alias, NULL FROM e WHERE k = 5""")
def _(t):
    k = F.col("symbol_id") % 7
    spec = F.concat(F.lit("./"), "type")
    text = (F.when(k == 0, F.format_string("import { %s as x_%s } from '%s'", "name", "name", spec))
            .when(k == 1, F.format_string("from %s import (%s, %s as x_%s)", spec, "name", "name", "name"))
            .when(k == 2, F.format_string("import { type %s } from \"%s\";", "name", spec))
            .when(k == 3, F.format_string("const { %s } = require('%s');", "name", spec))
            .when(k == 4, F.format_string("import %s from '%s'", "name", spec))
            .when(k == 5, F.format_string("import * as x_%s from '%s'", "name", spec))
            .otherwise(F.format_string("var %s = require('%s')", "name", spec)))
    return code.import_bindings(t.symbols.select("file", text.alias("statement")))


@query("b29_dependency_hints", f"""WITH {LINES}, h AS (SELECT path, line, CASE WHEN starts_with(x, 'import ') THEN trim(substr(x, 8)) WHEN starts_with(x, 'from ') THEN trim(substr(x, 6)) END AS hint FROM ls)
SELECT path, CAST(r - 1 AS INT) AS position, hint FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM h WHERE hint IS NOT NULL) WHERE r <= 8""")
def _(t):
    return code.dependency_hints(t.code)


SECTIONS = r"""nl AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line, len(string_split(content, chr(10))) AS n, content FROM m_notes),
nm AS (SELECT path, x, line, CASE WHEN content LIKE '%' || chr(10) OR content = '' THEN n - 1 ELSE n END AS n, CASE WHEN starts_with(regexp_replace(x, '^\s+', ''), '#') THEN 1 ELSE 0 END AS is_head FROM nl),
ns AS (SELECT *, sum(is_head) OVER (PARTITION BY path ORDER BY line) AS sec FROM nm WHERE line <= n),
sec AS (SELECT path, sec, arg_min(regexp_replace(regexp_replace(x, '^#+', ''), '^\s+|\s+$', '', 'g'), line) AS heading,
  COALESCE(arg_min(CASE WHEN is_head = 0 AND regexp_replace(x, '\s', '', 'g') <> '' AND NOT regexp_matches(x, '^\s*[-*]') THEN regexp_replace(x, '^\s+|\s+$', '', 'g') END,
    CASE WHEN is_head = 0 AND regexp_replace(x, '\s', '', 'g') <> '' AND NOT regexp_matches(x, '^\s*[-*]') THEN line END), 'Section reference.') AS objective,
  COALESCE(array_to_string(list_slice(list(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^-+', ''), '^\*+', ''), '^\s+|\s+$', '', 'g') ORDER BY line)
    FILTER (WHERE is_head = 0 AND regexp_replace(x, '\s', '', 'g') <> ''), 1, 4), '|'), '') AS key_references,
  CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line FROM ns WHERE sec > 0 GROUP BY 1, 2)"""


@query("b30_markdown_sections", f"WITH {SECTIONS} SELECT path, heading, objective, key_references, start_line, end_line FROM sec WHERE heading <> ''")
def _(t):
    return code.markdown_sections(t.notes).withColumn("key_references", F.array_join("key_references", "|"))


@query("b31_section_lookup", f"""WITH {SECTIONS} SELECT path, heading, start_line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY contains(lower(heading), 'es') DESC, start_line) AS r
  FROM sec WHERE heading <> '') WHERE r = 1""")
def _(t):
    return lk.section_for(code.markdown_sections(t.notes), F.lit("es")).select("path", "heading", "start_line")


@query("b32_code_span", r"""SELECT doc_id, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS span FROM m_docs""")
def _(t):
    return t.docs.select("doc_id", code.code_span(F.col("content"), F.lit(2), F.lit(4)).alias("span"))


@query("b33_nesting_depth", """
WITH c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, regexp_replace(replace(text, ',', ':'), '[^{:}\\n]', '', 'g') AS t FROM documents) WHERE t <> ''),
p AS (SELECT doc_id, i, sum(CASE WHEN ch IN ('{', ':') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM c),
d AS (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS d FROM p)
SELECT doc_id, CAST(COALESCE(max(d), 0) AS INT) AS depth FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1""")
def _(t):
    return t.documents.select("doc_id", tx.nesting_depth(F.replace("text", F.lit(","), F.lit(":"))).alias("depth"))


@query("b34_api_contracts", r"""
WITH l AS (SELECT path, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, i FROM (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM m_contracts)),
v AS (SELECT path, arg_min(v, i) AS version FROM (SELECT path, i, regexp_replace(CASE WHEN contains(x, ':') THEN split_part(x, ':', 2) ELSE 'v1' END, '^\s+|\s+$', '', 'g') AS v FROM l WHERE contains(lower(x), 'version')) WHERE v <> '' GROUP BY 1),
e AS (SELECT path, CASE WHEN path LIKE '%.proto' THEN 'RPC' WHEN path LIKE '%.graphql' THEN 'GRAPHQL' ELSE 'HTTP' END AS method,
  CASE WHEN path LIKE '%.proto' THEN regexp_split_to_array(x, '\s+')[2] WHEN path LIKE '%.graphql' THEN x ELSE regexp_replace(x, ':+$', '') END AS endpoint FROM l
  WHERE (path LIKE '%.proto' AND starts_with(x, 'rpc ')) OR (path LIKE '%.graphql' AND regexp_matches(x, '^type (Query|Mutation)')) OR (path LIKE '%.yaml' AND starts_with(x, '/api/')))
SELECT path, split_part(path, '/', 1) AS service, COALESCE(version, 'v1') AS version, method, endpoint FROM e LEFT JOIN v USING (path)""")
def _(t):
    return code.api_contracts(t.contracts)


@query("b35_specifier_resolution", """
SELECT DISTINCT a.file AS importer, '../' || split_part(b.file, '/', 2) || '/./' || regexp_replace(split_part(b.file, '/', 3), '\\.ts$', '') AS specifier, b.file AS resolved
FROM m_edges e JOIN m_symbols a ON e.src = a.symbol_id JOIN m_symbols b ON e.dst = b.symbol_id""")
def _(t):
    a, b = t.symbols.select(F.col("symbol_id").alias("src"), F.col("file").alias("importer")), t.symbols.select(F.col("symbol_id").alias("dst"), F.col("file").alias("target"))
    parts = F.split("target", "/")
    spec = F.concat(F.lit("../"), parts[1], F.lit("/./"), F.regexp_replace(parts[2], r"\.ts$", ""))
    wanted = t.edges.join(a, "src").join(b, "dst").select("importer", spec.alias("specifier"))
    return lk.resolve_specifiers(wanted, t.symbols.select(F.col("file").alias("path")).distinct())


@query("b36_symbol_lookup", "SELECT symbol_id, name, file, start_line, end_line FROM m_symbols WHERE type = 'function' AND name IN (SELECT callee_symbol FROM m_calls)")
def _(t):
    keys = t.calls.select(F.col("callee_symbol").alias("name")).withColumn("type", F.lit("function"))
    return lk.exact(t.symbols, keys, ["name", "type"]).select("symbol_id", "name", "file", "start_line", "end_line")


@query("b36_file_outline", """SELECT file, name, type, start_line, end_line FROM m_symbols WHERE file IN (SELECT callee_file FROM m_calls)""")
def _(t):
    return lk.outline(t.symbols, t.calls.select(F.col("callee_file").alias("file"))).select("file", "name", "type", "start_line", "end_line")


@query("b36_caller_edges", """SELECT caller_symbol, callee_symbol, file FROM m_calls WHERE caller_symbol IN (SELECT name FROM m_symbols WHERE type = 'class')""")
def _(t):
    keys = t.symbols.filter("type = 'class'").select(F.col("name").alias("caller_symbol"))
    return lk.exact(t.calls, keys, ["caller_symbol"]).select("caller_symbol", "callee_symbol", "file")


@query("b36_flow_slice", """SELECT symbol_id, node_type, count(*) AS nodes, min(start_line) AS first_line FROM m_nodes WHERE symbol_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1, 2""")
def _(t):
    keys = t.conversations.filter("role = 'system'").select(F.col("conv_id").alias("symbol_id"))
    return lk.exact(t.nodes, keys, ["symbol_id"]).groupBy("symbol_id", "node_type").agg(F.count("*").alias("nodes"), F.min("start_line").alias("first_line"))
