"""The driver's tables seen as the code-graph model.

Each adapter is one SQL text used by Spark and by the checking engine alike; the few dialect
differences are fields of ``Dialect``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()


@dataclass(frozen=True)
class Dialect:
    millis: str
    regex: str
    group: str

    def sub(self, text: str, pattern: str, repl: str) -> str:
        """Replace every match; ``@1`` in ``repl`` is the first group."""
        return self.regex.format(text, pattern, repl.replace("@", self.group))


SPARK = Dialect(millis="unix_millis(CAST({0} AS TIMESTAMP))", regex="regexp_replace({0}, '{1}', '{2}')", group="$")
DUCK = Dialect(millis="CAST(floor(epoch_us({0}) / 1000) AS BIGINT)", regex="regexp_replace({0}, '{1}', '{2}', 'g')", group="\\")


def _telemetry(d: Dialect) -> str:
    ms = d.millis.format("ts")
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
    return f"""
    SELECT event_id, ts, {ms} AS ts_ms,
           concat(CAST(user_id AS STRING), '-', CAST(CAST(floor({ms} / 86400000) AS BIGINT) AS STRING)) AS task_id,
           user_id,
           CASE event_type WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_failed' ELSE 'tool_call' END AS event_type,
           CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'code_generation'
                WHEN 'error' THEN 'wasted_calls' WHEN 'signup' THEN 'planning' END AS category,
           concat('tool_', CAST({k} AS STRING)) AS tool_name,
           concat('provider_', CAST(user_id % 7 AS STRING)) AS provider,
           CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN event_type = 'error' THEN concat('E', CAST({k} % 10 AS STRING)) END AS error_code,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS total_tokens_reported,
           CAST(floor(value / 2) AS BIGINT) AS prompt_tokens_estimated,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value / 4) AS BIGINT) END AS completion_tokens_estimated,
           CAST(floor(value) AS BIGINT) AS latency_ms, event_type AS operation, props
    FROM events"""


def _symbols(d: Dialect) -> str:
    brand = "CAST(substr(p_brand, 7) AS INT)"
    return f"""
    SELECT p_partkey AS symbol_id, {brand} % 4 AS repo_id,
           concat(replace(p_name, ' ', '_'), '_', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS name,
           CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'import' END AS type,
           concat('src/', CASE {brand} % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'auth' WHEN 2 THEN 'billing'
                  WHEN 3 THEN 'domain' WHEN 4 THEN 'db' ELSE 'ui' END, '_', CAST({brand} AS STRING), '/',
                  CASE WHEN p_type = 'PROMO' THEN 'promo.test' ELSE lower(p_type) END, '_',
                  CAST(CAST(floor(p_partkey / 1000) AS BIGINT) AS STRING), '.ts') AS file,
           p_size * 10 AS start_line, CAST(p_size * 10 + p_partkey % 150 AS INT) AS end_line,
           'typescript' AS language, p_retailprice AS price
    FROM part"""


def _calls(d: Dialect) -> str:
    return """
    SELECT DISTINCT a.name AS caller_symbol, b.name AS callee_symbol, a.file AS file,
           CASE WHEN e.l_returnflag = 'N' THEN NULL ELSE b.file END AS callee_file
    FROM (SELECT l_partkey, l_returnflag,
                 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS next_part
          FROM lineitem) e
    JOIN m_symbols a ON e.l_partkey = a.symbol_id
    JOIN m_symbols b ON e.next_part = b.symbol_id"""


def _edges(d: Dialect) -> str:
    return """
    SELECT DISTINCT l_partkey AS src, next_part AS dst
    FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next_part
          FROM lineitem) e
    WHERE next_part IS NOT NULL AND next_part <> l_partkey"""


def _docs(d: Dialect) -> str:
    return """
    SELECT doc_id, source AS repo, lang, text AS content, n_chars,
           concat('src/', source, '/', lang, '/doc_', CAST(doc_id AS STRING),
                  CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.ts' ELSE '.rs' END) AS path
    FROM documents"""


def _nodes(d: Dialect) -> str:
    return """
    SELECT conv_id AS symbol_id, turn AS pos,
           CASE WHEN role = 'system' THEN 'Try'
                WHEN role = 'user' THEN CASE turn % 5 WHEN 0 THEN 'Loop' WHEN 1 THEN 'Call' WHEN 2 THEN 'Conditional'
                                        WHEN 3 THEN 'Assignment' ELSE 'Return' END
                ELSE CASE turn % 5 WHEN 0 THEN 'Call' WHEN 1 THEN 'Assignment' WHEN 2 THEN 'Catch'
                                        WHEN 3 THEN 'Conditional' ELSE 'Finally' END END AS node_type,
           CAST(turn * 3 AS INT) AS start_line, CAST(turn * 3 + length(text) % 12 AS INT) AS end_line,
           CASE WHEN instr(text, ',') > 0 THEN concat(substr(text, 1, instr(text, ',') - 1), '=', substr(text, instr(text, ',') + 1))
                ELSE text END AS text, role
    FROM conversations"""


def _items(d: Dialect) -> str:
    return """
    SELECT l_orderkey AS request_id, concat('file_', CAST(l_suppkey % 10 AS STRING)) AS file,
           CAST(l_linenumber * 5 + CAST(l_quantity AS INT) AS INT) AS start_line,
           CAST(l_linenumber * 5 + CAST(l_quantity AS INT) + l_partkey % 40 AS INT) AS end_line,
           CAST(l_linenumber % 4 AS INT) AS priority
    FROM lineitem"""


def _patches(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS patch_id, {d.millis.format('o_orderdate')} AS ts_ms,
           concat('repo_', CAST(o_custkey % 8 AS STRING)) AS repository,
           concat('symbol_', CAST(o_custkey % 500 AS STRING)) AS target_symbol,
           o_orderpriority AS model_used, o_orderstatus AS edit_type,
           o_orderkey % 3 <> 0 AS approved_by_user, o_orderkey % 5 <> 0 AS validation_passed,
           o_orderkey % 7 <> 0 AS tests_passed, o_orderkey % 11 = 0 AS rollback_occurred,
           CAST(floor(o_totalprice) AS BIGINT) AS cost
    FROM orders"""


def _cases(d: Dialect) -> str:
    return """
    SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS case_name,
           concat('fx', CAST(l_suppkey % 10 AS STRING)) AS fixture, l_returnflag AS bucket,
           CASE l_linenumber % 4 WHEN 0 THEN 'implement' WHEN 1 THEN 'refactor' WHEN 2 THEN 'debug' ELSE 'understand' END AS intent,
           CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'baseline' ELSE 'current' END AS run,
           l_quantity < 40 AS target_match, l_discount < 0.08 AS top_file_match, l_tax < 0.05 AS top_span_match,
           CAST(l_linenumber % 3 AS BIGINT) AS omission_count, CAST(l_partkey % 2 AS BIGINT) AS overfetch_count,
           l_quantity AS latency_ms, CAST(floor(l_extendedprice) AS BIGINT) AS approx_tokens
    FROM lineitem"""


def _route_cases(d: Dialect) -> str:
    flags = {"reviewable_or_better": "l_tax < 0.07", "high_confidence": "l_discount < 0.05", "intent_match": "l_quantity < 45",
             "selected_tool_match": "l_suppkey % 8 <> 0", "budget_match": "l_partkey % 6 <> 0", "reference_only_match": "l_partkey % 9 <> 1",
             "single_file_fast_path_match": "l_suppkey % 5 <> 2", "result_symbol_match": "l_discount < 0.09", "project_summary_match": "l_tax < 0.08",
             "retry_recovered": "l_orderkey % 11 = 0", "ready_without_retry": "l_orderkey % 11 <> 0 AND l_quantity < 30", "ready": "l_quantity < 30",
             "scope_aligned": "l_partkey % 4 <> 0", "scope_incomplete": "l_partkey % 4 = 0", "scope_missing_files": "l_partkey % 8 = 0",
             "scope_extra_files": "l_partkey % 8 = 4", "scope_missing_symbols": "l_partkey % 12 = 0", "scope_extra_symbols": "l_partkey % 12 = 4"}
    return f"""
    SELECT concat('suite_', l_returnflag) AS suite, concat('fx', CAST(l_suppkey % 10 AS STRING)) AS fixture,
           CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS run_id,
           CASE l_linenumber % 4 WHEN 0 THEN 'implement' WHEN 1 THEN 'refactor' WHEN 2 THEN 'debug' ELSE 'understand' END AS intent,
           CASE l_orderkey % 3 WHEN 0 THEN 'exact_ready' WHEN 1 THEN 'partial' ELSE 'none' END AS bundle_status,
           CASE l_orderkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'review' ELSE 'ready' END AS state,
           CAST(l_quantity AS DOUBLE) AS latency_ms, CAST(floor(l_extendedprice) AS BIGINT) AS approx_tokens,
           {', '.join(f'{v} AS {k}' for k, v in flags.items())}
    FROM lineitem"""


def _fixture_runs(d: Dialect) -> str:
    quiet = "month(o_orderdate) % 4 = 0"
    rates = {"incomplete": "o_custkey % 9 = 0", "missing_files": "o_orderkey % 7 = 0", "extra_files": "o_orderkey % 5 = 0",
             "missing_symbols": "o_custkey % 6 = 0", "extra_symbols": "o_custkey % 4 = 0"}
    share = "CAST(sum(CASE WHEN {0} AND NOT {1} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS {2}_rate"
    return f"""
    SELECT concat('suite_', substr(o_orderpriority, 1, 1)) AS suite, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS run_id,
           concat('fx', CAST(o_custkey % 10 AS STRING)) AS fixture,
           CAST(sum(CASE WHEN o_orderkey % 4 <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS mutation_case_count,
           {', '.join(share.format(v, quiet, k) for k, v in rates.items())}
    FROM orders GROUP BY 1, 2, 3"""


def _experiments(d: Dialect) -> str:
    flags = {"executed": "o_custkey % 7 <> 0", "validated": "o_orderstatus <> 'F'", "tests_passed": "o_orderstatus = 'O'", "target_match": "o_custkey % 3 <> 0",
             "heavy_first": "o_orderkey % 9 = 0", "escalated": "o_custkey % 10 = 1", "escalation_skipped": "o_custkey % 10 = 2", "trimmed": "o_orderkey % 6 = 1"}
    return f"""
    SELECT o_orderpriority AS suite, o_orderkey AS task, CAST(floor(o_totalprice / 10) AS BIGINT) AS tokens_without,
           CAST(floor(o_totalprice / 12) AS BIGINT) + o_custkey AS tokens_with, o_orderkey % 7 AS file_mentions, o_custkey % 5 AS impacted_files,
           o_orderkey % 4 AS hits_without, o_custkey % 4 AS hits_with, o_custkey % 4 AS terms_found, o_custkey % 4 + o_orderkey % 3 AS terms_expected,
           CAST(floor(o_totalprice / 5000) AS BIGINT) AS retrieval_ms, {', '.join(f'{v} AS {k}' for k, v in flags.items())}
    FROM orders"""


def _runs(d: Dialect) -> str:
    return f"""
    SELECT concat('suite_', substr(o_orderpriority, 1, 1)) AS suite,
           CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS run_id,
           count(*) AS case_count,
           CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / 20000 AS avg_latency_ms,
           max(o_totalprice) / 40000 AS p95_latency_ms,
           CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS missing_files_rate,
           CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS extra_files_rate,
           CAST(sum(CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS missing_symbols_rate,
           CAST(sum(CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS extra_symbols_rate
    FROM orders GROUP BY 1, 2"""


def _repo_name(key: str) -> str:
    return (f"concat(CASE {key} % 4 WHEN 0 THEN 'lib_' WHEN 1 THEN 'service_' WHEN 2 THEN 'client_' "
            f"ELSE 'repo_' END, CAST({key} AS STRING))")


def _repos(d: Dialect) -> str:
    return f"""
    SELECT s_suppkey AS repo_id, {_repo_name('s_suppkey')} AS name, concat('workspace/', lower(n_name)) AS path
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _repo_edges(d: Dialect) -> str:
    return f"""
    SELECT DISTINCT {_repo_name('l_suppkey')} AS from_repo, {_repo_name('next_supp')} AS to_repo
    FROM (SELECT l_orderkey, l_suppkey, l_returnflag,
                 lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS next_supp,
                 lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS next_flag
          FROM lineitem) e
    JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND next_flag = 'R' AND o_orderstatus = 'P' AND next_supp <> l_suppkey"""


def _modules(d: Dialect) -> str:
    return """
    SELECT DISTINCT file, split_part(file, '/', 2) AS module, concat('src/', split_part(file, '/', 2)) AS module_path
    FROM m_symbols"""


def _module_edges(d: Dialect) -> str:
    return """
    SELECT DISTINCT split_part(a.file, '/', 2) AS from_module, split_part(b.file, '/', 2) AS to_module
    FROM m_edges e JOIN m_symbols a ON e.src = a.symbol_id JOIN m_symbols b ON e.dst = b.symbol_id
    WHERE a.type = 'import' AND b.type = 'class' AND split_part(a.file, '/', 2) <> split_part(b.file, '/', 2)"""


# Sentence openings that become code line prefixes, so that prose yields lines of every kind.
CODE_PREFIXES = (("(Th[a-z]*)", "export function @2"), ("(In[a-z]*)", "class @2"), ("(De[a-z]*|Re[a-z]*)", "def @2"),
                 ("(Er[a-z]*|Is)", "import @2"), ("(Le[a-z]*|On[a-z]*)", "from @2"), ("(Ei[a-z]*|El[a-z]*)", "pub fn @2"))


def _code(d: Dialect) -> str:
    text = "text"
    for word, repl in CODE_PREFIXES:
        text = d.sub(text, r"(^|\n)" + word, "@1" + repl)
    return f"""
    SELECT doc_id, source AS repo, concat('src/', source, '/', lang, '/doc_', CAST(doc_id AS STRING), '.ts') AS path, {text} AS content
    FROM documents"""


def _notes(d: Dialect) -> str:
    """Documents as Markdown: lines that open with a short word become headings."""
    text = d.sub(d.sub("text", r"(^|\n)([A-Z][a-z]?[a-z]? )", "@1## @2"), r"(^|\n)(The[a-z]* )", "@1- @2")
    return f"""
    SELECT doc_id, concat('docs/', source, '/', CAST(doc_id AS STRING), '.md') AS path, {text} AS content
    FROM documents"""


def _contracts(d: Dialect) -> str:
    return """
    SELECT page_id, concat(split_part(split_part(url, '//', 2), '.', 1), '/v/', CAST(page_id AS STRING),
             CASE page_id % 3 WHEN 0 THEN '.yaml' WHEN 1 THEN '.proto' ELSE '.graphql' END) AS path,
           replace(CASE page_id % 3 WHEN 0 THEN replace(html, 'href="/', concat(chr(10), '/api/'))
             WHEN 1 THEN replace(html, '<li>', concat(chr(10), 'rpc ')) ELSE replace(html, '<p>', concat(chr(10), 'type Query ')) END,
             '<meta charset=', concat(chr(10), 'version: ')) AS content
    FROM pages"""


def _tasks(d: Dialect) -> str:
    """Task texts assembled from part attributes."""
    return """
    SELECT p_partkey AS task_id, concat(
             CASE p_type WHEN 'ECONOMY' THEN 'fix the ' WHEN 'LARGE' THEN 'refactor and optimize ' WHEN 'MEDIUM' THEN 'explain why '
               WHEN 'PROMO' THEN 'add support for ' WHEN 'SMALL' THEN 'how does ' ELSE 'change signature of ' END, p_name,
             CASE p_size % 5 WHEN 0 THEN ' fails, not ' WHEN 1 THEN ' and rewrite it' WHEN 2 THEN ' root cause' WHEN 3 THEN ' work but not ' ELSE '' END,
             CASE WHEN p_size % 5 IN (0, 3) THEN p_brand ELSE '' END) AS text,
           concat(replace(p_name, ' ', '_'), '_', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS symbol
    FROM part"""


def _meta(d: Dialect) -> str:
    brand = "CAST(substr(p_brand, 7) AS INT)"
    return f"""
    SELECT p_partkey AS symbol_id,
           CASE p_size % 4 WHEN 0 THEN 'ImplBlock' WHEN 1 THEN 'Method' WHEN 2 THEN 'Struct' ELSE 'Function' END AS kind,
           concat('Owner_', CAST({brand} AS STRING)) AS owner_name,
           CASE WHEN p_size % 3 = 0 THEN concat('Trait_', lower(p_type)) END AS trait_name,
           concat('crate::', lower(p_type), '::m', CAST({brand} AS STRING)) AS module_path,
           concat('crate_', CAST({brand} % 4 AS STRING)) AS crate_name
    FROM part"""


def _imports(d: Dialect) -> str:
    return """
    SELECT a.file AS file, b.name AS local_name, b.file AS target_file, CASE WHEN b.type = 'class' THEN NULL ELSE concat('orig_', b.name) END AS source_symbol,
           e.src * 100000000 + e.dst AS position
    FROM m_edges e JOIN m_symbols a ON e.src = a.symbol_id JOIN m_symbols b ON e.dst = b.symbol_id WHERE a.type = 'import'"""


def _rawcalls(d: Dialect) -> str:
    return """
    SELECT file, caller_symbol, CASE WHEN length(callee_symbol) % 2 = 0 THEN callee_symbol WHEN length(callee_symbol) % 3 = 0 THEN concat(callee_symbol, '?.fetch')
           ELSE concat(callee_symbol, '.load') END AS raw_name
    FROM m_calls"""


def _reexports(d: Dialect) -> str:
    """Statements of a file that pass on the first called symbol: named, everything, or the default."""
    return """
    SELECT a.file AS file, CASE WHEN a.type = 'import' THEN 'named' WHEN a.type = 'class' THEN 'star' ELSE 'default' END AS kind,
           a.name AS exported_name, b.name AS source_name, b.file AS target_file, a.symbol_id AS position
    FROM (SELECT src, min(dst) AS dst FROM m_edges GROUP BY src) e
    JOIN m_symbols a ON e.src = a.symbol_id JOIN m_symbols b ON e.dst = b.symbol_id
    WHERE a.type <> 'class' OR a.end_line - a.start_line > 100"""


MODELS = {
    "m_meta": _meta, "m_imports": _imports, "m_rawcalls": _rawcalls, "m_reexports": _reexports, "m_tasks": _tasks, "m_code": _code, "m_notes": _notes, "m_contracts": _contracts,
    "m_telemetry": _telemetry, "m_symbols": _symbols, "m_calls": _calls, "m_edges": _edges,
    "m_docs": _docs, "m_nodes": _nodes, "m_items": _items, "m_patches": _patches, "m_cases": _cases,
    "m_runs": _runs, "m_route_cases": _route_cases, "m_fixture_runs": _fixture_runs, "m_experiments": _experiments, "m_repo_edges": _repo_edges, "m_repos": _repos, "m_modules": _modules, "m_module_edges": _module_edges,
}


def referenced(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def with_models(sql: str) -> str:
    """Prepend the adapters a checking query uses as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in referenced(text, MODELS):
            if name not in order:
                body = MODELS[name](DUCK)
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS ({MODELS[n](DUCK)})" for n in order)
    text = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", text):
        return f"WITH RECURSIVE {ctes}, " + re.sub(r"(?i)^with\s+recursive\b", "", text)
    if re.match(r"(?i)with\b", text):
        return f"WITH {ctes}, " + re.sub(r"(?i)^with\b", "", text)
    return f"WITH {ctes} {text}"
