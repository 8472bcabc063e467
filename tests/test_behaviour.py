"""Literal cases of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import classify as cl, code, paths, text as tx
from graphloom.operators import callgraph as cg, events as ev, flow, graph as gr, health as hl, lookups as lk, maintenance as mt, outcomes as oc, scale as sc, search as se
from graphloom.sources import readers as rd
from graphloom.streaming import jobs, state


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("text,want", [("abcd", 2), ("abcdef", 2), ("abcdefghi", 3)])
def test_token_estimate(spark, text, want):
    assert one(spark, tx.estimate_tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("fix bug in retry", "debug"), ("refactor fetchData", "refactor"), ("how does fetchData work", "understand"), ("fetchData", "locate")])
def test_simple_intent(spark, text, want):
    assert one(spark, cl.simple_intent(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("explain why fetchData fails and add retry support", "debug"), ("refactor and optimize the worker", "refactor"),
                                       ("add retry support", "implement"), ("how does the queue work", "understand"), ("", "understand")])
def test_weighted_intent(spark, text, want):
    assert one(spark, cl.weighted_intent(F.col("t")), t=text) == want


def test_negation_clipping(spark):
    assert one(spark, tx.clip_negation(F.col("t")), t="fix worker runWorker init bug, not api handleRequest") == "fix worker runWorker init bug"


def test_assignment_uses_itself(spark):
    nodes = spark.createDataFrame([(1, 0, "Assignment", 1, 1, "xx = 1"), (1, 1, "Assignment", 2, 2, "xx = xx + yy"), (1, 2, "Return", 3, 3, "return xx")],
                                  "symbol_id int, pos int, node_type string, start_line int, end_line int, text string")
    assert rows(flow.data_flow(nodes)) == [(1, 1, 1, "AssignmentToUse", "xx"), (1, 1, 2, "AssignmentToReturn", "xx")]


def test_redaction_of_nested_metadata(spark):
    raw = json.dumps({"api_key": "s", "prompt_text": "p" * 200, "file_path": "a/b", "nested": {"Authorization": "x", "list": [{"path": "c"}, "y" * 130]}, "output": 5})
    run = lambda level: json.loads(spark.createDataFrame([(raw,)], "r string").select(tx.redact_json(level)("r").alias("x")).first()["x"])
    mid = run("balanced")
    assert set(mid) == {"prompt_text", "file_path", "nested"} and mid["prompt_text"] == "p" * 120 + "..." and mid["file_path"].startswith("path:")
    assert list(mid["nested"]) == ["list"] and mid["nested"]["list"][0]["path"].startswith("path:") and len(mid["nested"]["list"][1]) == 130
    strict, debug = run("strict"), run("debug")
    assert "prompt_text" not in strict and strict["nested"]["list"][1] == "y" * 32 + "..."
    assert debug["file_path"] == "a/b" and debug["output"] == 5 and "api_key" not in debug


SYMBOLS = "symbol_id int, name string, type string, file string, start_line int, end_line int"
CALLS = "caller_symbol string, callee_symbol string, file string, callee_file string"


def test_neighbourhood_reaches_callers_and_callees(spark):
    s = spark.createDataFrame([(1, "a", "function", "f", 1, 2), (2, "b", "function", "f", 3, 4), (3, "c", "function", "f", 5, 6)], SYMBOLS)
    c = spark.createDataFrame([("a", "b", "f", None), ("c", "b", "f", None)], CALLS)
    seeds = spark.createDataFrame([("b", 2)], "seed string, node int")
    assert rows(cg.neighbourhood(c, s, seeds, 2)) == [("b", 1, 1), ("b", 2, 0), ("b", 3, 1)]
    assert rows(cg.neighbourhood(c, s, seeds, 2, callers=False)) == [("b", 2, 0)]


def test_same_name_in_two_packages(spark):
    api, web = "packages/api/auth.py", "packages/web/auth.py"
    s = spark.createDataFrame([(1, "load_config", "function", api, 1, 2), (2, "load_config", "function", web, 1, 2),
                               (3, "init_auth", "function", api, 3, 4), (4, "init_auth", "function", web, 3, 4)], SYMBOLS)
    c = spark.createDataFrame([("init_auth", "load_config", api, api), ("init_auth", "load_config", web, web)], CALLS)
    assert rows(cg.callers_of(s.filter("name = 'load_config'"), c, s)) == [(1, 3), (2, 4)]
    changed = spark.createDataFrame([("LOAD_config", api)], "name string, file string")
    assert [(r["impacted_symbol"], r["impacted_file"]) for r in cg.impact_in_file(changed, c, s).collect()] == [("init_auth", api)]


def test_given_callee_file_is_binding(spark):
    s = spark.createDataFrame([(1, "x", "class", "f", 1, 2), (2, "x", "function", "g", 1, 2), (3, "x", "function", "g", 1, 2)], SYMBOLS)
    c = spark.createDataFrame([("m", "x", "f", None), ("m", "x", "h", None), ("m", "x", "f", "nowhere")], CALLS)
    assert sorted((r["file"], r["callee_id"] or 0) for r in cg.resolve_callees(c, s).collect()) == [("f", 0), ("f", 1), ("h", 3)]


def test_one_hop_impact_and_modules(spark):
    c = spark.createDataFrame([("fetchData", "retryRequest", "src/client.ts", None)], CALLS)
    assert rows(cg.impact(spark.createDataFrame([("retryRequest",)], "name string"), c)) == [("retryRequest", "fetchData", "src/client.ts", False)]
    s = spark.createDataFrame([(1, "fetch", "function", "src/api/client.ts", 1, 2), (2, "retry", "function", "src/utils/retry.ts", 1, 2)], SYMBOLS)
    assert rows(cg.module_graph(spark.createDataFrame([("fetch", "retry", "src/api/client.ts", None)], CALLS), s)) == [("api", "utils")]


def test_import_targets(spark):
    calls = spark.createDataFrame([("f", "m", "load"), ("f", "m", "cfg.read"), ("f", "m", "cfg?.peek"), ("f", "m", "other.go")], "file string, caller_symbol string, raw_name string")
    imports = spark.createDataFrame([("f", "load", "config.py", "load_config", 1), ("f", "cfg", "cfg.py", None, 2)],
                                    "file string, local_name string, target_file string, source_symbol string, position int")
    got = {r["raw_name"]: (r["callee_symbol"], r["callee_file"]) for r in cg.import_targets(calls, imports).collect()}
    assert got == {"load": ("load_config", "config.py"), "cfg.read": ("read", "cfg.py"), "cfg?.peek": ("peek", "cfg.py"), "other.go": ("other.go", None)}


def test_reexports_follow_aliases_barrels_and_defaults(spark):
    named = spark.createDataFrame([("index.ts", "run", "start", "a.ts", 1)], "file string, exported_name string, source_name string, target_file string, position int")
    star = spark.createDataFrame([("a.ts", "b.ts", 1)], "file string, target_file string, position int")
    defaults = spark.createDataFrame([("d.ts", "Widget", 1)], "file string, name string, position int")
    t = spark.createDataFrame([("run", "index.ts"), ("default", "d.ts"), ("other", "index.ts")], "callee_symbol string, callee_file string")
    got = {(r["callee_symbol"], r["callee_file"]): (r["final_symbol"], r["final_file"]) for r in cg.chase_reexports(t, named, star, defaults).collect()}
    assert got == {("run", "index.ts"): ("start", "b.ts"), ("default", "d.ts"): ("Widget", "d.ts"), ("other", "index.ts"): ("other", "index.ts")}


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(1, n) for n in ("type", "callers", "imports", "tests")] + [(2, "x"), (2, "y")], "plan int, node string")
    deps = spark.createDataFrame([(1, "callers", "type"), (1, "imports", "type"), (1, "tests", "callers"), (1, "tests", "imports"), (2, "x", "y"), (2, "y", "x")],
                                 "plan int, node string, dep string")
    got = {(r["plan"], r["node"]): r["level"] for r in gr.topological_levels(nodes, deps, "plan").collect()}
    assert got == {(1, "type"): 0, (1, "callers"): 1, (1, "imports"): 1, (1, "tests"): 2, (2, "x"): None, (2, "y"): None}


def test_reachability_stops_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert rows(gr.reachable(e, spark.createDataFrame([("a", "a")], "seed string, node string"))) == [("a", "b"), ("a", "c")]


def test_target_scorer(spark):
    c = spark.createDataFrame([(1, "todo app create task due date validation", s) for s in ("App", "createTask", "addTask")], "task_id int, text string, symbol string")
    assert se.best_target(c).first()["target"] == "createTask"


def test_provider_choice(spark):
    s = spark.createDataFrame([("planning", "a", 0.9, None, 900.0, 2.0), ("planning", "b", None, 0.5, 100.0, 1.0), ("planning", "c", None, None, None, None)],
                              "task string, provider string, success_rate double, failure_rate double, latency_ms double, token_cost double")
    assert oc.provider_choice(s).first()["provider"] == "c"


def test_patch_filter_and_stats(spark):
    p = spark.createDataFrame([(5, "r", "s", "m", "ModifyLogic", True, True, True, False)],
                              "ts_ms int, repository string, target_symbol string, model_used string, edit_type string, approved_by_user boolean, validation_passed boolean, tests_passed boolean, rollback_occurred boolean")
    assert oc.filter_patches(p, "r", "s", "m", 0, 10).count() == 1 and oc.filter_patches(p, until_ms=4).count() == 0
    assert {(r["scope"], r["success_rate"]) for r in oc.patch_statistics(p).collect()} == {("overall", 1.0), ("model", 1.0), ("edit_type", 1.0)}


def test_protected_prefix(spark):
    items = spark.createDataFrame([("core/retry.ts",), ("app/core.ts",)], "path string")
    assert rows(lk.protected(items, "path", spark.createDataFrame([("core/",)], "prefix string"), "prefix")) == [("core/retry.ts",)]


def test_plans_and_evolution(spark):
    code_issue = spark.createDataFrame([("a.ts", "f", "DeadCode")], "file_path string, symbol string, issue_type string")
    arch = spark.createDataFrame([("api", "TightCoupling")], "module string, issue_type string")
    plans = hl.improvement_plans(code_issue, arch)
    assert rows(plans.select("plan_id", "improvement_type")) == [("imp_arch_api", "ExtractInterface"), ("imp_code_a_ts_f_DeadCode", "RemoveDeadCode")]
    assert rows(hl.evolution_graph(plans, ["plan_id"]).select("node_id", "depends_on").fillna("")) == [("ev_0", ""), ("ev_1", "ev_0")]


def test_one_test_name_covers_everything(spark):
    s = spark.createDataFrame([(1, "alpha", "src/a.ts"), (2, "test_beta", "src/a.test.ts")], "symbol_id int, name string, file string")
    assert {r["gap_type"] for r in hl.test_gaps(s).collect()} == {"MissingEdgeCases", "MissingErrorTests"}


def test_exclusions_and_modules(spark):
    for path, want in (("node_modules/x.ts", True), ("a/Dist/x.ts", True), ("src/distance/x.ts", False), ("yarn.lock", True), ("src/types.d.ts", True), ("src/a.ts", False)):
        assert one(spark, paths.is_excluded(F.col("p")), p=path) is want
    assert tuple(one(spark, paths.module_of(F.col("p")), p="src/api/x.ts")) == ("api", "src/api")
    assert tuple(one(spark, paths.module_of(F.col("p")), p="x.ts")) == ("root", "root")
    assert one(spark, paths.normalise_path(F.col("p")), p="a/b/./../../../c//d") == "c/d"


def test_change_detection_and_counters(spark):
    snap = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, checksum string")
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, checksum string")
    assert rows(mt.classify_changes(snap, cur)) == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")]
    row = "hash int, kind string, message string, first_ms int, last_ms int, hits int"
    got = mt.upsert_counters(spark.createDataFrame([(1, "k", "first", 1, 2, 3)], row), spark.createDataFrame([(1, "k", "later", 5, 9, 1)], row))
    assert rows(got) == [(1, "k", "first", 1, 9, 4)]


def test_import_statements(spark):
    lines = ["import type { A as B, C } from './x'", "import D, { E } from \"y\";", "import * as ns from 'z'", "from pkg.mod import (f, g as h)", "import os, sys as system",
             "const { k: l, m } = require('./n');", "let o = require('p')", "nothing here"]
    got = rows(code.import_bindings(spark.createDataFrame([("f", x) for x in lines], "file string, statement string")).select(
        "specifier", "local_name", F.coalesce("source_symbol", F.lit("-"))))
    assert got == sorted([("./x", "B", "A"), ("./x", "C", "C"), ("y", "D", "default"), ("y", "E", "E"), ("z", "ns", "-"), ("pkg.mod", "f", "f"), ("pkg.mod", "h", "g"),
                          ("os,", "os", "-"), ("os,", "system", "-"), ("./n", "l", "k"), ("./n", "m", "m"), ("p", "o", "default")])


def test_markdown_sections(spark):
    text = "intro\n# One\n\n- item\nBody line\n## Two\n* a\n#\nlost\n# End"
    got = rows(code.markdown_sections(spark.createDataFrame([("d.md", text)], "path string, content string")).select("heading", "objective", "start_line", "end_line"))
    assert got == [("End", "Section reference.", 10, 10), ("One", "Body line", 2, 5), ("Two", "Section reference.", 6, 7)]


def test_tolerant_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts_ms": 2, "title": "b"}\n\nnot json\n{"ts_ms": 1, "title": "a"}\n')
    assert sorted(r["title"] for r in rd.read_knowledge(spark, str(tmp_path / "log.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "ab.csv").write_text("timestamp,provider,symbol,tokens_without,tokens_with,savings_pct\n1,p,s,10,x,2.5\n1,p\n")
    assert rows(rd.read_experiments(spark, str(tmp_path / "ab.csv"))) == [(1, "p", "s", 10, 0, 2.5)]


def test_source_tree(spark, tmp_path):
    for name in ("src/a.ts", "node_modules/b.ts", "src/c.txt", "src/deep/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("line\nnext\n")
    scan = rd.scan_tree(spark, str(tmp_path))
    assert rows(rd.indexable(scan)) == [("src/a.ts", "line\nnext\n"), ("src/deep/d.py", "line\nnext\n")]
    assert {(r["path"], r["excluded"]) for r in scan.filter("excluded IS NOT NULL").collect()} == {("node_modules/b.ts", "excluded"), ("src/c.txt", "unsupported")}
    assert rows(rd.restrict_to(rd.indexable(scan), spark.createDataFrame([("src/deep/",)], "target string")).select("path")) == [("src/deep/d.py",)]


def test_session_memory_and_raw_budget():
    memory = state.RefMemory(cap=2)
    assert [memory.accept(r, 0) for r in ("a", "b", "a", "c", "a")] == [True, True, False, True, True]
    assert memory.accept("a", 1)
    memory = state.RefMemory()
    assert all(memory.accept(str(i), 0) for i in range(state.MAX_REFS + 1))
    assert not memory.accept("1", 0) and memory.accept("0", 0)  # only the oldest was forgotten
    raw = state.RawBudget(budget=100)
    assert [raw.request(s, n) for s, n in (("x", 60), ("y", 50), ("x", 60), ("z", 40), ("w", 1))] == ["kept", "budget_exhausted", "already_in_context", "kept", "budget_exhausted"]
    assert raw.request("x", 60, 7) == "kept"  # a new revision starts over, budget included
    many = state.RawBudget(budget=10_000)
    assert [many.request(str(i), 1) for i in range(state.MAX_SPANS + 1)] == ["kept"] * (state.MAX_SPANS + 1)
    assert many.request("0", 1) == "kept" and many.request("2", 1) == "already_in_context"


def test_session_rows_are_ordered_across_chunks():
    import pandas as pd

    chunks = [pd.DataFrame({"pos": [9, 7], "ref": ["a", "b"]}), pd.DataFrame({"pos": [2, 8], "ref": ["a", "c"]})]
    assert [p for c in state.in_order(chunks) for p in c["pos"]] == [2, 7, 8, 9]


def test_weighted_intents(spark):
    cases = [("fix fetchData null error", "debug"), ("refactor fetchData for reuse", "refactor"), ("add retry handling to fetchData", "implement"),
             ("explain fetchData", "understand"), ("diagnose root cause for fetchData crash", "debug"), ("how does fetchData retry work", "understand"),
             ("explain why fetchData fails and add retry support", "debug"), ("diagnose and rewrite processJob auth failure", "debug"),
             ("why errors happen", "debug"), ("nothing known", "understand")]
    df = spark.createDataFrame(cases, "text string, want string")
    assert df.filter(cl.weighted_intent(F.col("text")) != F.col("want")).collect() == []


def test_reachability_and_levels_have_no_hop_limit(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    assert gr.reachable(chain, spark.createDataFrame([(0, 0)], "seed int, node int")).count() == 12


def test_similar_names_fill_up_with_unlike_ones(spark):
    symbols = spark.createDataFrame([(1, "abcd", "f", 1), (2, "zzzz", "f", 2), (3, "abce", "g", 3)], "symbol_id bigint, name string, file string, start_line int")
    got = rows(se.fuzzy_top_k(spark.createDataFrame([("abcd",)], "query string"), symbols, 3).select("rank", "name", "score"))
    assert got == [(1, "abcd", 1.0), (2, "abce", 0.75), (3, "zzzz", 0.0)]


def test_completion_alone_counts_nothing(spark):
    e = spark.createDataFrame([(None, None, 5), (None, 3, None), (None, 3, 4), (9, 1, 1)], "total_tokens_reported bigint, prompt_tokens_estimated bigint, completion_tokens_estimated bigint")
    assert [r[0] for r in e.select(ev.effective_tokens()).collect()] == [0, 3, 7, 9]


def test_ingest_statistics_tell_failures_apart(spark):
    runs = spark.createDataFrame([("a", "new", 5, 1, None, False), ("b", "changed", 7, 9, None, False), ("c", "new", 50, 10, "read", False), ("d", "new", 60, 11, "parse", False),
                                  ("e", "new", 70, 12, "parse", True), ("f", "unchanged", 1, 13, None, False), ("g", "deleted", 0, 14, None, False)],
                                 "path string, change string, ms int, at int, failure string, excluded boolean")
    r = mt.ingest_statistics(runs).first()
    assert (r.indexed, r.skipped, r.deleted, r.excluded, r.read_failed, r.parse_failed, r.last_ms, r.total_ms, r.max_ms, r.avg_ms) == (2, 1, 1, 1, 1, 1, 7, 12, 7, 6.0)
    assert [x.path for x in mt.failing_paths(runs).collect()] == ["c", "d"]


def test_type_context_groups_follow_the_definition(spark):
    typed = spark.createDataFrame([
        (1, "Store", "class", "b/src/store.rs", 1, "Struct", None, None, "core::store", "core"), (2, "Store", "class", "a/src/store.rs", 1, "Struct", None, None, "edge::store", "edge"),
        (3, "impl Store", "block", "b/src/store.rs", 9, "ImplBlock", "Store", None, "core::store", "core"), (4, "impl Store for Disk", "block", "b/src/disk.rs", 3, "impl_block", "Disk", "store", None, "core"),
        (5, "get", "function", "b/src/store.rs", 10, "Method", "Store", None, "core::store", "core"), (6, "flush", "function", "b/src/disk.rs", 4, "method", "Disk", None, None, "core"),
        (7, "restore", "function", "b/src/other.rs", 2, "Method", "Other", None, "core::other", "core"), (8, "put", "function", "a/src/store.rs", 2, "Method", "Store", None, "edge::store", "edge"),
        (9, "impl Lone", "block", "b/lib.rs", 1, "ImplBlock", "Lone", None, None, None), (10, "Store", "class", "b/src/store.rs", 1, "Struct", None, None, "core::store", "core"),
    ], "symbol_id int, name string, type string, file string, start_line int, kind string, owner_name string, trait_name string, module_path string, crate_name string")
    imports = spark.createDataFrame([("b/src/disk.rs", "Store", "b/src/store.rs")], "file string, local_name string, target_file string")

    def groups(query, max_tokens=900):
        asked = spark.createDataFrame([(query,), (query,), (None,)], "query string")
        found = {}
        for r in se.type_context(asked, typed, imports, max_tokens).orderBy("group", "rank").collect():
            found.setdefault(r["group"], []).append(r["name"] if r["group"] == "module" else r["symbol_id"])
        return found

    # Core comes before edge, a repeated row counts once, Disk's methods come through its block, restore by its name.
    plain = groups("Store")
    assert plain["definition"] == [1] and sorted(plain["impl_block"]) == [3, 4] and sorted(plain["method"]) == [5, 6, 7]
    assert plain["module"] == ["b::src::disk", "core::other", "core::store"]
    # Neither the path nor an import supports restore.
    assert sorted(groups("core::store::Store")["method"]) == [5, 6]
    assert groups("edge::store::Store") == {"definition": [2], "method": [8], "module": ["edge::store"]}
    # No definition: symbols of any crate, also without one.
    assert groups("lone") == {"impl_block": [9], "module": ["b"]}
    assert groups("nowhere") == {} and len(groups("Store", 200)["method"]) == 3
    assert se.type_context(spark.createDataFrame([], "query string"), typed, imports, 900).count() == 0


def test_one_letter_needles_are_dealt_over_many_keys(spark):
    names = spark.range(4000).select(F.concat(F.lit("a"), F.col("id")).alias("t"))
    pairs = sc.containing_pairs(spark.createDataFrame([("a",), ("a39",), ("",), (None,), ("zz",)], "n string"), "n", names, "t")
    assert {r.n: r["count"] for r in pairs.groupBy("n").count().collect()} == {"a": 4000, "a39": 111}
    assert sc.SHORT_SALTS >= 64
