"""Calls are resolved once for a search, only where needed for root causes, and replayed in batches of bounded size."""

import random

from graphloom.operators import callgraph as cg, context as cx
from graphloom.plans import q_s_streaming as qs


def tables(spark, rng):
    names, files = [f"n{i}" for i in range(8)], [f"src/m{i}/f.ts" for i in range(3)]
    symbols = [(i // 2 if i < 6 else i, rng.choice([*names, None]), rng.choice([*files, None]), rng.choice(["function", "class", "import"]), i, i + 5) for i in range(40)]
    calls = [(rng.choice([*names, "gone", None]), rng.choice([*files, None]), rng.choice([*names, None]), rng.choice([*files, "other", None])) for _ in range(60)]
    return (spark.createDataFrame(symbols, "symbol_id long, name string, file string, type string, start_line int, end_line int"),
            spark.createDataFrame(calls, "caller_symbol string, file string, callee_symbol string, callee_file string"))


def one_hop(symbols, calls, callees, callers):
    """Neighbours of every symbol, pair by pair."""
    found = set()
    out = cg.resolve_callees(calls, symbols).collect() if callees else []
    into = cg.resolve_callers(calls, symbols).collect() if callers else []
    for s in symbols.collect():
        found |= {(s.symbol_id, c.callee_id) for c in out if None not in (s.name, s.file, c.callee_id) and (c.caller_symbol, c.file) == (s.name, s.file)}
        found |= {(s.symbol_id, c.caller_id) for c in into if None not in (s.name, c.caller_id) and c.callee_symbol == s.name and c.callee_file in (None, s.file)}
    return found


def test_links_are_numbers_and_equal_resolved_calls(spark):
    symbols, calls = tables(spark, random.Random(6))
    for callees, callers in ((True, True), (True, False), (False, True)):
        keys, links = cg.call_links(calls, symbols, callees, callers)
        assert {t for df in (keys, links) for _, t in df.dtypes} == {"bigint"}
        got = keys.toDF("symbol", "key").join(links.toDF("key", "node"), "key").select("symbol", "node")
        assert {tuple(r) for r in got.collect()} == one_hop(symbols, calls, callees, callers)


def counted(monkeypatch, spark, seen):
    whole = cg.resolve_callees
    monkeypatch.setattr(cg, "resolve_callees", lambda calls, symbols: seen.append(calls.count()) or whole(calls, symbols))


def test_planned_context_resolves_calls_once(spark, monkeypatch):
    symbols, calls = tables(spark, random.Random(7))
    seen = []
    counted(monkeypatch, spark, seen)
    requests = symbols.selectExpr("symbol_id AS request_id", "symbol_id", "2 AS radius").distinct()
    nodes = spark.createDataFrame([], "symbol_id long, start_line int, end_line int")
    items = cx.context_candidates(requests, symbols, calls, nodes, 2)
    assert not seen
    assert {(r.request_id, r.file, r.start_line) for r in items.filter("priority = 2").collect()} == {
        (a, s.file, s.start_line) for a, b in one_hop(symbols, calls, True, False) for s in symbols.collect() if s.symbol_id == b}


def test_root_causes_resolve_only_calls_near_the_graphs(spark, monkeypatch):
    symbols = spark.createDataFrame([(i, f"s{i}", "src/a/f.ts", "function", i, i + 1) for i in range(40)], "symbol_id long, name string, file string, type string, start_line int, end_line int")
    calls = spark.createDataFrame([(f"s{i}", "src/a/f.ts", f"s{i + 1}", None) for i in range(39)], "caller_symbol string, file string, callee_symbol string, callee_file string")
    frames = spark.createDataFrame([(1, "s5")], "event_id long, symbol string")
    events = spark.createDataFrame([(1, 100)], "event_id long, ts_s long")
    graph = cg.debug_graph(frames, calls, symbols)
    seen = []
    counted(monkeypatch, spark, seen)
    patches = spark.createDataFrame([], "symbol string, ts_s long")
    got = cg.rank_root_causes(graph, frames, events, patches, calls, symbols).collect()
    assert {r.symbol for r in got} == {f"s{i}" for i in range(3, 8)} and max(seen) <= 5
    best = {r.symbol: r.probability for r in got}
    assert best["s5"] == 1.0 and best["s4"] > best["s6"] == best["s3"]


def test_replays_write_files_by_rows(spark, monkeypatch):
    files, write = [], qs.write_in_order
    monkeypatch.setattr(qs, "BATCH_ROWS", 10)
    monkeypatch.setattr(qs, "write_in_order", lambda rows, path, order, n: files.append(n) or write(rows, path, order, n))
    rows = spark.createDataFrame([(i % 3, i, (i + 1) * 1000, str(i % 4), 0) for i in range(75)], qs.SESSION_REFS)
    found = qs.reused(type("Tables", (), {"spark": spark})(), rows, rows.count())
    assert files == [8] and found.count() == 75
