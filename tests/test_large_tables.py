"""Searches and call tables whose work must not grow faster than their input, against brute force."""

import random

from pyspark.sql import functions as F

from graphloom.functions.paths import import_candidates
from graphloom.operators import context, lookups
from graphloom.operators import scale, search as se
from graphloom.plans import tables


def typed_rows(spark, rng, rows):
    kinds, types = ("Struct", "ImplBlock", "Method", "Function"), ("class", "function", "import")
    data = []
    for i in range(rows):
        name = f"{rng.choice(('red_ring', 'Red_Ring', 'blue_nut', 'm1_ring', 'crate::a::m1::ring'))}{rng.choice(('', '_7', '_8'))}"
        data.append((i, name, f"f{rng.randrange(12)}", rng.randrange(6), rng.choice(types), rng.choice(kinds), rng.choice(("Own", "ring", "a::ring", None)),
                     rng.choice((None, "ring", "Trait_x")), rng.choice(("crate::a::m1", "crate::a::m2", "crate::b::m1", "crate::b")), rng.choice(("c0", "crate", None))))
    return spark.createDataFrame(data, "symbol_id int, name string, file string, start_line int, type string, kind string, owner_name string, trait_name string, module_path string, crate_name string")


def test_ranked_symbols_equal_brute_force_and_meet_few(spark):
    rng = random.Random(3)
    typed = typed_rows(spark, rng, 700)
    imports = spark.createDataFrame([("f1", "ring", "f2"), ("f2", "Trait_x", "f3"), ("f3", "z", "f3"), ("f4", "red_ring", "f9")], "file string, local_name string, target_file string")
    asked = [f"crate::{a}::{m}::{leaf}" for a in "ab" for m in ("m1", "m2") for leaf in ("ring", "red_ring", "nut")]
    asked += ["ring", "Own", "m1::ring", "a::ring", "::ring", "zz::ring", "crate::a::m1::ring", "c0::red_ring", "Trait_X"]
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    rows = se.with_evidence(se.matched_symbols(q, typed).join(typed, "symbol_id").withColumn("h", se.query_hints(F.col("query"))), imports)
    order = [F.col("key"), F.col("symbol_id")]
    want = scale.top_n(scale.top_n(rows, ["query", "name", "file", "start_line"], order, 1), ["query"], order, 5, "rank")
    cols = ["query", "symbol_id", "rank"]
    got = se.ranked_symbols(q, typed, imports, 5)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    many = typed_rows(spark, rng, 20_000).filter("name NOT LIKE '%::%' AND owner_name = 'Own'")
    far = spark.createDataFrame([(f"crate::x{i}::ring",) for i in range(40)], "query string").withColumn("h", se.query_hints(F.col("query")))
    assert se._leaf_candidates(far, many, imports, 5).count() <= 40 * 5 * 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_search_is_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(se, "PAIRS_PER_TASK", 500)
    monkeypatch.setattr(se, "LENGTH_BLOCK", 4)
    monkeypatch.setattr(se, "GRAM_NAMES", 2)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB_ 1\u00e9\U0001f600") for _ in range(n))
    names = [(f"small_ring_{i}" if i % 3 else word(rng.randrange(1, 12)), f"f{i % 4}", i % 5, i) for i in range(120)]
    asked = ["small ring economy", "xyz", "AB", "small_ring_7", "\u00e9\u00e9\U0001f600ab", "aabbaabbaabb"]
    got = se.fuzzy_top_k(spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame(names, "name string, file string, start_line int, symbol_id int"), 8)
    want = []
    for q in asked:
        def score(name):
            a, b = q.lower(), name.lower()
            return round(1 - edits(a, b) / max(len(a.encode()), len(b.encode())), 6)
        best = sorted(((-score(n[0]), *n) for n in names))[:8]
        want += [(q, i, rank) for rank, (*_, i) in enumerate(best, 1)]
    assert sorted((r.query, r.symbol_id, r["rank"]) for r in got.collect()) == sorted(want)


def test_rows_before_a_window_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(2_000)
    assert tables.dealt(rows, "id").rdd.getNumPartitions() == 20
    assert tables.dealt(rows.limit(0), "id").count() == 0


def test_a_path_is_normalised_once(spark):
    rows = spark.createDataFrame([("src/a/x.ts", "../b/./y"), ("src/a/x.py", "b.c"), ("a.rs", "./m.rs"), ("src/x.ts", "lib"), ("x.js", "..")], "i string, s string")
    tried = import_candidates(F.col("i"), F.col("s"))
    got = [r[0] for r in rows.select(tried).collect()]
    assert got[0][:2] == ["src/b/y.ts", "src/b/y.tsx"] and got[1] == ["src/a/b/c.py", "src/a/b/c/__init__.py", "src/a/b/c"]
    assert got[2:] == [["m.rs"], None, None]
    assert rows.select(tried.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_texts_of_a_target_are_normalised_once(spark):
    rows = [(1, "fix createTask fails", "createTask", "x"), (1, "fix createTask fails", "fix", "x"), (2, "nothing", "main", None), (3, None, "a", None), (4, "explain id", "id", "ID")]
    c = spark.createDataFrame(rows, "task_id int, text string, symbol string, pref string")
    # 90 + 10 as written, 220 + 11 as words, 120 + 2 * 3 for both words and 5 for each.
    assert sorted(map(tuple, se.best_target(c, "pref").collect())) == [(1, "createTask", 467), (4, "id", 2**30)]
    plan = c.select(se.target_score(F.col("text"), F.col("symbol"), F.col("pref")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 5


def test_imports_of_one_path_try_its_endings_once(spark):
    imports = spark.createDataFrame([(f"src/a/f{i % 40}.ts", "../b/./x") for i in range(80)] + [("src/c/g.ts", "./x"), ("src/c/h.py", ".x"), (None, "./x"), ("src/c/g.ts", "y")],
                                    "importer string, specifier string")
    files = spark.createDataFrame([("src/b/x.tsx",), ("src/b/x/index.ts",), ("src/c/x.js",)], "path string")
    found = lookups.resolve_specifiers(imports, files)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted([*((f"src/a/f{i}.ts", "../b/./x", "src/b/x.tsx") for i in range(40)), ("src/c/g.ts", "./x", "src/c/x.js")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate", 1)[1].split("LogicalRDD", 1)[0]  # distinct paths, not rows, are expanded


def test_scope_alignment_with_common_and_rare_names(spark, monkeypatch):
    rng = random.Random(4)
    places = ["packages/a/x.ts", "packages/b/y.ts", "src/z.ts", "src/w.ts", "lib/q.ts", None]
    symbols = [(rng.choice(places), rng.choice(["Main", "run", "stop", "go", None])) for _ in range(14)]
    files = [(rng.choice([*range(60), None]), rng.choice([*places, "gone.ts"])) for _ in range(110)]
    names = [(rng.choice([*range(60), None]), rng.choice(["main", "RUN", "other", "go", None])) for _ in range(60)]
    scopes = [(i % 65, rng.choice(["go", "Go", "run"]), rng.choice(places), rng.choice(["go", "run", None]), rng.choice(places)) for i in range(90)] + [(None, "go", None, "go", None)]
    low, inside = (lambda x: x and x.lower()), (lambda f: "/".join(f.split("/")[:2]) if f and f.startswith("packages/") else None)
    want = []
    for r, target, top, anchor, anchor_file in scopes:
        own, said = {f for q, f in files if q == r and r is not None}, {low(n) for q, n in names if q == r and r is not None}
        tops = {inside(s[2]) for s in scopes if s[0] == r} - {None}
        crossing = any(a != b for a in tops for b in {inside(f) for f in own} - {None})
        known = {f for f, _ in symbols} - {None}
        missed = any(f in known and said and not any(f == g and n is not None and low(n) in said for g, n in symbols) for f in own)
        aligned = True if not own else False if crossing or missed else None if own - known else True
        anchored = None if anchor is None else low(anchor) == low(target) and anchor_file == top
        want.append((r, aligned, anchored))
    tables_ = [spark.createDataFrame(rows, schema) for rows, schema in (
        (scopes, "request_id int, target_symbol string, top_file string, anchor_symbol string, anchor_file string"),
        (files, "request_id int, file string"), (names, "request_id int, symbol string"), (symbols, "file string, name string"))]
    for common in (1, 2, 64):
        monkeypatch.setattr(context, "COMMON", common)
        got = context.impact_scope_alignment(*tables_).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_summaries_and_lookup_tables_never_go_through_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, i % 7) for k in range(3) for i in range(20)], "k int, i int, v int")
    most = scale.prefix_max(rows, ["k"], "i", {"v": F.col("v")})
    symbols = spark.createDataFrame([(i, f"n{i}", f"f{i % 4}", i, i + 5, "function") for i in range(30)], "symbol_id long, name string, file string, start_line int, end_line int, type string")
    calls = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 30}", f"f{i % 4}", None) for i in range(30)], "caller_symbol string, callee_symbol string, file string, callee_file string")
    plans, kept = [most], context.cut_lineage

    def seen(df):
        plans.append(df)
        return kept(df)

    from graphloom.operators import callgraph
    old, callgraph.cut_lineage = callgraph.cut_lineage, seen
    try:
        assert all(link.count() for link in callgraph.call_links(calls, symbols))
    finally:
        callgraph.cut_lineage = old
    for df in plans:
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_edit_distances_of_a_block_and_the_nearest_of_it(spark, monkeypatch):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abAé_") for _ in range(n)) for n in (0, 1, 4, 4, 4, 7, 7, 7) for _ in range(12)})
    asked = ["", "a", "abba", "é_ab", "aaaaaaa", "zzz", "b_aébab_"]
    for length in (0, 4, 7):
        own = [n for n in names if len(n) == length]
        assert all(se.edit_distances(q, se._characters(own, length)).tolist() == [edits(q, n) for n in own] for q in asked)
    monkeypatch.setattr(se, "STEP", 16)
    assert se.edit_distances("abba", se._characters(names[-1:] * 9, len(names[-1]))).tolist() == [edits("abba", names[-1])] * 9
    monkeypatch.setattr(se, "LENGTH_BLOCK", 5)
    monkeypatch.setattr(se, "GRAM_NAMES", 1)
    rows = [(i, n, f"f{i % 3}", i % 5) for i, n in enumerate(names * 2)]
    symbols = spark.createDataFrame(rows, "symbol_id long, name string, file string, start_line int")
    got = se.fuzzy_top_k(spark.createDataFrame([(q,) for q in [*asked, None]], "query string"), symbols, 4).filter("query IS NOT NULL").collect()

    def score(q, n):
        longest = max(len(q.lower().encode()), len(n.lower().encode()))
        return round(1 - edits(q.lower(), n.lower()) / longest, 6) if longest else 1.0

    want = [(q, r, i) for q in asked for r, (*_, i) in enumerate(sorted((-score(q, n), n, f, s, i) for i, n, f, s in rows)[:4], 1)]
    assert sorted((r.query, r["rank"], r.symbol_id) for r in got) == sorted(want)
