"""Bucketed building blocks against plain definitions."""

import math
import random

import pytest
from pyspark.sql import Window as W, functions as F

from graphloom.operators import intervals as iv, maintenance as mt, scale, search as se


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ordered_scan_equals_window(spark):
    random.seed(3)
    data = [(k, random.randrange(60), i, random.choice([None, i % 7]), random.randrange(2)) for i, k in enumerate(["hot"] * 80 + ["a"] * 9 + ["b"])]
    df = spark.createDataFrame(data, "k string, pos int, id int, v int, flag int")
    got = scale.ordered_scan(df, ["k"], ["pos", "id"], F.floor(F.col("pos") / 4), lag={"lg": "v"}, lead={"ld": "id"},
                             running_sum={"rs": "flag"}, last_before={"lb": "v"}, last_upto={"lu": "v"})
    w = W.partitionBy("k").orderBy("pos", "id")
    want = df.select("*", F.lag("v").over(w).alias("lg"), F.lead("id").over(w).alias("ld"),
                     F.sum("flag").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rs"),
                     F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("lb"),
                     F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("lu"))
    cols = ["k", "pos", "id", "lg", "ld", "rs", "lb", "lu"]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(map(tuple, want.select(*cols).collect()), key=key)


def test_prefix_max_over_buckets(spark):
    random.seed(5)
    data = [("hot", random.randrange(50), random.randrange(100)) for _ in range(200)]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    got = rows(scale.prefix_max(df, ["k"], "pos", {"m": F.col("v")}, width=3, own="own_"))
    for k, pos, own, m in got:
        earlier = [v for _, p, v in data if p < pos]
        assert m == (max(earlier) if earlier else None) and own == max(v for _, p, v in data if p == pos)
    assert len(got) == len({p for _, p, _ in data})


def test_value_at_fraction_is_the_exact_element(spark):
    random.seed(7)
    data = [("hot", round(random.expovariate(0.2), 2)) for _ in range(501)] + [("one", 4.0)] + [("same", 2.5)] * 40
    got = {r["k"]: r for r in scale.value_at_fraction(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for k in ("hot", "one", "same"):
        vals = sorted(v for kk, v in data if kk == k)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[k][name] == vals[min(math.floor(len(vals) * p), len(vals) - 1)]


@pytest.mark.parametrize("values", [[i / 997 for i in range(997)], [-5.5, -0.25, -0.25, 0.0, 1e-9, 3.0, 1e18], [1.7e9 + i for i in range(300)], [0.0] * 5,
                                    [float("-inf"), -1e300, 5e-324, float("inf"), float("inf")]])
def test_value_at_fraction_of_any_numbers(spark, values):
    mixed = random.Random(3).sample(values, len(values))
    got = scale.value_at_fraction(spark.createDataFrame([("k", v) for v in mixed] + [("k", None)], "k string, v double"), ["k"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).first()
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
        assert got[name] == sorted(values)[min(math.floor(len(values) * p), len(values) - 1)]


def test_rates_spread_over_many_bins(spark):
    rates = spark.range(1, 1001).select(scale.quantile_bin(F.col("id") / 1000).alias("b"), "id")
    assert rates.select("b").distinct().count() > 500
    assert rates.orderBy("id").agg(F.collect_list("b").alias("l")).first().l == [r.b for r in rates.orderBy("b", "id").collect()]
    last = spark.sql("SELECT double('NaN') AS v UNION ALL SELECT double('Infinity')").select(scale.quantile_bin(F.col("v")).alias("b"), "v").orderBy(F.desc("b")).first()
    assert math.isnan(last.v)


def test_positions_follow_the_order(spark):
    rng = random.Random(5)
    data = [(rng.choice("abcd") * rng.randrange(4), rng.randrange(50)) for _ in range(700)] + [("same", 1)] * 300
    df = spark.createDataFrame(data, "a string, b int").repartition(7)
    got = sorted((r.position, r.a, r.b) for r in scale.positions(df, ["a", "b"]).collect())
    assert [p for p, _, _ in got] == list(range(1000)) and [(a, b) for _, a, b in got] == sorted(data)
    assert scale.positions(df.limit(0), ["a", "b"]).count() == 0


def test_containing_pairs_equals_nested_loop(spark):
    random.seed(11)
    words = ["".join(random.choice("abc") for _ in range(random.randrange(1, 9))) for _ in range(60)]
    needles = spark.createDataFrame([(w,) for w in words[:25]], "n string")
    hay = spark.createDataFrame([(w,) for w in words], "t string")
    want = sorted({(n, t) for n in words[:25] for t in words if n in t})
    assert rows(scale.containing_pairs(needles, "n", hay, "t")) == want


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_top_k_equals_full_comparison(spark):
    random.seed(13)
    names = list({"".join(random.choice("abcdé_") for _ in range(random.randrange(2, 12))) for _ in range(120)})
    symbols = spark.createDataFrame([(n, f"f{i % 3}", i, i) for i, n in enumerate(names)], "name string, file string, start_line int, symbol_id int")
    asked = ["abcd", "dda_", "éé", "zzz", "abcabcabcabc"]
    got = {}
    for r in se.fuzzy_top_k(spark.createDataFrame([(q,) for q in asked], "query string"), symbols, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["name"], round(r["score"], 6)))
    for q in asked:
        sims = [(round(1 - lev(q, n) / max(len(q.encode()), len(n.encode())), 6), n) for n in names]
        want = sorted(((-s, n) for s, n in sims if s > 0))[:5]
        assert [(n, s) for _, n, s in sorted(got.get(q, []))] == [(n, -s) for s, n in want]


def test_greedy_budget_skips_what_does_not_fit(spark):
    random.seed(17)
    data = [(k, i, random.randrange(1, 60)) for k in ("hot", "b") for i in range(120 if k == "hot" else 5)]
    df = spark.createDataFrame(data, "k string, pos int, cost int")
    want = []
    for k in ("hot", "b"):
        used = 0
        for kk, pos, cost in sorted(data):
            if kk == k and used + cost <= 100:
                used += cost
                want.append((k, pos, cost))
    assert rows(mt.greedy_budget(df, ["k"], "pos", "cost", 100)) == sorted(want)


def test_intervals(spark):
    spans = [("f", 1, 4, 1), ("f", 5, 6, 1), ("f", 9, 9, 1), ("f", 2, 3, 1), ("f", 2, 3, 0), ("g", 1, 1, 2), ("f", 1, 4, 2), ("f", 8, 20, 3)]
    df = spark.createDataFrame(spans, "file string, start_line int, end_line int, priority int")
    assert rows(iv.merge_ranges(df, ["file"])) == [("f", 1, 6), ("f", 8, 20), ("g", 1, 1)]
    assert rows(iv.prune_contained(df, ["file"])) == [("f", 1, 4, 1), ("f", 2, 3, 0), ("f", 5, 6, 1), ("f", 8, 20, 3), ("f", 9, 9, 1), ("g", 1, 1, 2)]
    other = spark.createDataFrame([("f", 4, 4), ("g", 7, 9)], "file string, start_line int, end_line int")
    assert rows(iv.overlapping(df, other, ["file"]).select("start_line", "priority")) == [(1, 1), (1, 2)]
    assert rows(iv.not_covered(df.filter("file = 'f'"), spark.createDataFrame([("f", 1, 6)], "file string, start_line int, end_line int"), ["file"]).select("start_line")) == [(8,), (9,)]


def test_budget_keeps_the_prefix(spark):
    df = spark.createDataFrame([(1, 2, 67), (1, 0, 14)], "r int, priority int, cost int")
    assert rows(iv.within_budget(df, ["r"], [F.col("priority")], "cost", 15).select("priority")) == [(0,)]
    free = spark.createDataFrame([(1, p, c) for p, c in enumerate([0, 5, 0, 0, 5, 0, 9, 0])] + [(2, p, 0) for p in range(40)], "r int, priority int, cost int")
    got = rows(iv.within_budget(free, ["r"], [F.col("priority")], "cost", 10).select("r", "priority", "used"))
    assert [g for g in got if g[0] == 1] == [(1, 0, 0), (1, 1, 5), (1, 2, 5), (1, 3, 5), (1, 4, 10), (1, 5, 10)]
    assert len([g for g in got if g[0] == 2]) == 40
