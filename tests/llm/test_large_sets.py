"""Near copies among large sets: sketches that follow the size keep unlike sets away from the exact check."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import linked_sets, mix, parity_sketch, wide_sketch


def test_only_large_sets_that_may_link_are_compared(spark, monkeypatch):
    draw = np.random.default_rng(5)
    fresh = lambda n: np.unique(mix(draw.integers(1, 1 << 62, n).astype(np.uint64)))
    base = fresh(1640)
    # The first two are linked, and their sketches have different lengths; a small set has none of the longer kind.
    sets = [base, base[:1560], fresh(300), *[fresh(n) for n in range(1500, 2100, 25)]]
    assert [len(wide_sketch(s)) for s in sets[:2]] == [32, 16] and wide_sketch(sets[2]) is None
    as_longs = lambda s: s.view(np.int64).tolist()
    rows = [(i, len(s), parity_sketch(s).tolist(), None if wide_sketch(s) is None else wide_sketch(s).tolist(), as_longs(s)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, n long, sketch array<long>, wide array<long>, elements array<long>")
    members = table.select(F.lit(7).cast("long").alias("sig"), "node")
    compared, exact = set(), ngram_join.verified

    def verified(pairs, elements, percent):
        compared.update(tuple(sorted(p)) for p in pairs.collect())
        return exact(pairs, elements, percent)

    monkeypatch.setattr(ngram_join, "verified", verified)
    found = linked_sets(members, table.select("node", "n", "sketch", "wide"), lambda some: table.join(some, "node").select("node", "elements"), 80)
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 0)]
    assert compared == {(0, 1)}


def test_folded_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(6)
    for n, gone in ((1700, 150), (3300, 400), (5000, 20), (900, 0)):
        a = np.unique(mix(draw.integers(1, 1 << 62, n).astype(np.uint64)))
        b = a[gone:]
        x, y = wide_sketch(a), wide_sketch(b)
        while len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= gone


def test_very_large_unlike_sets_are_told_apart():
    draw = np.random.default_rng(7)
    for n in (9500, 20000):
        a, b = (np.unique(mix(draw.integers(1, 1 << 62, n).astype(np.uint64))) for _ in range(2))
        differ = sum(int(v).bit_count() for v in (wide_sketch(a) ^ wide_sketch(b)).view(np.uint64))
        assert differ * 180 > (len(a) + len(b)) * 20


def test_tiles_find_the_pairs_of_hot_signatures(spark, monkeypatch):
    draw = np.random.default_rng(8)
    fresh = lambda n: np.unique(mix(draw.integers(1, 1 << 62, n).astype(np.uint64)))
    sets = []
    for n in (60, 420, 820, 1700, 3300):
        base = fresh(n)
        sets += [base, base[n // 12:], base[n // 4:], np.concatenate([base[n // 20:], fresh(n // 20)]), fresh(n), fresh(n + n // 10)]
    alike = lambda a, b: len(np.intersect1d(a, b)) * 100 >= len(np.union1d(a, b)) * 80
    expect = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])}
    as_longs = lambda s: s.view(np.int64).tolist()
    rows = [(i, len(s), parity_sketch(s).tolist(), None if wide_sketch(s) is None else wide_sketch(s).tolist(), as_longs(s)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, n long, sketch array<long>, wide array<long>, elements array<long>")
    members = table.select(F.explode(F.expr("array(7L, 8L)")).alias("sig"), "node")
    tile = pa.table({"node": range(len(sets)), "comp": range(len(sets)), **{c: [r[k] for r in rows] for k, c in ((1, "n"), (2, "sketch"), (3, "wide"))}})
    run, one, two = ngram_join._tile_pairs(80), pa.scalar(1), pa.scalar(2)
    whole = set(zip(*run((one, one, one), tile, tile).to_pydict().values()))
    assert expect <= whole and all(a < b for a, b in whole) and len(whole) < 2 * len(expect)
    parts = [run((one, one, two), x, y) for x, y in ((tile[:9], tile[9:]), (tile[9:], tile[:9]))]
    assert all(set(zip(*p.to_pydict().values())) == {(a, b) for a, b in whole if a < 9 <= b} for p in parts)
    monkeypatch.setattr(ngram_join, "HOT", 8)
    info = table.select("node", "n", "sketch", "wide")
    found = linked_sets(members, info, lambda some: table.join(some, "node").select("node", "elements"), 80, rounds=1, block=7).collect()
    root = list(range(len(sets)))
    for _ in root:
        for i, j in expect:
            root[i] = root[j] = min(root[i], root[j])
    assert {tuple(r) for r in found} == {(i, root[i]) for pair in expect for i in pair}
