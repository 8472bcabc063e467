"""Exact whitening against plain linear algebra, with repeats, nulls, ties, rank loss and clashing columns."""

from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import exact_whitening as ew

SCHEMA = "vec_id long, embedding array<double>, x int, z int, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def plain(vectors, count):
    x = np.floor(np.array(vectors, dtype=float) * 256)
    fit = np.unique(x, axis=0)
    values, parts = np.linalg.eigh(np.cov(fit.T, bias=True))
    order = np.argsort(-values)[:count]
    return fit, values[order], (x - fit.mean(0)) @ parts[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(spark, vectors, kept, count=4):
    out = ew.whiten(table(spark, vectors)).toPandas()
    good = [vectors[i] for i in kept]
    fit, values, z, explained = plain(good, count)
    assert sorted(out.vec_id.unique()) == kept and set(out.component) == set(range(1, count + 1)) and len(out) == count * len(kept)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[kept].to_numpy()
    sign = np.sign((got * z).sum(axis=0))
    assert np.allclose(got, z * sign, atol=1e-9)
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9)
    assert set(out.n) == {len(fit)} and out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-9
    x, sums = np.floor(np.array(good) * 256).astype(int), fit.sum(0).astype(int)
    assert list(out.groupby("vec_id").deviation.first()) == [int(((len(fit) * r - sums) ** 2).sum()) for r in x]


def test_equals_linear_algebra(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 9)) * np.linspace(1, 2, 9)).tolist()
    bad = [None, [1.0, None] + [0.0] * 7, [float("nan")] + [0.0] * 8, [float("inf")] + [0.0] * 8]
    vectors += bad + [vectors[5]] * 200 + [[-0.0] * 9, [0.001] * 9, [-1e-12] + [0.0] * 8]
    check(spark, vectors, [i for i in range(len(vectors)) if not 300 <= i < 304])


def test_rank_below_four(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 9, size=(60, 2)) / 4
    check(spark, np.hstack([a, a[:, :1] + a[:, 1:], -a[:, :1]]).tolist(), list(range(60)), 2)


def test_equal_eigenvalues_give_whitened_data(spark):
    corners = [[s * 1.0 if k == i else 0.0 for k in range(6)] for i in range(6) for s in (1, -1)]
    out = ew.whiten(table(spark, corners)).toPandas()
    assert out.identity_error.max() < 1e-12 and np.allclose(out.explained, 1 / 6)
    assert out.groupby("vec_id").whitened.apply(tuple).nunique() == 12


def test_close_eigenvalues(spark):
    rows = [[0.0] * 3] + [[s * 4000.0 + (s > 0) / 256 * (k == 0) if k == i else 0.0 for k in range(3)] for i in range(3) for s in (1, -1)]
    out = ew.whiten(table(spark, rows)).toPandas()
    assert out.identity_error.max() < 1e-8 and set(out.component) == {1, 2, 3}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [None], [[]], [[], None]])
def test_nothing_to_fit(spark, vectors):
    out = ew.whiten(table(spark, vectors) if vectors else spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_short_and_huge_vectors(spark):
    out = ew.whiten(table(spark, [[1.0], [1.0, 2.0], [5.0, -3.0], []])).toPandas()
    assert len(out) == 8 and out.identity_error.max() < 1e-9
    far = ew.whiten(table(spark, [[1e300, 0.0], [0.0, 1.0], [-3.0, 2.0]])).toPandas()
    assert len(far) == 6 and far.deviation.isna().all()
    mid = ew.whiten(table(spark, [[1e9, 0.0], [0.0, 1.0], [-3.0, 2.0]])).toPandas()
    x = [[256 * 10 ** 9, 0], [0, 256], [-768, 512]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert [None if w >= 1 << 63 else w for w in want] == [None if np.isnan(v) else int(v) for v in mid.groupby("vec_id").deviation.first().astype(float)]


def test_moments_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-2 ** 62, 2 ** 62, size=(2500, 3)), rng.integers(-300, 300, size=(700, 3)), [[-2 ** 63, 2 ** 63 - 1, -1]]])
    n, sums, second = ew.moments(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(3), 3)
    whole = x.astype(object)
    assert n == len(x) and sums == list(whole.sum(axis=0)) and (second == whole.T.dot(whole)).all()


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(-50, 50, size=(5, 5)).astype(object)
    m = a.T.dot(a)
    poly = ew.polynomial(spark, m)
    power, want = np.eye(5, dtype=object).astype(int).astype(object), [1]
    for k in range(1, 6):  # trace recurrence in exact fractions
        power = m.dot(power)
        want.append(Fraction(-sum(power[i, i] for i in range(5)), k))
        power = power + np.diag([want[-1]] * 5)
    assert poly == want
    roots, scale = ew.largest_roots(poly, 5)
    assert np.allclose([r / (1 << scale) for r in roots], np.linalg.eigvalsh(m.astype(float))[::-1], rtol=1e-9)
    # (t - 1)(t - 2)^2 t
    poly = [1, -5, 8, -4, 0]
    assert [ew.roots_above(poly, a, 1) for a in (-1, 0, 1, 2, 3, 4, 5)] == [4, 3, 3, 2, 2, 0, 0]
    roots, scale = ew.largest_roots(poly, 4)
    assert [round(r / (1 << scale)) for r in roots] == [2, 2, 1]


def test_primes():
    primes = ew.primes_beyond(1 << 200)
    assert len(primes) == 7 and all(pow(2, p - 1, p) == 1 and p % 3 and p % 7 and p % 11 for p in primes)
    assert [n for n in range(2, 60) if ew._is_prime(n) and n > 7] == [11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
