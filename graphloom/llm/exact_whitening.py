"""Whitening of embeddings by an exact characteristic polynomial.

Vectors are fixed-point integers x = floor(256 * c). What is fitted is the list of distinct x vectors: their number n,
the sums S and the integer scatter M = n * sum(x x') - S S', which is n^2 times their covariance.

1. *Moments.* Partial sums per partition, exact: float64 products of 21-bit limbs over at most 1,024 rows stay below
   2^53. Spark adds the partial sums limb by limb; the driver sees dimension^2 numbers.
2. *Polynomial.* For each of enough 31-bit primes a task reduces M to Hessenberg form and reads the polynomial off by its
   recurrence. Chinese remaindering of the residues gives the coefficients as integers; the number of primes follows from
   the trace, by Maclaurin's inequality.
3. *Roots.* All roots are real, so the sign changes of p(t + a) are exactly the number of roots above a. Bisection by
   that count encloses each root to a relative width of 2^-160.
4. *Components.* Inverse iteration in 100 decimal digits with the enclosed root as shift. Roots that agree to 2^-100
   count as one root, with an orthonormal basis of its space. Each vector's residual is checked.

Only steps 1 and the projection grow with the rows; steps 2 to 4 depend on the dimension alone.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors are filled up
with zeros to the longest. Repeated vectors count once in the fit, every row is projected. There are as many components
as positive eigenvalues, at most the number asked for: none for an empty table or a single distinct vector. Entries
beyond the range of a long are held at its ends; a ``deviation`` beyond it is null. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

LIMB = 21  # bits of a factor
PART = 40  # bits of a summand
ROWS = 1024
ROOT_BITS, SAME_BITS, DIGITS = 160, 100, 100


class Fit(NamedTuple):
    n: int
    sums: list[int]
    eigenvalues: list[int]  # of the scatter, times 2 ** scale
    scale: int
    trace: int  # of the scatter
    components: list[list[float]]


def fixed_point(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and the integer vector ``x`` of rows that have one."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return table.filter(F.col(vector).isNotNull() & whole).select(
        F.col(key).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * 256)).alias("x"))


def filled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Vectors filled up with zeros to the longest, and that length."""
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))), dim


def gram(x: np.ndarray) -> np.ndarray:
    """Exact x'x of an int64 matrix, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for start in range(0, len(x), ROWS):
        part, limbs = x[start:start + ROWS], []
        while True:
            if np.all((part >= -(1 << LIMB)) & (part < 1 << LIMB)):
                limbs.append(part.astype(np.float64))
                break
            limbs.append((part & ((1 << LIMB) - 1)).astype(np.float64))
            part = part >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _parts(value: int) -> Iterator[int]:
    """``value`` as summands of ``PART`` bits; all have its sign."""
    sign, rest = (-1 if value < 0 else 1), abs(value)
    while rest:
        yield sign * (rest & ((1 << PART) - 1))
        rest >>= PART


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and sum(x x') over ``fit``. A column of ones in front of x makes them one matrix."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1), dtype=object)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(np.int64)
                total += gram(np.hstack([np.ones((len(x), 1), dtype=np.int64), x]))
        rows = [(i, j, k, v) for i in range(dim + 1) for j in range(i, dim + 1) for k, v in enumerate(_parts(total[i, j]))]
        yield pd.DataFrame(rows, columns=["i", "j", "k", "v"])

    sums = fit.select("x").mapInPandas(partial, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    whole = np.zeros((dim + 1, dim + 1), dtype=object)
    for i, j, k, v in sums.collect():
        whole[i, j] += v << (PART * k)
    for i in range(dim + 1):
        whole[i + 1:, i] = whole[i, i + 1:]
    return whole[0, 0], list(whole[0, 1:]), whole[1:, 1:]


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # decides below 3,215,031,751
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """31-bit primes, from the largest down, with a product above ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo ``p``, highest power first, by reduction to Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + below[0]
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = [np.zeros(d + 1, dtype=np.int64)]
    polys[0][0] = 1
    for k in range(1, d + 1):
        last, now = polys[k - 1], np.zeros(d + 1, dtype=np.int64)
        now[1:] = last[:-1]
        now = (now - h[k - 1, k - 1] * last) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            now = (now - int(h[k - 1 - i, k - 1]) * chain % p * polys[k - 1 - i]) % p
        polys.append(now)
    return [int(c) for c in polys[d][::-1]]


def polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Characteristic polynomial of a positive semidefinite integer matrix, highest power first."""
    d = len(matrix)
    trace = sum(matrix[i, i] for i in range(d))
    primes = primes_beyond((1 + -(-trace // d)) ** d)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "c": [polynomial_mod(matrix, int(p)) for p in batch["p"]]})

    deal = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(deal)
    out, product = [0] * (d + 1), 1
    for p, c in table.mapInPandas(residues, "p long, c array<long>").collect():
        lift = pow(product, -1, p)
        # The coefficient of t^(d - k) has the sign (-1)^k; without it, it lies between 0 and the bound.
        out = [v + product * (((r if k % 2 == 0 else -r) - v) * lift % p) for k, (v, r) in enumerate(zip(out, c))]
        product *= p
    return [v if k % 2 == 0 else -v for k, v in enumerate(out)]


def roots_above(poly: list[int], numerator: int, scale: int) -> int:
    """Roots of a real-rooted polynomial above numerator / 2^scale, by sign changes of the shifted polynomial."""
    c = [v << (scale * k) for k, v in enumerate(poly)]
    for stop in range(len(c), 1, -1):
        for i in range(1, stop):
            c[i] += numerator * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> tuple[list[int], int]:
    """The largest positive roots, with multiplicity, as integers over 2^scale; each is off by one at most."""
    limit = (1 << max(abs(poly[1]).bit_length() if len(poly) > 1 else 1, 1))  # above the sum of all roots
    count = min(count, roots_above(poly, 0, 0))
    if not count:
        return [], 0
    known: dict[tuple[int, int], int] = {}

    def above(a: int, scale: int) -> int:
        while scale and a % 2 == 0:
            a, scale = a // 2, scale - 1
        if (a, scale) not in known:
            known[a, scale] = roots_above(poly, a, scale)
        return known[a, scale]

    scale = max(0, bits - limit.bit_length())
    while True:
        out = []
        for j in range(1, count + 1):
            low, high = 0, (limit if not out else out[-1] + 1)
            high = high << scale if not out else high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if above(middle, scale) >= j else (low, middle)
            out.append(low)
        if out[-1].bit_length() >= bits:
            return out, scale
        scale += bits - out[-1].bit_length() + 1


def _factors(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Triangular factors with row exchanges, in place."""
    order = list(range(len(a)))
    for k in range(len(a)):
        i = max(range(k, len(a)), key=lambda r: abs(a[r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[i], order[k] = order[k], order[i]
        if not a[k, k]:
            a[k, k] = Decimal(10) ** (-2 * DIGITS)
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def _solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    y = b[order].copy()
    for i in range(1, len(y)):
        y[i] -= lu[i, :i].dot(y[:i])
    for i in range(len(y) - 1, -1, -1):
        y[i] = (y[i] - (lu[i, i + 1:].dot(y[i + 1:]) if i + 1 < len(y) else 0)) / lu[i, i]
    return y


def _orthonormal(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - o.dot(v) * o
        v = v / v.dot(v).sqrt()
    return v


def null_vectors(matrix: np.ndarray, roots: list[int], scale: int) -> list[list[float]]:
    """Unit eigenvectors for the given roots (falling), by inverse iteration with the root as shift."""
    out: list[list[float]] = []
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object)
        at = 0
        while at < len(roots):
            same = at + 1
            while same < len(roots) and (roots[at] - roots[same]) << SAME_BITS <= roots[at]:
                same += 1
            root = Decimal(2 * roots[at] + 1) / Decimal(2 << scale)
            shifted = exact.copy()
            for i in range(len(shifted)):
                shifted[i, i] -= root
            lu, order = _factors(shifted)
            basis: list[np.ndarray] = []
            seed = 1
            while len(basis) < same - at:
                draw = np.random.default_rng(seed).integers(1, 1 << 30, len(exact))
                v = _orthonormal(np.array([Decimal(int(x)) for x in draw], dtype=object), basis)
                for _ in range(6):
                    v = _orthonormal(_solve(lu, order, v), basis)
                rest = exact.dot(v) - root * v
                if max(abs(r) for r in rest) <= root * Decimal(10) ** -25:
                    basis.append(v)
                elif seed > 50:
                    raise ArithmeticError("inverse iteration found no eigenvector")
                seed += 1
            out += [[float(x) for x in v] for v in basis]
            at = same
    return out


def fit_distinct(fit: DataFrame, dim: int, count: int) -> Fit:
    """Fit over the distinct vectors in ``fit``."""
    n, sums, second = moments(fit, dim)
    s = np.array(sums, dtype=object)
    scatter = n * second - np.outer(s, s)
    trace = sum(scatter[i, i] for i in range(dim)) if dim else 0
    if not trace:
        return Fit(n, sums, [], 0, 0, [])
    roots, scale = largest_roots(polynomial(fit.sparkSession, scatter), count)
    return Fit(n, sums, roots, scale, trace, null_vectors(scatter, roots, scale))


def _ratio(a: int, b: int) -> float:
    return a / b  # of integers: correctly rounded


def project(rows: DataFrame, fit: Fit) -> DataFrame:
    """Add ``deviation`` and the whitened coordinates ``z`` to rows with ``x``."""
    n, sums = fit.n, fit.sums
    # sqrt(e) with e = root / n^2, as the root of an integer over n
    spread = [isqrt(v << (fit.scale + 128)) / (n << (fit.scale + 64)) for v in fit.eigenvalues]
    weights = (np.array(fit.components) / np.array(spread)[:, None]).T
    schema = T.StructType([f for f in rows.schema.fields if f.name != "x"]
                          + [T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
    largest = max(abs(s) for s in sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64)
            safe = float(np.abs(x.astype(np.float64)).max()) * n + largest < 2.0 ** 62
            away = x * n - np.array(sums, dtype=np.int64) if safe else x.astype(object) * n - np.array(sums, dtype=object)
            if safe and float((away.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0 ** 62:
                deviation = pd.array((away * away).sum(axis=1), dtype="Int64")
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in away]
                deviation = pd.array([v if v < 1 << 63 else None for v in exact], dtype="Int64")
            z = (away / n).astype(np.float64) @ weights
            yield batch.drop(columns="x").assign(deviation=deviation, z=list(z))

    return rows.mapInPandas(run, schema)


def identity_error(fit_rows: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over the fit list."""
    z, k = project(fit_rows, fit), len(fit.components)
    mean = z.agg(*[F.avg(F.col("z")[i]) for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = z.agg(*[F.avg((F.col("z")[i] - mean[i]) * (F.col("z")[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 4) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error; see the module's text."""
    rows, dim = filled(fixed_point(table, key, vector))
    distinct = stored(rows.select("x").distinct(), "distinct")
    fit = fit_distinct(distinct, dim, count)
    if not fit.components:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                      "explained double, identity_error double")
    explained = F.array(*[F.lit(_ratio(v, fit.trace << fit.scale)) for v in fit.eigenvalues])
    error = identity_error(distinct, fit)
    return project(rows, fit).select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
