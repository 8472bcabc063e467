"""Building blocks that keep skewed groups distributed.

Any key may hold a large share of all rows, so no operator sorts a whole group in one task. The
blocks below split a group into buckets of its ordering column, work inside each bucket, and carry
one summary row per bucket across.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark cuts each group to ``n`` rows before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_n(df, keys, order, 1)


def prefix_max(df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, Column],
               width: int = 4096, own: str | None = None) -> DataFrame:
    """Per distinct (keys, pos): maximum of each value over strictly smaller positions.

    With ``own`` the maximum at the position itself is returned too, under that prefix.

    Positions are integers, so after the pre-aggregation a bucket holds at most ``width`` rows
    however many rows share a key.
    """
    names = list(values)
    grid = df.groupBy(*keys, pos).agg(*[F.max(values[n]).alias(n) for n in names])
    grid = grid.withColumn("_b", F.floor(F.col(pos) / width))
    inner = W.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    kept = [F.col(n).alias(f"{own}{n}") for n in names] if own else []
    local = grid.select(*keys, pos, "_b", *kept, *[F.max(n).over(inner).alias(f"_in_{n}") for n in names])
    outer = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        grid.groupBy(*keys, "_b").agg(*[F.max(n).alias(n) for n in names])
        .select(*keys, "_b", *[F.max(n).over(outer).alias(f"_out_{n}") for n in names])
    )
    # Joined by merging: one row a bucket can be many rows, which a broadcast would send through the driver.
    return local.join(carry.hint("merge"), [*keys, "_b"]).select(
        *keys, pos, *[f"{own}{n}" for n in names if own], *[F.greatest(f"_in_{n}", f"_out_{n}").alias(n) for n in names]
    )


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 lag: Mapping[str, str] | None = None, lead: Mapping[str, str] | None = None,
                 running_sum: Mapping[str, str] | None = None,
                 last_before: Mapping[str, str] | None = None,
                 last_upto: Mapping[str, str] | None = None) -> DataFrame:
    """Window functions over (keys, order) evaluated bucket by bucket.

    ``bucket`` must not decrease along ``order``. Each mapping is output name -> input column:
    ``lag``/``lead`` look one row back/ahead, ``running_sum`` includes the current row,
    ``last_before``/``last_upto`` give the latest non-null value before / up to the row.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    running_sum = dict(running_sum or {})
    last_before, last_upto = dict(last_before or {}), dict(last_upto or {})
    df = df.withColumn("_b", bucket)
    sort = [F.col(c) for c in order]
    key = F.struct(*sort)
    win = W.partitionBy(*keys, "_b").orderBy(*sort)
    before = win.rowsBetween(W.unboundedPreceding, -1)
    upto = win.rowsBetween(W.unboundedPreceding, 0)
    cols: dict[str, Column] = {}
    sums: list[Column] = []
    for out, col in lag.items():
        cols[out] = F.lag(F.struct(F.col(col).alias("v"))).over(win)
        sums.append(F.max_by(F.struct(F.col(col).alias("v")), key).alias(f"_s_{out}"))
    for out, col in lead.items():
        cols[out] = F.lead(F.struct(F.col(col).alias("v"))).over(win)
        sums.append(F.min_by(F.struct(F.col(col).alias("v")), key).alias(f"_s_{out}"))
    for out, col in running_sum.items():
        cols[out] = F.sum(col).over(upto)
        sums.append(F.sum(col).alias(f"_s_{out}"))
    for out, col in {**last_before, **last_upto}.items():
        cols[out] = F.last(col, ignorenulls=True).over(before if out in last_before else upto)
        sums.append(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), key)).alias(f"_s_{out}"))
    local = df.select("*", *[c.alias(n) for n, c in cols.items()])
    across = W.partitionBy(*keys).orderBy("_b")
    prior = across.rowsBetween(W.unboundedPreceding, -1)
    carried: list[Column] = []
    for out in lag:
        carried.append(F.lag(f"_s_{out}").over(across).alias(f"_c_{out}"))
    for out in lead:
        carried.append(F.lead(f"_s_{out}").over(across).alias(f"_c_{out}"))
    for out in running_sum:
        carried.append(F.sum(f"_s_{out}").over(prior).alias(f"_c_{out}"))
    for out in {**last_before, **last_upto}:
        carried.append(F.last(f"_s_{out}", ignorenulls=True).over(prior).alias(f"_c_{out}"))
    carry = df.groupBy(*keys, "_b").agg(*sums).select(*keys, "_b", *carried)
    joined = local.join(carry, [*keys, "_b"])
    final: dict[str, Column] = {}
    for out in [*lag, *lead]:
        final[out] = F.coalesce(F.col(out), F.col(f"_c_{out}"))["v"]
    for out in running_sum:
        final[out] = F.col(out) + F.coalesce(F.col(f"_c_{out}"), F.lit(0))
    for out in {**last_before, **last_upto}:
        final[out] = F.coalesce(F.col(out), F.col(f"_c_{out}"))
    return joined.withColumns(final).drop("_b", *[f"_c_{o}" for o in final])


def positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Zero-based position of every row in the order of ``order``, which no task sorts as a whole.

    Rows are dealt by ranges of the order, numbered inside their range and shifted by the sizes of the ranges before. A
    row number breaks ties, so equal rows may fall into several ranges. Rows and ranges are written before they are
    counted, and a repeated task finds the same ones.
    """
    given = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    keys = [*order, "_id"]
    dealt = cut_lineage(given.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*keys)))
    return inside.join(sizes, "_p").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_p", "_n", "_before", "_id")


# Bins of a doubling of the value, and a shift above the largest logarithm in bins.
BINS, BIN_SHIFT = 512, 1_000_000


def quantile_bin(value: Column) -> Column:
    """Number of the bin of a value, never falling as values rise: equal steps of its logarithm on either side of zero.

    Bins of any two tables agree, so their counts add up; a bin is about 0.14 % wide, at most about 2.2 million exist.
    """
    v = value.cast("double")
    size = BIN_SHIFT + F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1100.0)), F.lit(-1100.0)) * BINS)
    return F.when(F.isnan(v), 2 * BIN_SHIFT).when(v > 0, size).when(v < 0, -size).otherwise(0)


def value_at_fraction(df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Exact element ``sorted[min(floor(n*p), n-1)]`` per key, without sorting a whole group.

    A first pass counts values per bin (``quantile_bin``) and finds the bin that holds the wanted rank; only rows of that
    bin are then counted per distinct value. Rates between 0 and 1 spread over as many bins as large numbers do.
    """
    binned = df.filter(F.col(value).isNotNull()).withColumn("_bin", quantile_bin(F.col(value)))
    hist = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    by_key = W.partitionBy(*keys)
    hist = hist.withColumns({
        "_cum": F.sum("_n").over(by_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)),
        "_total": F.sum("_n").over(by_key),
    })
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.least(F.floor(F.col("_total") * F.lit(float(p))), F.col("_total") - 1).alias("k"))
        for name, p in fractions.items()
    ])
    picks = (
        hist.withColumn("_w", F.explode(wanted))
        .filter((F.col("_cum") > F.col("_w.k")) & (F.col("_cum") - F.col("_n") <= F.col("_w.k")))
        .select(*keys, "_bin", F.col("_w.name").alias("_name"),
                (F.col("_w.k") - (F.col("_cum") - F.col("_n"))).alias("_off"))
    )
    fine = binned.groupBy(*keys, "_bin", value).agg(F.count("*").alias("_n")).join(picks, [*keys, "_bin"])
    win = W.partitionBy(*keys, "_name").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    fine = fine.withColumn("_cum", F.sum("_n").over(win))
    hit = fine.filter((F.col("_cum") > F.col("_off")) & (F.col("_cum") - F.col("_n") <= F.col("_off")))
    return hit.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in fractions
    ])


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n``."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, F.lit(n)))
    )).otherwise(F.array().cast("array<string>"))


# Texts of a gram are dealt over this many join keys: those of short needles, whose grams are in most texts, and others.
SHORT_SALTS, GRAM_SALTS = 64, 4


def containing_pairs(needles: DataFrame, needle: str, hay: DataFrame, text: str,
                     size: int = 3) -> DataFrame:
    """Pairs (needle, text) of distinct strings where ``text`` contains ``needle``.

    An equality join on one gram per needle replaces the nested loop: of all grams of the needle
    the one that occurs in the fewest texts is used, so common grams do not build large groups.
    Texts are cut into grams once and keep only grams that some needle has. The texts of a gram are
    dealt over several keys, those of a gram shorter than ``size`` over many.
    """
    n = needles.select(needle).distinct().filter(F.length(needle) > 0)
    own = F.when(F.length(needle) < size, F.array(F.col(needle))).otherwise(grams(F.col(needle), size))
    asked = n.select(needle, F.explode(own).alias("_g"), F.size(own).alias("_need"))
    every = F.array_distinct(F.concat(*[grams(F.col(text), k) for k in range(1, size + 1)]))
    posting = hay.select(text).distinct().select(text, F.explode(every).alias("_g")).join(asked.select("_g").distinct(), "_g", "left_semi")
    salts = F.when(F.length("_g") < size, SHORT_SALTS).otherwise(GRAM_SALTS)
    posting = cut_lineage(posting.withColumn("_salt", F.pmod(F.xxhash64(text), salts).cast("int")))
    df = posting.groupBy("_g").agg(F.count("*").alias("_df"))
    rare = (
        asked.join(df, "_g")
        .groupBy(needle).agg(F.min_by("_g", F.struct("_df", "_g")).alias("_g"),
                             F.count("*").alias("_found"), F.first("_need").alias("_need"))
        .filter(F.col("_found") == F.col("_need"))
    )
    dealt = rare.select(needle, "_g", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return dealt.join(posting, ["_g", "_salt"]).filter(F.contains(F.col(text), F.col(needle))).select(needle, text)


def any_text_contains(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """Distinct needles contained in at least one text."""
    return containing_pairs(needles, needle, hay, text).select(needle).distinct()


def ancestors(path: Column) -> Column:
    """All directory prefixes of a path and the path itself, so prefix tests become equality joins."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
