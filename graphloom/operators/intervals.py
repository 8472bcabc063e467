"""Closed line ranges: merging, pruning, overlap, coverage and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scale import ordered_scan, prefix_max, top_n


def merge_ranges(spans: DataFrame, keys: Sequence[str], gap: int = 1) -> DataFrame:
    """Union ranges per key; ranges at most ``gap`` lines apart become one."""
    reach = prefix_max(spans, keys, "start_line", {"reach": F.col("end_line")}, own="own_")
    flagged = reach.withColumnRenamed("own_reach", "end_line").withColumn(
        "brk", F.when(F.col("start_line") <= F.col("reach") + gap, 0).otherwise(1))
    islands = ordered_scan(flagged, keys, ["start_line"], F.floor(F.col("start_line") / 4096), running_sum={"island": "brk"})
    return islands.groupBy(*keys, "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def best_per_span(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the best priority of identical spans."""
    return items.groupBy(*keys, "start_line", "end_line").agg(F.min("priority").alias("priority"))


def prune_contained(items: DataFrame, keys: Sequence[str], priorities: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Drop items whose span lies inside another span of the same key and equal or better priority.

    Testing against all better items equals testing against kept ones. The furthest end seen so far
    per priority level decides, so spans are never compared pairwise.
    """
    spans = best_per_span(items, keys)
    level = {f"p{p}": F.when(F.col("priority") <= p, F.col("end_line")) for p in priorities}
    joined = spans.join(prefix_max(spans, keys, "start_line", level, own="s"), [*keys, "start_line"])
    reach: Column = F.lit(None).cast("int")
    beside: Column = F.lit(None).cast("int")
    for p in priorities:
        reach = F.when(F.col("priority") == p, F.col(f"p{p}")).otherwise(reach)
        beside = F.when(F.col("priority") == p, F.col(f"sp{p}")).otherwise(beside)
    covered = (F.coalesce(reach, F.lit(-1)) >= F.col("end_line")) | (F.coalesce(beside, F.lit(-1)) > F.col("end_line"))
    return joined.filter(~covered).select(*keys, "start_line", "end_line", "priority")


def overlapping(spans: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans that share a line with at least one other span of the same key.

    A span overlaps when the furthest end among others starting at or before its end reaches its start.
    """
    pos = F.col("end_line") + 1
    marks = others.select(*keys, F.col("start_line").alias("pos"), F.col("end_line").alias("reach")).unionByName(
        spans.select(*keys, pos.alias("pos"), F.lit(None).cast("int").alias("reach")).distinct())
    reach = prefix_max(marks, keys, "pos", {"far": F.col("reach")})
    return (spans.withColumn("pos", pos).join(reach, [*keys, "pos"])
            .filter(F.col("far") >= F.col("start_line")).drop("pos", "far"))


def not_covered(spans: DataFrame, cover: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans not fully inside one of the covering ranges."""
    pos = F.col("start_line") + 1
    marks = cover.select(*keys, F.col("start_line").alias("pos"), F.col("end_line").alias("reach")).unionByName(
        spans.select(*keys, pos.alias("pos"), F.lit(None).cast("int").alias("reach")).distinct())
    reach = prefix_max(marks, keys, "pos", {"far": F.col("reach")})
    return (spans.withColumn("pos", pos).join(reach, [*keys, "pos"])
            .filter(F.coalesce(F.col("far"), F.lit(-1)) < F.col("end_line")).drop("pos", "far"))


def within_budget(items: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str, budget: int,
                  min_cost: int = 1) -> DataFrame:
    """Longest ordered prefix whose total cost fits the budget, items without cost included.

    An item that costs anything costs at least ``min_cost``, so such an item can only be kept among the
    first ``budget / min_cost``: the running total looks at no more of a group. Items without cost, however
    many, take the total of the last paid item before them and end where the first item no longer fits.
    """
    keys = list(keys)
    rows = items.withColumn("_o", F.struct(*order))
    head = top_n(rows.filter(F.col(cost) > 0), keys, [F.col("_o")], budget // min_cost + 1, "_r")
    head = head.withColumn("used", F.sum(cost).over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)))
    paid = head.filter(F.col("used") <= budget)
    steps = head.groupBy(*keys).agg(F.collect_list(F.when(F.col("used") <= budget, F.struct("_o", "used"))).alias("_paid"),
                                    F.min(F.when(F.col("used") > budget, F.col("_o"))).alias("_stop"))
    free = rows.filter(F.col(cost) <= 0).join(steps, keys, "left").filter(F.col("_stop").isNull() | (F.col("_o") < F.col("_stop")))
    so_far = F.array_max(F.transform(F.filter("_paid", lambda p: p["_o"] < F.col("_o")), lambda p: p["used"]))
    free = free.withColumn("used", F.coalesce(so_far, F.lit(0)).cast(dict(head.dtypes)["used"])).drop("_paid", "_stop")
    return paid.drop("_r", "_o").unionByName(free.drop("_o"))


def item_cost() -> Column:
    """Estimated tokens of a span: 40 characters a line, between 120 and 4000, three per token."""
    chars = F.least(F.greatest((F.col("end_line") - F.col("start_line") + 1) * 40, F.lit(120)), F.lit(4000))
    return F.ceil(chars / 3)
