"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Each step joins edges with one minimum per node, so no neighbour list is ever gathered and a node
    with very many edges is split by the join like any skewed key. Steps are written to the shared
    folder; the loop ends when a step changes nothing. Self loops and null ends are ignored.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = stored(edges.filter(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = _state(now)
        if state == seen:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
