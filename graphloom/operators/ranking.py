"""Rankings: canonical order, gaps, top-k, eviction and priority lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scale import top_n


def rank_with_gaps(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Rank rows by score with the distance to both neighbours and a separation label.

    Meant for aggregated groups (modules, languages), whose size does not grow with the rows.
    """
    win = W.partitionBy(*keys).orderBy(F.desc(score), *ties)
    out = df.withColumns({
        "rank": F.row_number().over(win), "gap_from_previous": F.lag(score).over(win) - F.col(score),
        "gap_to_next": F.col(score) - F.lead(score).over(win)})
    before, after = F.col("gap_from_previous"), F.col("gap_to_next")
    label = (F.when(before.isNull() & after.isNull(), "solo").when(after >= 5, "clear_lead")
             .when(after.isNull() & (before >= 5), "clear_trailing_gap").when(after.isNull(), "close_trailing_gap")
             .otherwise("close_cluster"))
    return out.withColumn("separation", label)


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("callee_symbol").alias("name")).agg(F.count("*").alias("calls"))


def symbols_per_file(symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """The ``n`` most called symbols of each file."""
    counted = symbols.select("file", "name", "symbol_id").join(call_counts(calls), "name", "left").withColumn(
        "calls", F.coalesce("calls", F.lit(0).cast("bigint")))
    return top_n(counted, ["file"], [F.desc("calls"), F.col("name"), F.col("symbol_id")], n).select("file", "name", "symbol_id", "calls")


def canonical_order(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file", "start_line", "name", "symbol_id")


def evict_oldest(df: DataFrame, kind: str, time: str, ident: str, keep: int) -> DataFrame:
    """Keep the newest ``keep`` rows per kind."""
    return top_n(df, [kind], [F.desc(time), F.desc(ident)], keep)


def recent_modules(df: DataFrame, module: str, mtime: Column, n: int = 3) -> DataFrame:
    return (df.groupBy(F.col(module).alias("module")).agg(F.max(mtime).alias("modified"))
            .orderBy(F.desc("modified"), "module").limit(n))


def architecture_order(modules: DataFrame) -> DataFrame:
    """Order by importance, support level, number of signals, then name."""
    rank = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).otherwise(1)
    return modules.orderBy(rank.desc(), F.col("support_rank"), F.size("signals").desc(), F.col("name"))


def priority_modules(modules: DataFrame, n: int = 3) -> DataFrame:
    """Top modules: concrete ones first, groups only fill remaining places."""
    order = [F.col("is_group"), F.desc("score"), F.col("module")]
    head = modules.orderBy(*order).limit(n)
    return head.withColumn("rank", F.row_number().over(W.orderBy(*order)))
