"""Incremental index maintenance: change detection, replacement, deletion, counters and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import language
from .scale import ancestors, top_n


def classify_changes(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer comparison of (path, checksum): new, changed, unchanged or deleted."""
    old = snapshot.select("path", F.col("checksum").alias("old"))
    now = current.select("path", F.col("checksum").alias("now"))
    change = (F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted")
              .when(F.col("old") == F.col("now"), "unchanged").otherwise("changed"))
    return old.join(now, "path", "full_outer").select("path", change.alias("change"))


def replace_by_key(table: DataFrame, keys: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Drop every row of the keys, then add the new rows."""
    return table.join(keys.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_cascade(tables: Mapping[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Remove all rows of the deleted keys from every table: name -> (table, key column)."""
    keys = gone.select(key).distinct()
    return {n: df.join(keys.withColumnRenamed(key, column), column, "left_anti") for n, (df, column) in tables.items()}


def merge_counters(rows: DataFrame) -> DataFrame:
    """One row per error pattern: the first sighting and its message stay, the last moves, hits add up."""
    return rows.groupBy("hash").agg(
        F.min_by("kind", F.struct("first_ms", "kind")).alias("kind"), F.min_by("message", F.struct("first_ms", "message")).alias("message"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("hits").alias("hits"))


def upsert_counters(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge error patterns of a batch into their history."""
    return merge_counters(history.unionByName(batch))


def pattern_rows(errors: DataFrame) -> DataFrame:
    """Raw errors (kind, message, ts_ms) as pattern counters."""
    return errors.groupBy(F.xxhash64("kind", "message").alias("hash")).agg(
        F.min("kind").alias("kind"), F.min("message").alias("message"), F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"), F.count("*").alias("hits"))


def ingest_statistics(changes: DataFrame) -> DataFrame:
    """Counters of one run over (path, change, ms, at, failure, excluded) rows.

    ``failure`` is null, ``read`` or ``parse``; ``at`` is when a file's turn came, so ``last_ms`` is the time of the last one.
    """
    ok = F.col("failure").isNull() & ~F.col("excluded")
    indexed = ok & F.col("change").isin("new", "changed")
    spent = F.when(indexed, F.col("ms"))
    return changes.agg(
        F.count_if(indexed).alias("indexed"), F.count_if(ok & (F.col("change") == "unchanged")).alias("skipped"),
        F.count_if(F.col("change") == "deleted").alias("deleted"), F.count_if(F.col("excluded")).alias("excluded"),
        F.count_if((F.col("failure") == "read") & ~F.col("excluded")).alias("read_failed"),
        F.count_if((F.col("failure") == "parse") & ~F.col("excluded")).alias("parse_failed"),
        F.max_by(F.col("ms"), F.when(indexed, F.col("at"))).alias("last_ms"), F.sum(spent).alias("total_ms"),
        F.max(spent).alias("max_ms"), F.round(F.avg(spent), 6).alias("avg_ms"))


def failing_paths(changes: DataFrame, n: int = 20) -> DataFrame:
    """First failing paths for the report."""
    return changes.filter("failure IS NOT NULL AND NOT excluded").select("path").orderBy("path").limit(n)


def coverage_state(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage of (target_id, target): unsupported, indexed or not; a null target is the repository.

    Directories match by prefix and files by path or a sibling script extension; both are equality
    joins on exploded ancestors and candidate names.
    """
    clean = F.regexp_replace(F.regexp_replace(F.trim("target"), r"\\", "/"), "^/+|/+$", "")
    t = targets.select("target_id", clean.alias("t"))
    file_like = F.element_at(F.split("t", "/"), -1).contains(".")
    unsupported = file_like & language(F.col("t")).isNull()
    stem, ext = F.regexp_extract("t", r"^(.*)\.[^.]*$", 1), F.regexp_extract("t", r"\.([^.]*)$", 1)
    alias = F.array(*[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx")])
    names = F.when(file_like & ext.isin("ts", "tsx", "js", "jsx"), F.array_union(F.array("t"), alias)).otherwise(F.array("t"))
    keys = t.select("target_id", "t", F.explode(names).alias("_key"))
    paths = files.select("path").distinct()
    below = paths.select(F.explode(ancestors(F.col("path"))).alias("_key")).distinct()
    as_file = keys.filter(file_like).join(paths.select(F.col("path").alias("_key")), "_key", "left_semi")
    as_dir = keys.filter(~file_like).join(below, "_key", "left_semi")
    hit = as_file.select("target_id").unionByName(as_dir.select("target_id")).distinct().withColumn("_hit", F.lit(True))
    any_file = paths.limit(1).agg((F.count("*") > 0).alias("_some")).withColumn("_k", F.lit(1))
    rows = t.join(hit, "target_id", "left").withColumn("_k", F.lit(1)).join(F.broadcast(any_file), "_k")
    state = (F.when(F.col("t").isNotNull() & unsupported, "unsupported_target").when(~F.col("_some"), "unindexed_repo")
             .when(F.col("t").isNull(), "indexed_repo").when(F.col("_hit"), "indexed_target").otherwise("unindexed_target"))
    return rows.select("target_id", state.alias("state"))


def index_delta(before: DataFrame, after: DataFrame, internal: Column, n: int = 8) -> DataFrame:
    """Paths that were added: their number and the first ``n`` that are not internal."""
    added = after.select("path").distinct().join(before.select("path").distinct(), "path", "left_anti")
    total = added.agg(F.count("*").alias("added")).withColumn("k", F.lit(1))
    first = top_n(added.filter(~internal).withColumn("k", F.lit(1)), ["k"], [F.col("path")], n, "_r")
    sample = first.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda s: s["path"]), ",").alias("sample"))
    return total.join(sample, "k", "left").drop("k")


def greedy_budget(items: DataFrame, keys: Sequence[str], order: str, cost: str, budget: int, min_cost: int = 1) -> DataFrame:
    """Ordered items that fit a budget when an item that does not fit is skipped.

    Each round takes the longest prefix that fits, drops the item after it and every later item
    larger than what is left. A round looks at no more than ``budget / min_cost + 1`` items per key,
    so groups of any size stay distributed.
    """
    from pyspark.sql import Window as W

    from ..session import cut_lineage

    left = cut_lineage(items.filter(F.col(cost) <= budget).withColumn("_room", F.lit(budget).cast("bigint")))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        head = top_n(left, keys, [F.col(order)], budget // min_cost + 1, "_r")
        win = W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
        head = head.withColumn("_used", F.sum(cost).over(win))
        kept = cut_lineage(head.filter(F.col("_used") <= F.col("_room")))
        taken.append(kept.drop("_r", "_used", "_room"))
        state = kept.groupBy(*keys).agg(F.max(order).alias("_last"), F.max("_used").alias("_spent"))
        rest = left.join(state, list(keys)).filter(F.col(order) > F.col("_last")).withColumn("_room", F.col("_room") - F.col("_spent"))
        left = cut_lineage(rest.filter(F.col(cost) <= F.col("_room")).drop("_last", "_spent"))
    out = taken[0] if taken else items.limit(0)
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def raw_expansion(requests: DataFrame, budget: int = 4000, min_cost: int = 1) -> DataFrame:
    """Outcome of every raw span request of a session: kept, already_in_context or budget_exhausted.

    Rows are (session_id, pos, span, chars). Only the first request of a span can be kept; a span
    that did not fit never fits later.
    """
    first = requests.groupBy("session_id", "span").agg(F.min("pos").alias("pos"), F.min_by("chars", "pos").alias("chars"))
    kept = greedy_budget(first, ["session_id"], "pos", "chars", budget, min_cost).select("session_id", "span", F.col("pos").alias("kept_at"))
    outcome = (F.when(F.col("kept_at").isNull(), "budget_exhausted").when(F.col("kept_at") == F.col("pos"), "kept").otherwise("already_in_context"))
    return requests.join(kept, ["session_id", "span"], "left").select("session_id", "pos", "span", outcome.alias("outcome"))
