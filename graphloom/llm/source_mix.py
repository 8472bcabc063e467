"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source shares the token budget by weight, up to ``epochs`` times its own size; what a small source
cannot take is shared again by weight among the others. Within a source documents queue in a shuffled
order that depends on their ids alone, epoch after epoch. A document's virtual finish time is the number of
the source's tokens up to and including it divided by the source's target. All sources are then sorted by
finish time and taken until the budget is reached, so sources stay in proportion at every point.

Running totals are made of bucket totals and totals inside a bucket. A bucket is a slice of the shuffled
order (or of the finish times), of which there are so many that a third of all rows in one source is no
burden for a task. What the mix takes of a source is a prefix of its queue, so one row per source, the
last place taken, decides for every document; texts are never shuffled.

Defined results: a null text has size 0, as a text without words, and size 0 is never taken. A null source
is a source of its own, the last in order. Rows of a source with the same id and size have one place in the
queue and are taken together; null ids are told apart by size alone. A budget above what all sources can
give takes everything ``epochs`` times. No rows, no result. Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import NOT_SPACE, stored

WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, epochs: int = 2) -> DataFrame:
    """(source_id, source_size, target, budget) from (source_id, source, size): one row per source.

    In the order of limit per weight, the level that an equal share would reach rises while sources fit
    below it and falls after the first that does not, so its maximum is the level at which the rest share.
    """
    per = sizes.groupBy("source_id", "source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    rising = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    per = per.withColumns({
        "budget": F.sum("source_size").over(W.partitionBy()) * F.lit(float(percent)) / F.lit(100.0),
        "filled": F.coalesce(F.sum("limit").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)),
    })
    per = per.withColumn("level", F.max((F.col("budget") - F.col("filled")) / F.col("open")).over(W.partitionBy()))
    target = F.least("limit", F.col("w") * F.col("level"))
    return per.select("source_id", "source_size", target.alias("target"), "budget")


def place(key: str, epoch: int, seed: str) -> Column:
    """A document's place in its source's queue in the given epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), F.coalesce(F.col(key).cast("string"), F.lit("-")), F.col("size").cast("string")))


def last_places(sizes: DataFrame, targets: DataFrame, key: str, epochs: int, seed: str, width: int = 3, cuts: int = 4096) -> DataFrame:
    """(source_id, last_epoch, last_rank): the last place of each queue that the mix takes."""
    rows = sizes.filter("size > 0").groupBy("source_id", key, "size").agg(F.count("*").alias("copies"))
    entries = F.array(*[F.struct(F.lit(e).alias("epoch"), place(key, e, seed).alias("rank")) for e in range(epochs)])
    rows = rows.select("source_id", (F.col("size") * F.col("copies")).alias("size"), F.explode(entries).alias("e")).select("source_id", "size", "e.*")
    rows = rows.withColumn("slice", F.substring("rank", 1, width))
    parts = ["source_id", "epoch", "slice"]
    before = W.partitionBy("source_id").orderBy("epoch", "slice").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy(*parts).agg(F.sum("size").alias("total")).select(*parts, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carry"))
    inside = W.partitionBy(*parts).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(carry, parts).join(targets, "source_id")
    rows = rows.withColumn("finish", (F.col("upto") + F.col("carry")) / F.col("target"))
    # The global order: slices of finish times are added up, and the budget ends inside one of them.
    cut = F.when(F.col("finish") < 2, F.floor(F.col("finish") * cuts)).otherwise(2 * cuts + F.floor(F.log2("finish") * 64))
    rows = stored(rows.select("source_id", "size", "epoch", "rank", "finish", cut.alias("cut"), "budget"), "queue")
    sums = rows.groupBy("cut").agg(F.sum("size").alias("total"), F.max("budget").alias("budget"))
    sums = sums.withColumn("end", F.sum("total").over(W.orderBy("cut").rowsBetween(W.unboundedPreceding, 0)))
    sums = sums.select("cut", (F.col("end") - F.col("total")).alias("start"), "end")
    rows = rows.join(F.broadcast(sums), "cut").filter("start <= budget")  # at most 2 * cuts + 64 * 64 rows
    edge = W.partitionBy("cut").orderBy("finish", "source_id", "epoch", "rank").rowsBetween(W.unboundedPreceding, 0)
    last = rows.filter("end > budget").withColumn("sum", F.col("start") + F.sum("size").over(edge)).filter("sum <= budget").drop("sum")
    taken = rows.filter("end <= budget").unionByName(last)
    return taken.groupBy("source_id").agg(F.max(F.struct("epoch", "rank")).alias("last")).select(
        "source_id", F.col("last.epoch").alias("last_epoch"), F.col("last.rank").alias("last_rank"))


def _sized(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.withColumns({"size": size_of(F.col(text)), "source_id": F.xxhash64(F.col(source), F.col(source).isNull())})


def _plan(docs: DataFrame, key: str, source: str, text: str, weights: Sequence[int], percent: int, epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(key, source_id, source, size) of all documents, and one row per source with target and last place."""
    narrow = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sizes = stored(_sized(narrow, "source", "text").select("id", "source_id", "source", "size"), "sizes")
    targets = stored(source_targets(sizes, weights, percent, epochs), "targets")
    return sizes, stored(targets.join(last_places(sizes, targets, "id", epochs, seed), "source_id", "left"), "places")


def _times(key: str, epochs: int, seed: str) -> Column:
    """How often the mix takes a document: once for every epoch in which its place is not after the last one."""
    hits = [F.struct(F.lit(e), place(key, e, seed)) <= F.struct("last_epoch", "last_rank") for e in range(epochs)]
    each = sum((F.when((F.col("size") > 0) & F.col("last_rank").isNotNull() & h, 1).otherwise(0) for h in hits), F.lit(0))
    return each


def mixed_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS,
                percent: int = 150, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(key, size, source_size, target, taken) of every document."""
    sizes, places = _plan(docs, key, source, text, weights, percent, epochs, seed)
    return sizes.join(places, "source_id").select(
        F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * _times("id", epochs, seed)).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS,
                    percent: int = 150, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they are."""
    _, places = _plan(docs, key, source, text, weights, percent, epochs, seed)
    narrow = docs.select(F.struct("*").alias("_row"), F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = _sized(narrow, "source", "text").join(places, "source_id").withColumn("times", _times("id", epochs, seed))
    return rows.filter("times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
