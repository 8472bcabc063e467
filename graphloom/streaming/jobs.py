"""Structured Streaming jobs over append-only logs and change feeds.

Sources are directories that receive new files; every job runs with ``availableNow`` for replays and
tests and with a processing-time trigger in service. Results go to tables, never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import effective_tokens
from ..operators.outcomes import share, success_flag
from ..operators.scale import top_n


def json_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(query: StreamingQuery) -> None:
    """Wait until a replay has consumed everything there is."""
    query.awaitTermination()


def append_table(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_table(df: DataFrame, out: str, checkpoint: str, mode: str = "complete",
                  finish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Publish the full result of every batch."""
    def publish(batch: DataFrame, _: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(out)

    return df.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Idempotent ingest: an event id is accepted once within the watermark."""
    return (stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["event_id"]))


def daily_tokens(stream: DataFrame) -> DataFrame:
    """Events and tokens per day, updated as data arrives."""
    return (stream.groupBy(F.window(F.timestamp_millis("ts_ms"), "1 day").alias("w")).agg(
        F.count("*").alias("events"), F.sum(effective_tokens()).alias("tokens"))
        .select(F.unix_millis("w.start").alias("day_ms"), "events", "tokens"))


def last_changes(rows: DataFrame) -> DataFrame:
    """Last change of every path; removals stay as tombstones until the table is read."""
    return top_n(rows, ["path"], [F.desc("seq")], 1)


def expired_removals(keep: int) -> Callable[[DataFrame], DataFrame]:
    """Drop tombstones more than ``keep`` changes behind the newest one."""
    def forget(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max("seq").alias("_newest")).withColumn("_k", F.lit(1))
        known = rows.withColumn("_k", F.lit(1)).join(F.broadcast(newest), "_k")
        return known.filter((F.col("kind") != "remove") | (F.col("seq") > F.col("_newest") - keep)).select(*rows.columns)

    return forget


def live_files(table: DataFrame) -> DataFrame:
    return table.filter("kind <> 'remove'").select("path", "content")


def recent_patterns(rows: DataFrame, cap: int = 500) -> DataFrame:
    """The most recent patterns over all kinds."""
    return rows.orderBy(F.desc("last_ms"), F.col("hash")).limit(cap)


def patch_success(stream: DataFrame) -> DataFrame:
    return stream.groupBy("model_used").agg(F.count("*").alias("patches"), share(success_flag()).alias("success_rate"))


def newest_samples(rows: DataFrame, keep: int = 256) -> DataFrame:
    """Newest ``keep`` samples per operation."""
    return top_n(rows.select("operation", "latency_ms", "ts_ms", "event_id"), ["operation"], [F.desc("ts_ms"), F.desc("event_id")], keep)


def streamed_sessions(stream: DataFrame, gap: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Sessions per user, appended once the watermark has passed them: state holds the sessions of the last hours."""
    return (stream.withWatermark("event_time", delay).groupBy("user_id", F.session_window("event_time", gap).alias("w"))
            .agg(F.count("*").alias("events"), F.min("event_time").alias("first"), F.max("event_time").alias("last")))


def close_replay(rows: DataFrame, path: str, time: str = "event_time", after: str = "30 days") -> None:
    """End a replay of ``rows`` with one row far beyond them, so that the watermark passes all there is.

    Its other columns are null. What it opens stays open, so in append mode nothing of it comes out.
    """
    last = rows.agg((F.max(time) + F.expr(f"interval {after}")).alias(time)).filter(f"{time} IS NOT NULL")
    columns = [F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    last.select(*columns).write.mode("append").parquet(path)


def first_sent(refs: DataFrame) -> DataFrame:
    """Batch form of context reuse: a reference is fresh where the session sees it first."""
    first = refs.groupBy("session_id", "ref").agg(F.min("pos").alias("first_pos"))
    return refs.join(first, ["session_id", "ref"]).withColumn("fresh", F.col("pos") == F.col("first_pos")).drop("first_pos")


