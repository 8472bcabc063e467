"""Streaming queries: the tables are replayed as streams, results equal their batch twins."""

from pyspark.sql import functions as F

from .registry import query
from .q_d_aggregates import OK, TOK
from .. import schemas
from ..operators import events as ev, maintenance as mt
from ..session import scratch_path
from ..sources.writers import write_in_order
from ..streaming import jobs, state
from ..streaming.keyed_table import KeyedTable


def telemetry_log(t, copies: int = 1) -> str:
    """The events as JSON lines in a folder, optionally written more than once."""
    path = scratch_path(t.spark, "events-log")
    cols = [c.split()[0] for c in schemas.TELEMETRY.split(", ") if not c.startswith("metadata")]
    for _ in range(copies):
        t.telemetry.select(*cols).write.mode("append").json(path)
    return path


@query("s01_idempotent_ingest", "SELECT event_id, ts_ms, task_id, status FROM m_telemetry")
def _(t):
    src = telemetry_log(t, copies=2)
    out, chk = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "chk")
    stream = jobs.distinct_events(jobs.json_stream(t.spark, src, schemas.TELEMETRY), "40 days")
    jobs.drain(jobs.append_table(stream.select("event_id", "ts_ms", "task_id", "status"), out, chk))
    return t.spark.read.schema("event_id BIGINT, ts_ms BIGINT, task_id STRING, status STRING").parquet(out)


@query("s02_daily_tokens", f"""SELECT CAST(floor(ts_ms / 86400000) AS BIGINT) * 86400000 AS day_ms, count(*) AS events, CAST(sum({TOK}) AS BIGINT) AS tokens FROM m_telemetry GROUP BY 1""")
def _(t):
    out = scratch_path(t.spark, "daily")
    stream = jobs.daily_tokens(jobs.json_stream(t.spark, telemetry_log(t), schemas.TELEMETRY))
    jobs.drain(jobs.replace_table(stream, out, scratch_path(t.spark, "chk")))
    return t.spark.read.parquet(out)


@query("s03_file_change_feed", "SELECT path, CASE WHEN lang = 'fr' THEN CAST(length(upper(content)) AS INT) ELSE CAST(length(content) AS INT) END AS chars FROM m_docs WHERE lang <> 'de'")
def _(t):
    src, table = scratch_path(t.spark, "feed"), scratch_path(t.spark, "files")
    row = lambda df, kind, seq, content: df.select("path", F.lit(kind).alias("kind"), F.lit(seq).cast("bigint").alias("seq"), content.alias("content"))
    d = t.docs
    for part in (row(d, "create", 1, F.col("content")), row(d.filter("lang = 'fr'"), "modify", 2, F.upper("content")),
                 row(d.filter("lang = 'de'"), "remove", 3, F.lit(None).cast("string"))):
        part.write.mode("append").parquet(src)
    feed = jobs.parquet_stream(t.spark, src, schemas.FILE_CHANGES, files_per_batch=8)
    files = KeyedTable(t.spark, table, schemas.FILE_CHANGES, ["path"], jobs.last_changes, jobs.expired_removals(1_000_000), fan_in=2)
    return jobs.live_files(files.run(feed, scratch_path(t.spark, "chk"))).select("path", F.length("content").alias("chars"))


PATTERN = "hash BIGINT, kind STRING, message STRING, first_ms BIGINT, last_ms BIGINT, hits BIGINT"


def patterns(t, cap):
    """Replay the events in order of time as error sightings; three micro-batches, two runs make one."""
    src, cols = scratch_path(t.spark, "sightings"), "kind STRING, message STRING, ts_ms BIGINT"
    write_in_order(t.telemetry.select(F.col("operation").alias("kind"), F.col("tool_name").alias("message"), "ts_ms"), src, "ts_ms", 3)
    table = KeyedTable(t.spark, scratch_path(t.spark, "patterns"), PATTERN, ["hash"], mt.merge_counters, fan_in=2)
    table.run(jobs.parquet_stream(t.spark, src, cols, files_per_batch=1), scratch_path(t.spark, "chk"), mt.pattern_rows)
    return jobs.recent_patterns(table.read(), cap).drop("hash")


COUNTED = "SELECT operation AS kind, tool_name AS message, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS hits FROM m_telemetry GROUP BY 1, 2"


@query("s04_error_counters", COUNTED)
def _(t):
    return patterns(t, 500)


@query("s04_recent_patterns", f"{COUNTED} ORDER BY last_ms DESC LIMIT 3")
def _(t):
    """The cap reached: the three most recent patterns over all kinds."""
    return patterns(t, 3)


REFS = """r AS (SELECT conv_id AS session_id, turn AS pos, CAST(length(text) % 5 AS STRING) AS ref, CAST(0 AS BIGINT) AS revision FROM {0})"""


SESSION_REFS = "session_id BIGINT, pos BIGINT, ts_ms BIGINT, ref STRING, revision BIGINT"


# Rows of a micro-batch when a table is replayed, on average.
BATCH_ROWS = 1 << 22


def reused(t, rows, size):
    """Replay (session_id, pos, ts_ms, ref, revision) in order of time, one file per micro-batch.

    Files follow ``size``, the number of rows, so that what a task sorts does not grow with the table.
    """
    src, out, chk = (scratch_path(t.spark, n) for n in ("refs", "reuse", "chk"))
    write_in_order(rows, src, "ts_ms", max(4, -(-size // BATCH_ROWS)))
    stream = state.reuse_context(jobs.parquet_stream(t.spark, src, SESSION_REFS, files_per_batch=1))
    jobs.drain(state.on_rocksdb(t.spark, lambda: jobs.append_table(stream, out, chk)))
    return t.spark.read.schema(state.SentRefs.OUT).parquet(out)


@query("s05_context_reuse", f"""WITH {REFS.format('conversations')} SELECT session_id, ref, count(*) AS sent, count(*) - 1 AS suppressed FROM r GROUP BY 1, 2""")
def _(t):
    done = reused(t, t.conversations.selectExpr("conv_id AS session_id", "turn AS pos", "(turn + 1) * 1000 AS ts_ms", "CAST(length(text) % 5 AS STRING) AS ref", "CAST(0 AS BIGINT) AS revision"), t.conversations.count())
    return done.groupBy("session_id", "ref").agg(F.count("*").alias("sent"), F.count_if(~F.col("fresh")).alias("suppressed"))


LIMITS = """SELECT DISTINCT l_suppkey % 100 AS session_id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS pos, (l_orderkey + 1) * 20000 AS ts_ms,
  CAST(l_partkey % 450 AS STRING) AS ref, CAST(floor(l_orderkey / 10000) AS BIGINT) AS revision FROM lineitem"""


@query("s05_session_limits", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM ({LIMITS})),
w AS (SELECT session_id, n, pos, ts_ms, revision, ref, true AS fresh, [ref] AS known FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.pos, o.ts_ms, o.revision, o.ref, NOT (same AND list_contains(old, o.ref)),
    CASE WHEN NOT same THEN [o.ref] WHEN list_contains(old, o.ref) THEN old ELSE list_append(old, o.ref)[-200:] END
  FROM (SELECT o.*, w.known AS old, o.revision = w.revision AND o.ts_ms - w.ts_ms <= 3600000 AS same FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1) o)
SELECT session_id, pos, ref, fresh FROM w""")
def _(t):
    """Sessions long enough to reach the cap of 200 references, with changes of revision and silences of over an hour."""
    key = "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS pos"
    return reused(t, t.lineitem.selectExpr("l_suppkey % 100 AS session_id", key, "(l_orderkey + 1) * 20000 AS ts_ms", "CAST(l_partkey % 450 AS STRING) AS ref",
                                           "CAST(floor(l_orderkey / 10000) AS BIGINT) AS revision").distinct(), t.lineitem.count())


@query("s05_context_reuse_batch", f"""WITH {REFS.format('conversations')} SELECT session_id, pos, ref, row_number() OVER (PARTITION BY session_id, ref ORDER BY pos) = 1 AS fresh FROM r""")
def _(t):
    refs = t.conversations.selectExpr("conv_id AS session_id", "turn AS pos", "CAST(length(text) % 5 AS STRING) AS ref")
    return jobs.first_sent(refs)


RAW = """r AS (SELECT l_suppkey AS session_id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS pos, CAST(l_partkey % 50 AS STRING) AS span, CAST(120 + (l_partkey % 50) * 37 AS BIGINT) AS chars FROM {0}),
q AS (SELECT session_id, span, min(pos) AS pos, min(chars) AS chars FROM r GROUP BY 1, 2)"""


@query("s06_raw_text_budget", f"""WITH RECURSIVE {RAW.format('lineitem')}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM q),
w AS (SELECT session_id, n, span, pos, CASE WHEN chars <= 4000 THEN chars ELSE 0 END AS used, chars <= 4000 AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.span, o.pos, w.used + CASE WHEN w.used + chars <= 4000 THEN chars ELSE 0 END, w.used + chars <= 4000 FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1)
SELECT r.session_id, r.pos, r.span, CASE WHEN NOT kept THEN 'budget_exhausted' WHEN w.pos = r.pos THEN 'kept' ELSE 'already_in_context' END AS outcome FROM (SELECT DISTINCT session_id, pos, span FROM r) r JOIN w USING (session_id, span)""")
def _(t):
    rows = t.lineitem.selectExpr("l_suppkey AS session_id", "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS pos",
                                 "CAST(l_partkey % 50 AS STRING) AS span", "CAST(120 + (l_partkey % 50) * 37 AS BIGINT) AS chars").distinct()
    return mt.raw_expansion(rows, 4000, 120)


@query("s06_raw_text_budget_stream", """WITH RECURSIVE o AS (SELECT conv_id AS session_id, turn AS pos, CAST(length(text) % 7 AS STRING) AS span, CAST(length(text) AS BIGINT) AS chars, turn >= 3 AS rev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
w AS (SELECT session_id, n, pos, span, rev, CASE WHEN chars <= 4000 THEN 'kept' ELSE 'budget_exhausted' END AS outcome, CASE WHEN chars <= 4000 THEN chars ELSE 0 END AS used,
    CASE WHEN chars <= 4000 THEN [span] ELSE list_value(span)[2:] END AS known FROM o WHERE n = 1
  UNION ALL SELECT session_id, n, pos, span, rev, CASE WHEN seen THEN 'already_in_context' WHEN base + chars <= 4000 THEN 'kept' ELSE 'budget_exhausted' END,
    CASE WHEN seen OR base + chars > 4000 THEN base ELSE base + chars END, CASE WHEN seen OR base + chars > 4000 THEN old ELSE list_append(old, span) END
  FROM (SELECT o.*, CASE WHEN o.rev = w.rev THEN w.used ELSE 0 END AS base, CASE WHEN o.rev = w.rev THEN w.known ELSE w.known[1:0] END AS old,
      o.rev = w.rev AND list_contains(w.known, o.span) AS seen FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1))
SELECT session_id, pos, span, outcome FROM w""")
def _(t):
    src, out, chk = (scratch_path(t.spark, n) for n in ("spans", "raw", "chk"))
    write_in_order(t.conversations.selectExpr("conv_id AS session_id", "turn AS pos", "(turn + 1) * 1000 AS ts_ms", "CAST(length(text) % 7 AS STRING) AS span", "CAST(length(text) AS BIGINT) AS chars",
                                              "CAST(turn >= 3 AS BIGINT) AS revision"), src, "ts_ms", 4)
    stream = state.limit_raw_text(jobs.parquet_stream(t.spark, src, "session_id BIGINT, pos BIGINT, ts_ms BIGINT, span STRING, chars BIGINT, revision BIGINT", files_per_batch=1))
    jobs.drain(state.on_rocksdb(t.spark, lambda: jobs.append_table(stream, out, chk)))
    return t.spark.read.schema(state.ShownSpans.OUT).parquet(out)


@query("s07_patch_success", f"SELECT model_used, count(*) AS patches, round(avg(CAST({OK} AS DOUBLE)), 6) AS success_rate FROM m_patches GROUP BY 1")
def _(t):
    src, out = scratch_path(t.spark, "patch-log"), scratch_path(t.spark, "patch-stats")
    t.patches.drop("cost").write.json(src)
    jobs.drain(jobs.replace_table(jobs.patch_success(jobs.json_stream(t.spark, src, schemas.PATCHES)), out, scratch_path(t.spark, "chk")))
    return t.spark.read.parquet(out)


@query("s08_session_activity", """
WITH f AS (SELECT user_id, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT user_id, count(*) AS events, min(ms) AS first_ms, max(ms) - min(ms) AS duration_ms FROM g GROUP BY user_id, sid""")
def _(t):
    return ev.session_activity(t.telemetry)


@query("s08_session_windows", """
WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM f), k AS (SELECT user_id, sid, count(*) AS events FROM g GROUP BY 1, 2)
SELECT user_id, events FROM k""")
def _(t):
    src, out, chk = (scratch_path(t.spark, n) for n in ("activity", "sessions", "chk"))
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("event_time"))
    write_in_order(rows, src, "event_time", 4)
    jobs.close_replay(rows, src)
    stream = jobs.streamed_sessions(jobs.parquet_stream(t.spark, src, "user_id BIGINT, event_time TIMESTAMP", files_per_batch=1))
    jobs.drain(jobs.append_table(stream.select("user_id", "events"), out, chk))
    return t.spark.read.schema("user_id BIGINT, events BIGINT").parquet(out)


@query("s09_latency_ring", """SELECT operation, latency_ms, ts_ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts_ms DESC, event_id DESC) AS r FROM m_telemetry) WHERE r <= 256""")
def _(t):
    src, cols = scratch_path(t.spark, "latencies"), "operation STRING, latency_ms BIGINT, ts_ms BIGINT, event_id BIGINT"
    write_in_order(t.telemetry.select("operation", "latency_ms", "ts_ms", "event_id"), src, "ts_ms", 3)
    table = KeyedTable(t.spark, scratch_path(t.spark, "ring"), cols, ["operation"], jobs.newest_samples, fan_in=2)
    return table.run(jobs.parquet_stream(t.spark, src, cols, files_per_batch=1), scratch_path(t.spark, "chk"))
