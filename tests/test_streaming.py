"""Session state and keyed tables across micro-batches, stops and replays."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import maintenance as mt
from graphloom.sources.writers import write_in_order
from graphloom.streaming import jobs, state
from graphloom.streaming.keyed_table import KeyedTable, Run

REFS = "session_id bigint, pos bigint, ts_ms bigint, ref string, revision bigint"


def judged(rows):
    """What a session knows, by its rules."""
    out, known = [], {}
    for session, pos, ts, ref, revision in sorted(rows, key=lambda r: (r[0], r[1])):
        last, rev, order = known.get(session, (None, None, []))
        if last is not None and (revision != rev or ts - last > state.TTL_SECONDS * 1000):
            order = []
        fresh = ref not in order
        if fresh:
            order = (order + [ref])[-state.MAX_REFS:]
        known[session] = (ts, revision, order)
        out.append((session, pos, ref, fresh))
    return sorted(out)


def log(sessions, length, refs, seed=1):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        ts = 10_000_000
        for pos in range(length):
            ts += rng.choice([1000, 5000, 60_000]) if rng.random() > 0.01 else 3_700_000
            rows.append((s, pos, ts, str(rng.randrange(refs)), pos // (length * 2 // 3)))
    return rows


def replay(spark, place, files_per_batch=1):
    stream = state.reuse_context(jobs.parquet_stream(spark, f"{place}/in", REFS, files_per_batch))
    query = state.on_rocksdb(spark, lambda: jobs.append_table(stream, f"{place}/out", f"{place}/chk"))
    jobs.drain(query)
    return query, spark.read.schema(state.SentRefs.OUT).parquet(f"{place}/out")


def test_sessions_reach_cap_revision_and_timeout_across_stops(spark, tmp_path):
    rows = log(3, 900, 230)
    want = judged(rows)
    # The data reaches what it should: without cap, revision or timeout the answer differs.
    gaps = [b[2] - a[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
    assert max(gaps) > 3_600_000 and len({r[4] for r in rows}) == 2
    assert any(len(set(r[3] for r in rows[i:i + 900 * 2 // 3])) > state.MAX_REFS for i in (0, 900, 1800))
    cut = sorted(r[2] for r in rows)[len(rows) // 2]
    for part in ([r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut]):  # the job stops in between
        write_in_order(spark.createDataFrame(part, REFS), f"{tmp_path}/in", "ts_ms", 3)
        _, out = replay(spark, tmp_path)
    assert sorted(map(tuple, out.collect())) == want
    _, again = replay(spark, tmp_path)  # nothing new
    assert again.count() == len(want)


def test_silent_sessions_leave_the_store(spark, tmp_path):
    """Timers remove sessions the watermark has left behind; the store holds the last hours only."""
    rows = [(s, 0, 10_000_000 + s * 600_000, "a", 0) for s in range(60)]  # one new session every ten minutes
    write_in_order(spark.createDataFrame(rows, REFS), f"{tmp_path}/in", "ts_ms", 6)
    query, out = replay(spark, tmp_path)
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert out.count() == 60 and out.filter("fresh").count() == 60
    per_session = 4  # last, revision, one reference, one timer (entries)
    assert max(kept) < 60 * per_session and kept[-1] <= 30 * per_session


def test_raw_budget_goes_on_across_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, session = [], state.RawBudget(budget=4000)
    for pos in range(400):
        rows.append((1, pos, 1_000_000 + pos, f"s{rng.randrange(300)}", rng.randrange(20, 60), pos // 250))
    want = [(1, r[1], r[3], session.request(r[3], r[4], r[5])) for r in rows]
    schema = "session_id bigint, pos bigint, ts_ms bigint, span string, chars bigint, revision bigint"
    write_in_order(spark.createDataFrame(rows, schema), f"{tmp_path}/in", "ts_ms", 5)
    stream = state.limit_raw_text(jobs.parquet_stream(spark, f"{tmp_path}/in", schema, 1))
    jobs.drain(state.on_rocksdb(spark, lambda: jobs.append_table(stream, f"{tmp_path}/out", f"{tmp_path}/chk")))
    assert sorted(map(tuple, spark.read.schema(state.ShownSpans.OUT).parquet(f"{tmp_path}/out").collect())) == want
    assert {w[3] for w in want} == {"kept", "already_in_context", "budget_exhausted"}


CHANGES = "path string, kind string, seq bigint, content string"


def changes_table(spark, root, keep=1_000_000):
    return KeyedTable(spark, root, CHANGES, ["path"], jobs.last_changes, jobs.expired_removals(keep), fan_in=3, buckets=4)


def test_keyed_table_equals_plain_dictionary(spark, tmp_path):
    """Every batch through a new object, as after a restart; replays and a torn write change nothing."""
    rng, files, seq, root = random.Random(5), {}, 0, str(tmp_path / "t")
    for batch in range(14):
        rows = []
        for _ in range(rng.randint(0, 30)):
            seq += 1
            path, kind = f"p{rng.randrange(40)}", rng.choice(["create", "modify", "remove"])
            rows.append((path, kind, seq, None if kind == "remove" else f"c{seq}"))
            files[path] = rows[-1]
        df = spark.createDataFrame(rows, CHANGES)
        if batch == 6:  # a run without its marker, as after a crash
            spark.createDataFrame([("p1", "create", 10**9, "torn")], CHANGES).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/run-0-6-6")
            (tmp_path / "t" / "run-0-6-6" / "_SUCCESS").unlink()
        changes_table(spark, root).append(df, batch)
        if batch % 4 == 1:
            changes_table(spark, root).append(df, batch)
    table = changes_table(spark, root)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(files.values(), key=str)
    assert sorted(map(tuple, jobs.live_files(table.read()).collect())) == sorted((p, r[3]) for p, r in files.items() if r[1] != "remove")
    some = spark.createDataFrame([("p3",), ("p7",), ("none",)], "path string")
    few = table.read(some)
    assert sorted(map(tuple, few.collect()), key=str) == sorted((files[p] for p in ("p3", "p7") if p in files), key=str)
    assert len(few.inputFiles()) <= len(table.read().inputFiles())
    # 14 batches with three runs to a merged one: 9 + 3 + 1 + 1
    assert [(r.level, r.first, r.last) for r in table.runs()] == [(2, 0, 8), (1, 9, 11), (0, 12, 12), (0, 13, 13)]


def test_batches_write_what_they_bring(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.range(20000).selectExpr("concat('p', id) AS path", "'create' AS kind", "id AS seq", "uuid() AS content")
    changes_table(spark, root).append(first, 0)
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / "t" / name).rglob("*.parquet"))
    changes_table(spark, root).append(spark.createDataFrame([("p1", "modify", 10**6, "new")], CHANGES), 1)
    assert size("run-0-1-1") < size("run-0-0-0") / 100
    assert changes_table(spark, root).read().count() == 20000


def test_removals_are_forgotten_with_the_oldest_run(spark, tmp_path):
    table = changes_table(spark, str(tmp_path / "t"), keep=2)
    for i, row in enumerate([("a", "create", 1, "x"), ("a", "remove", 2, None), ("b", "create", 9, "y")]):
        table.append(spark.createDataFrame([row], CHANGES), i)
    assert [tuple(r) for r in table.read().collect()] == [("b", "create", 9, "y")]
    assert table.runs() == [Run(1, 0, 2)]


def test_counters_and_samples_merge_in_any_grouping(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), f"m{rng.randrange(5)}", i) for i in range(300)]
    schema = "hash bigint, kind string, message string, first_ms bigint, last_ms bigint, hits bigint"
    got = []
    for fan_in, step in ((2, 40), (50, 40), (2, 300)):
        table = KeyedTable(spark, str(tmp_path / f"t{fan_in}-{step}"), schema, ["hash"], mt.merge_counters, fan_in=fan_in)
        for n, at in enumerate(range(0, 300, step)):
            table.append(mt.pattern_rows(spark.createDataFrame(rows[at:at + step], "kind string, message string, ts_ms bigint")), n)
        got.append(sorted(map(tuple, table.read().collect())))
    assert got[0] == got[1] == got[2] and sum(r[5] for r in got[0]) == 300
    recent = jobs.recent_patterns(table.read(), 3).collect()
    assert [r.last_ms for r in recent] == sorted((r[4] for r in got[0]), reverse=True)[:3]


@pytest.mark.parametrize("files", [1, 4])
def test_files_are_read_in_order(spark, tmp_path, files):
    write_in_order(spark.range(100).selectExpr("100 - id AS k"), f"{tmp_path}/in", "k", files)
    write_in_order(spark.range(100).selectExpr("1000 + id AS k"), f"{tmp_path}/in", "k", files)
    seen = []
    stream = jobs.parquet_stream(spark, f"{tmp_path}/in", "k bigint", 1)
    jobs.drain(stream.writeStream.foreachBatch(lambda b, _: seen.append(tuple(b.agg(F.min("k"), F.max("k")).first()))).trigger(availableNow=True).start())
    seen = [s for s in seen if s[0] is not None]
    assert len(seen) == 2 * files and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_sessions_are_appended_and_leave_the_state(spark, tmp_path):
    rows = spark.range(240).selectExpr("id % 3 AS user_id", "timestamp_seconds(1000000 + id * 600 + (id div 60) * 20000) AS event_time")
    write_in_order(rows, f"{tmp_path}/in", "event_time", 4)
    jobs.close_replay(rows, f"{tmp_path}/in")
    stream = jobs.streamed_sessions(jobs.parquet_stream(spark, f"{tmp_path}/in", "user_id bigint, event_time timestamp", 1))
    query = jobs.append_table(stream.select("user_id", "events"), f"{tmp_path}/out", f"{tmp_path}/chk")
    jobs.drain(query)
    out = spark.read.schema("user_id bigint, events bigint").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == sorted((u, 20) for u in range(3) for _ in range(4))
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert kept[-1] == 1 and max(kept) <= 7  # never all twelve sessions
