"""Source, sink and index maintenance queries."""

from pyspark.sql import functions as F

from .registry import query
from ..functions.code import lines_of
from ..functions.text import content_hash
from ..operators import events as ev, maintenance as mt
from ..session import cut_lineage, scratch_path
from ..sources import readers as rd, writers as wr


@query("a01_source_tree_scan", """SELECT source AS repo, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang <> 'es') GROUP BY 1""")
def _(t):
    root = scratch_path(t.spark, "tree")
    for lang, folder in (("es", "node_modules"), ("other", "src")):
        part = t.documents.filter(F.col("lang") == "es") if lang == "es" else t.documents.filter(F.col("lang") != "es")
        part.select("source", "text").write.partitionBy("source").option("lineSep", "\n").text(f"{root}/{folder}")
    scan = rd.indexable(rd.scan_tree(t.spark, root, ("txt",), whole=False))
    return scan.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("repo")).agg(
        F.count("*").alias("lines"), F.sum(F.length("content")).alias("chars"))


@query("a01_exclusions", """SELECT excluded, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p, '(^|/)(\\.venv|venv|env|__pycache__|site-packages|node_modules|target|dist|build|\\.cache|\\.git|\\.idea|\\.vscode|coverage|tmp)/')
  OR regexp_matches(p, '(\\.log|\\.lock|\\.min\\.js|\\.d\\.ts|\\.png|\\.pdf|\\.exe)$') THEN 'excluded' END AS excluded FROM (
  SELECT lower(CASE lang WHEN 'en' THEN 'node_modules/' WHEN 'fr' THEN 'src/Dist/' WHEN 'de' THEN 'distance/' ELSE '' END || path || CASE WHEN repo IN ('src1', 'src2') THEN '.LOCK' ELSE '' END) AS p FROM m_docs)) GROUP BY 1""")
def _(t):
    from ..functions.paths import is_excluded
    head = F.when(F.col("lang") == "en", "node_modules/").when(F.col("lang") == "fr", "src/Dist/").when(F.col("lang") == "de", "distance/").otherwise("")
    tail = F.when(F.col("repo").isin("src1", "src2"), ".LOCK").otherwise("")
    p = t.docs.select(F.concat(head, "path", tail).alias("path"))
    return p.groupBy(F.when(is_excluded(F.col("path")), "excluded").alias("excluded")).agg(F.count("*").alias("n"))


TARGETS = "tg AS (SELECT DISTINCT 'src/' || repo || '/en' AS target FROM m_docs WHERE repo > 'src3' UNION SELECT path FROM m_docs WHERE lang = 'fr' UNION SELECT DISTINCT 'src/' || repo || '/d' FROM m_docs)"


@query("a02_targeted_scan", f"WITH {TARGETS} SELECT path, n_chars FROM m_docs WHERE EXISTS (SELECT 1 FROM tg WHERE path = target OR starts_with(path, target || '/'))")
def _(t):
    d = t.docs
    targets = (d.filter("repo > 'src3'").select(F.concat(F.lit("src/"), "repo", F.lit("/en")).alias("target"))
               .union(d.filter("lang = 'fr'").select("path")).union(d.select(F.concat(F.lit("src/"), "repo", F.lit("/d")))))
    return rd.restrict_to(d.select("path", "n_chars"), targets)


@query("a03_content_checksum", "SELECT repo, count(*) AS files, count(DISTINCT content) AS distinct_contents FROM m_docs GROUP BY 1")
def _(t):
    return t.docs.withColumn("h", content_hash(F.col("content"))).groupBy("repo").agg(
        F.count("*").alias("files"), F.count_distinct("h").alias("distinct_contents"))


SNAP = """old AS (SELECT path, CASE WHEN lang = 'fr' THEN lower(content) ELSE content END AS content FROM m_docs WHERE repo <> 'src7'),
cur AS (SELECT path, content FROM m_docs WHERE repo <> 'src3'),
chg AS (SELECT path, CASE WHEN o.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN o.content = c.content THEN 'unchanged' ELSE 'changed' END AS change FROM old o FULL JOIN cur c USING (path))"""


def snapshot(t):
    old = t.docs.filter("repo <> 'src7'").withColumn("content", F.when(F.col("lang") == "fr", F.lower("content")).otherwise(F.col("content")))
    cur = t.docs.filter("repo <> 'src3'")
    pick = lambda df: df.select("path", "content", content_hash(F.col("content")).alias("checksum"))
    return pick(old), pick(cur)


@query("a04_change_classification", f"WITH {SNAP} SELECT * FROM chg")
def _(t):
    return mt.classify_changes(*snapshot(t))


def line_counts(df):
    return df.select("path", F.size(lines_of(F.col("content"))).alias("lines"), F.length("content").alias("chars"))


LC = "CAST(len(string_split(content, chr(10))) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INT) AS lines, CAST(length(content) AS INT) AS chars"


@query("a05_replace_by_key", f"WITH {SNAP} SELECT path, {LC} FROM cur")
def _(t):
    old, cur = snapshot(t)
    changes = mt.classify_changes(old, cur)
    touched = changes.filter("change <> 'unchanged'")
    fresh = cur.join(touched.filter("change <> 'deleted'"), "path", "left_semi")
    target = scratch_path(t.spark, "index")
    wr.overwrite_buckets(line_counts(old), target, buckets=8)
    # Second run over the same table: only buckets with a changed path are read, merged and replaced in place.
    hit = touched.select(wr.file_bucket(F.col("path"), 8).alias("bucket")).distinct()
    before = t.spark.read.parquet(target).join(hit, "bucket", "left_semi").drop("bucket")
    merged = cut_lineage(mt.replace_by_key(before, touched, line_counts(fresh), "path"))
    wr.overwrite_buckets(merged, target, buckets=8)
    return t.spark.read.parquet(target).drop("bucket")


@query("a06_delete_cascade", """WITH g AS (SELECT DISTINCT file FROM m_symbols WHERE file LIKE 'src/auth%')
SELECT 'symbols' AS tbl, count(*) AS n FROM m_symbols WHERE file NOT IN (SELECT file FROM g) UNION ALL SELECT 'calls', count(*) FROM m_calls WHERE file NOT IN (SELECT file FROM g)
UNION ALL SELECT 'modules', count(*) FROM m_modules WHERE file NOT IN (SELECT file FROM g) UNION ALL SELECT 'imports', count(*) FROM m_imports WHERE file NOT IN (SELECT file FROM g)""")
def _(t):
    gone = t.symbols.filter("file LIKE 'src/auth%'").select("file")
    left = mt.delete_cascade({"symbols": (t.symbols, "file"), "calls": (t.calls, "file"), "modules": (t.modules, "file"), "imports": (t.imports, "file")}, gone, "file")
    out = None
    for name, df in left.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("a07_upsert_counters", """SELECT operation AS kind, tool_name AS message, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS hits FROM m_telemetry GROUP BY 1, 2""")
def _(t):
    e = t.telemetry.select(F.col("operation").alias("kind"), F.col("tool_name").alias("message"), "ts_ms")
    cut = F.lit(1705276800000)
    out = mt.upsert_counters(mt.pattern_rows(e.filter(F.col("ts_ms") < cut)), mt.pattern_rows(e.filter(F.col("ts_ms") >= cut)))
    return out.drop("hash")


@query("a08_insert_or_ignore", "SELECT event_id, ts_ms, task_id FROM m_telemetry")
def _(t):
    e = t.telemetry.select("event_id", "ts_ms", "task_id")
    twice = e.unionByName(e.withColumns({"ts_ms": F.col("ts_ms") + 5, "task_id": F.lit("late")}))
    return ev.first_event_per_id(twice)


@query("a09_workspace_union", """SELECT CASE WHEN repo = 'src0' THEN path ELSE repo || '/' || path END AS path, lang FROM m_docs
UNION ALL SELECT 'tests/' || path, 'md' FROM m_notes""")
def _(t):
    rooted = rd.prefix_by_root(t.docs.select("repo", "path", "lang"), "repo", "src0", ["path"]).select("path", "lang")
    return rd.workspace_union(rooted, {"tests": t.notes.select("path", F.lit("md").alias("lang"))}, ["path"])


@query("a10_tolerant_json_log", "SELECT event_id, ts_ms, task_id, status FROM m_telemetry WHERE operation <> 'error'")
def _(t):
    path = scratch_path(t.spark, "log")
    line = F.when(F.col("operation") == "error", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", oops"))).otherwise(
        F.to_json(F.struct("event_id", "ts_ms", "task_id", "status")))
    t.telemetry.select(F.concat(line, F.when(F.col("event_id") % 9 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    return rd.read_json_log(t.spark, path, "event_id BIGINT, ts_ms BIGINT, task_id STRING, status STRING")


@query("a11_json_log_append", "SELECT patch_id, ts_ms, repository, model_used FROM m_patches")
def _(t):
    path = scratch_path(t.spark, "patches")
    cols = ["patch_id", "ts_ms", "repository", "target_symbol", "model_used", "edit_type", "approved_by_user", "validation_passed", "tests_passed", "rollback_occurred"]
    for batch in (t.patches.filter("edit_type = 'F'"), t.patches.filter("edit_type <> 'F'")):
        wr.append_json_log(batch.select(*cols), path)
    return rd.read_patches(t.spark, path).select("patch_id", "ts_ms", "repository", "model_used")


@query("a12_experiment_table", """SELECT o_orderkey AS timestamp, o_orderpriority AS provider, 's' || CAST(o_custkey AS STRING) AS symbol,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END AS tokens_without, o_orderkey + 1 AS tokens_with, CAST(o_custkey AS DOUBLE) / 4 AS savings_pct FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(t):
    path = scratch_path(t.spark, "experiments")
    s = lambda c: F.col(c).cast("string")
    full = t.orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("timestamp"), F.col("o_orderpriority").alias("provider"), F.concat(F.lit("s"), s("o_custkey")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "O", "n/a").otherwise(s("o_custkey")).alias("tokens_without"),
        (F.col("o_orderkey") + 1).alias("tokens_with"), (F.col("o_custkey") / 4).alias("savings_pct"))
    for part in (full.filter("timestamp % 3 = 0"), full.filter("timestamp % 3 <> 0")):  # two appends, each with its header
        wr.append_csv(part, path)
    t.orders.filter("o_orderpriority = '5-LOW'").select(F.concat_ws(",", s("o_orderkey"), "o_orderpriority").alias("value")).write.mode("append").text(path)
    return rd.read_experiments(t.spark, path)


RUN = f"""{SNAP}, st AS (SELECT change, m.path, n_chars % 97 AS ms, doc_id AS turn, CASE WHEN n_chars <= 9000 THEN NULL WHEN n_chars % 2 = 0 THEN 'read' ELSE 'parse' END AS failure, repo = 'src5' AS excluded FROM chg JOIN m_docs m USING (path))"""


def run_rows(t):
    changes = mt.classify_changes(*snapshot(t))
    failure = F.when(F.col("n_chars") > 9000, F.when(F.col("n_chars") % 2 == 0, "read").otherwise("parse"))
    return changes.join(t.docs.select("path", (F.col("n_chars") % 97).alias("ms"), F.col("doc_id").alias("at"), failure.alias("failure"), (F.col("repo") == "src5").alias("excluded")), "path")


@query("a13_ingest_statistics", f"""WITH {RUN} SELECT count(CASE WHEN ok AND change IN ('new', 'changed') THEN 1 END) AS indexed, count(CASE WHEN ok AND change = 'unchanged' THEN 1 END) AS skipped,
  count(CASE WHEN change = 'deleted' THEN 1 END) AS deleted, count(CASE WHEN excluded THEN 1 END) AS excluded, count(CASE WHEN failure = 'read' AND NOT excluded THEN 1 END) AS read_failed,
  count(CASE WHEN failure = 'parse' AND NOT excluded THEN 1 END) AS parse_failed, arg_max(CASE WHEN ok AND change IN ('new', 'changed') THEN ms END, CASE WHEN ok AND change IN ('new', 'changed') THEN turn END) AS last_ms,
  CAST(sum(CASE WHEN ok AND change IN ('new', 'changed') THEN ms END) AS BIGINT) AS total_ms, max(CASE WHEN ok AND change IN ('new', 'changed') THEN ms END) AS max_ms, round(avg(CASE WHEN ok AND change IN ('new', 'changed') THEN ms END), 6) AS avg_ms FROM (SELECT *, failure IS NULL AND NOT excluded AS ok FROM st)""")
def _(t):
    return mt.ingest_statistics(run_rows(t))


@query("a13_failing_paths", f"WITH {RUN} SELECT path FROM st WHERE failure IS NOT NULL AND NOT excluded ORDER BY path LIMIT 20")
def _(t):
    return mt.failing_paths(run_rows(t))


@query("a14_coverage_state", """
WITH tg AS (SELECT doc_id AS target_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CASE lang WHEN 'en' THEN 'src/' || repo || '/en/' WHEN 'fr' THEN regexp_replace(path, '\\.js$', '.tsx') WHEN 'de' THEN path || '.rb' ELSE 'nowhere/' || repo END END AS target FROM m_docs),
c AS (SELECT target_id, regexp_replace(target, '^/+|/+$', '', 'g') AS t FROM tg), k AS (SELECT *, contains(string_split(t, '/')[-1], '.') AS f FROM c)
SELECT target_id, CASE WHEN t IS NOT NULL AND f AND NOT regexp_matches(lower(t), '\\.(py|js|jsx|ts|tsx|rs)$') THEN 'unsupported_target' WHEN t IS NULL THEN 'indexed_repo'
  WHEN f AND EXISTS (SELECT 1 FROM m_docs WHERE path = t OR (regexp_matches(t, '\\.(ts|tsx|js|jsx)$') AND regexp_replace(path, '\\.(ts|tsx|js|jsx)$', '') = regexp_replace(t, '\\.(ts|tsx|js|jsx)$', '') AND regexp_matches(path, '\\.(ts|tsx|js|jsx)$'))) THEN 'indexed_target'
  WHEN NOT f AND EXISTS (SELECT 1 FROM m_docs WHERE starts_with(path, t || '/')) THEN 'indexed_target' ELSE 'unindexed_target' END AS state FROM k""")
def _(t):
    lang = F.col("lang")
    target = (F.when(lang == "en", F.concat(F.lit("src/"), "repo", F.lit("/en/"))).when(lang == "fr", F.regexp_replace("path", r"\.js$", ".tsx"))
              .when(lang == "de", F.concat("path", F.lit(".rb"))).otherwise(F.concat(F.lit("nowhere/"), "repo")))
    targets = t.docs.select(F.col("doc_id").alias("target_id"), F.when(F.col("doc_id") % 11 != 0, target).alias("target"))
    return mt.coverage_state(targets, t.docs)


@query("a15_index_delta", f"""WITH {SNAP}, ad AS (SELECT path FROM cur WHERE path NOT IN (SELECT path FROM old))
SELECT (SELECT count(*) FROM ad) AS added, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM ad WHERE NOT contains(path, '/de/') ORDER BY path LIMIT 8)) AS sample""")
def _(t):
    old, cur = snapshot(t)
    return mt.index_delta(old, cur, F.col("path").contains("/de/"))


@query("j08_deployments", "SELECT 'v' || CAST(o_orderkey AS STRING) AS version, o_orderpriority AS environment, CAST(floor(epoch_us(o_orderdate) / 1000) AS BIGINT) AS ts_ms FROM orders")
def _(t):
    path = scratch_path(t.spark, "deployments")
    rows = t.orders.select(
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"), F.col("o_orderpriority").alias("environment"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    wr.append_json_log(rows, path)
    return rd.read_deployments(t.spark, path).drop("config_hash")
