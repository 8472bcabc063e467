"""Rows are told apart although their ids and short hashes agree; archives are read by many tasks from qualified paths."""

from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import suffix_dedup, warc_shards

PAGES = "page_id long, url string, html string"


def test_rows_whose_short_hashes_agree(spark):
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(7)])
    texts = spark.range(300_000).select(text.alias("text")).withColumn("h", F.hash("text"))
    twins = texts.join(texts.groupBy("h").count().filter("count > 1"), "h").select("text").collect()
    assert len(twins) > 2
    rows = [(None, r.text) for r in twins] + [(1, "x" * 10)]
    out = suffix_dedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in out.collect()] == [0] * len(rows)


def test_repeated_rows_are_removed_whole(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300)) + "end"
    rows = [(None, text)] * 3 + [(None, text[:100])]
    out = suffix_dedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.n_removed for r in out.collect()) == {303: 3, 0: 1}


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, '</p>') AS html")
    target = warc_shards.qualified(spark, str(tmp_path / "w"))
    assert target.startswith("file:///")
    read = warc_shards.read_archives(target, warc_shards.write_archives(pages, target))
    tasks = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r[1] for r in tasks) == 4000


def test_qualified_keeps_schemes(spark, tmp_path):
    assert warc_shards.qualified(spark, f"file://{tmp_path}/w") == f"file://{tmp_path}/w" == warc_shards.qualified(spark, f"{tmp_path}/w")
