"""Sinks: JSON line and CSV appends and partition-wise replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def append_json_log(df: DataFrame, path: str) -> None:
    """One row, one line."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def file_bucket(path: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def overwrite_buckets(df: DataFrame, target: str, path: str = "path", buckets: int = 256) -> None:
    """Replace only the file buckets that occur in ``df``; all rows of such a bucket must be in it."""
    rows = df.withColumn("bucket", file_bucket(F.col(path), buckets))
    (rows.repartition("bucket", F.pmod(F.hash(path), F.lit(16))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target))


def write_in_order(df: DataFrame, path: str, order: str, files: int) -> None:
    """Append ``df`` as about ``files`` Parquet files that a file stream reads in ascending ``order``.

    Ranges are written in parallel; a stream takes files by modification time, which is set afterwards.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    known = {f.getPath().getName() for f in store.listStatus(place)} if store.exists(place) else set()
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("append").parquet(path)
    added = [f for f in store.listStatus(place) if f.getPath().getName() not in known and f.getPath().getName().startswith("part-")]
    added.sort(key=lambda f: f.getPath().getName())
    start = max((f.getModificationTime() for f in added), default=0)
    for i, f in enumerate(added):
        store.setTimes(f.getPath(), start + i, -1)
