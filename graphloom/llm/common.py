"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, scratch_path

# Word separators: space, tab, line feed, vertical tab, form feed, carriage return. bytes.split() uses the same six.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, so that none clashes with a working column, and the new names of ``names``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once everything that reads it has itself been stored."""
    files = df.inputFiles()
    if files:
        discard(df.sparkSession, files[0].rpartition("/")[0])


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _bitmap(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """(_bk, _bm): bitmaps as lists of 32-bit numbers, the first byte highest; a bit of them is read without a copy."""
    slot = _slot(F.col(key), bits)
    rows = ids.select(slot.alias("_s")).groupBy(F.expr("bitmap_bucket_number(_s)").alias("_bk")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_s))").alias("_bytes"))
    return rows.select("_bk", F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(_bytes, i * 4 + 1, 4)), 16, 10) as bigint))").alias("_bm"))


def mark_possible(df: DataFrame, key: str, ids: DataFrame, flag: str, bits: int = 1 << 23) -> DataFrame:
    """Add ``flag``: false where the row's key is surely not among the keys of ``ids``.

    The keys become one bit each in a bitmap of ``bits`` bits, so what is broadcast never exceeds
    ``bits / 8`` bytes (1 MB by default) however many keys there are. It only saves work: rows that
    pass are still joined exactly, and a full bitmap lets all of them pass.
    """
    where = _slot(F.col(key), bits)
    out = df.withColumn("_s", where).withColumn("_bk", F.expr("bitmap_bucket_number(_s)"))
    out = out.join(F.broadcast(_bitmap(ids, key, bits)), "_bk", "left")
    at = F.expr("bitmap_bit_position(_s)").cast("int")
    word, bit = F.get("_bm", F.floor(at / 32).cast("int")), 24 - F.floor(at % 32 / 8).cast("int") * 8 + at % 8
    return out.withColumn(flag, F.coalesce(F.getbit(word, bit) == 1, F.lit(False))).drop("_s", "_bk", "_bm")


def possible(df: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose key may be among the keys of ``ids``; see ``mark_possible``."""
    return mark_possible(df, key, ids, "_maybe", bits).filter("_maybe").drop("_maybe")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (null keys stay); only rows in doubt are shuffled."""
    marked = mark_possible(df, key, ids, "_maybe")
    doubt = marked.filter("_maybe").drop("_maybe").join(ids.select(key).distinct(), key, "left_anti")
    return marked.filter("NOT _maybe").drop("_maybe").select(*df.columns).unionByName(doubt.select(*df.columns))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``_k``: the id together with a 64-bit hash of the text, which tells rows with the same id apart."""
    return docs.withColumn("_k", F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("t")))


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive rows into runs of at most ``limit`` in total; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
