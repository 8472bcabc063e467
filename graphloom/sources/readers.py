"""Readers: source trees, workspaces, tolerant JSON lines and experiment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.paths import LANGUAGES, is_excluded
from ..operators.scale import ancestors


def relative_path(full: Column, root: str) -> Column:
    """Path below ``root`` of a file URI."""
    bare = F.regexp_replace(full, "^[a-z0-9]+:/+", "/")
    base = root.rstrip("/") if "://" not in root else "/" + root.split("://", 1)[1].split("/", 1)[1].rstrip("/")
    return F.regexp_replace(bare, F.lit("^" + base.replace(".", r"\.") + "/"), F.lit(""))


def scan_tree(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(LANGUAGES), whole: bool = True) -> DataFrame:
    """Files below ``root`` with their content and why they are left out: (path, content, excluded).

    ``whole`` gives one row per file, otherwise one per line; large trees list and read in parallel.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    files = reader.text(root, wholetext=True) if whole else reader.text(root, lineSep="\n")
    rows = files.select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(is_excluded(F.col("path")), "excluded").when(~ext.isin(*extensions), "unsupported")
    return rows.withColumn("excluded", reason)


def indexable(scan: DataFrame) -> DataFrame:
    return scan.filter("excluded IS NULL").drop("excluded")


def restrict_to(files: DataFrame, targets: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """Files equal to or below one of the targets, each once; prefixes become equality keys."""
    wanted = targets.select(F.regexp_replace(target, "/+$", "").alias("_a")).distinct()
    hit = files.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("_a")).join(wanted, "_a", "left_semi")
    return files.join(hit.select(path).distinct(), path, "left_semi").dropDuplicates([path])


def workspace_union(primary: DataFrame, others: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """One table from several roots; paths of all but the primary root get the root's name in front."""
    out = primary
    for name, df in others.items():
        out = out.unionByName(df.withColumns({c: F.concat(F.lit(f"{name}/"), F.col(c)) for c in columns}))
    return out


def prefix_by_root(files: DataFrame, root: str, primary: str, columns: Sequence[str]) -> DataFrame:
    """Same for a table that already names the root of each row."""
    return files.withColumns({c: F.when(F.col(root) == primary, F.col(c)).otherwise(F.concat_ws("/", F.col(root), F.col(c))) for c in columns})


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; blank and malformed lines are skipped."""
    df = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.filter(F.col("_bad").isNull()).drop("_bad")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return read_json_log(spark, path, schemas.PATCHES)


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return read_json_log(spark, path, schemas.KNOWLEDGE)


def read_deployments(spark: SparkSession, path: str) -> DataFrame:
    return read_json_log(spark, path, schemas.DEPLOYMENTS)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment rows; lines with fewer than six fields are skipped, bad numbers count as zero."""
    raw = spark.read.option("lineSep", "\n").text(path)
    parts = F.split("value", ",")
    rows = raw.filter((F.size(parts) >= 6) & ~F.col("value").startswith("timestamp,")).select(parts.alias("p"))
    number = lambda i, t: F.coalesce(F.col("p")[i].try_cast(t), F.lit(0).cast(t))
    return rows.select(number(0, "bigint").alias("timestamp"), F.col("p")[1].alias("provider"), F.col("p")[2].alias("symbol"),
                       number(3, "bigint").alias("tokens_without"), number(4, "bigint").alias("tokens_with"), number(5, "double").alias("savings_pct"))
