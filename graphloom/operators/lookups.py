"""Batch forms of point lookups: a table of keys against a table of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import import_base, import_kind, with_endings
from .scale import first_per_key


def exact(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return table.join(keys.select(*on), list(on), "left_semi")


def outline(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of the wanted files; readers sort by start_line inside a file."""
    return exact(symbols, files.filter("file IS NOT NULL"), ["file"])


def protected(items: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Items whose path starts with a protected prefix.

    The prefixes of each distinct path become rows, so the test is an equality join.
    """
    p = F.col(path)
    starts = items.select(path).distinct().select(path, F.explode(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda n: p.substr(F.lit(1), n))).alias(prefix))
    hit = starts.join(prefixes.select(prefix).distinct(), prefix, "left_semi").select(path).distinct()
    return items.join(hit, path, "left_semi")


def section_for(sections: DataFrame, wanted: Column) -> DataFrame:
    """Section whose heading contains the wanted text, else the first one of the file."""
    hit = (wanted != "") & F.lower("heading").contains(F.lower(F.trim(wanted)))
    return first_per_key(sections.withColumn("_hit", hit), ["path"], [F.desc("_hit"), F.col("start_line")]).drop("_hit")


def resolve_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, specifier, resolved): the first candidate path that exists.

    Imports that name one path share its candidates, so only distinct paths are tried. Rows may repeat; they meet the
    resolved paths and lose their repeats in one shuffle, since an import's path follows from it.
    """
    asked = imports.select("importer", "specifier", import_base(F.col("importer"), F.col("specifier")).alias("_base"),
                           import_kind(F.col("importer")).alias("_kind")).filter("_base IS NOT NULL")
    tried = asked.select("_base", "_kind").distinct().select("_base", "_kind", F.posexplode(with_endings(F.col("_base"), F.col("_kind"))).alias("rank", "path"))
    found = tried.join(files.select("path"), "path").groupBy("_base", "_kind").agg(F.min_by("path", "rank").alias("resolved"))
    return asked.join(found, ["_base", "_kind"]).select("_base", "_kind", "importer", "specifier", "resolved").distinct().drop("_base", "_kind")
