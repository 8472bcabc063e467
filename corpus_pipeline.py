"""Corpus pipeline: stages over ``documents``, each applying one training-data operator to all that is left.

``run(spark, sf_dir)`` writes every stage as Parquet in the cluster's shared folder and rereads it.

Defined results: null, empty and short texts fail the quality rules. Of equal or near texts one row stays, with the smallest
id, one without an id only where none has one; so no row repeats after that. Cutting repeats may leave a document empty; the
mix never takes one without words. An empty table, or one of which no document is good, gives no rows with the same columns.
Other columns go through unchanged.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from graphloom.llm import ngram_join, piece_codec, quality_cascade, source_mix, suffix_dedup  # noqa: E402
from graphloom.llm.common import read, stored  # noqa: E402


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule accepts."""
    return quality_cascade.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near or exact copies: five-word shingles, 0.8 or more."""
    return ngram_join.one_per_component(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without bytes covered by a 200-byte string that also starts elsewhere; ``n_chars`` follows."""
    return suffix_dedup.remove_repeats(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document taken twice is two rows."""
    return source_mix.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text, with all other columns."""
    return piece_codec.encode(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("source mix", mix_sources),
    ("piece ids", encode_pieces),
]

# SQL cannot express piece segmentation; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
