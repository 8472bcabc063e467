"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (checks, credential_links, exact_whitening, html_graph, lattice_neighbours, merkle_manifest, ngram_join, paragraph_dedup, piece_codec, quality_cascade, source_mix,
               suffix_dedup, toxic_cnn, warc_shards)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    if sql := getattr(checks, fn.__name__.upper(), None):
        CHECKS[fn.__name__] = sql
    return fn


@query
def op1_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_dedup.removable(read(spark, folder, "documents"))


@query
def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mixed_sizes(read(spark, folder, "documents"))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_cnn.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_shards.round_trip(read(spark, folder, "pages"))


@query
def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encode(read(spark, folder, "documents").select("doc_id", "text"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, folder, "documents"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cascade.judge(read(spark, folder, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_digest(read(spark, folder, "documents"))


@query
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_graph.extract(read(spark, folder, "pages"))


@query
def op10_lattice_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_neighbours.near_duplicates(read(spark, folder, "embeddings"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.audit(read(spark, folder, "documents"))


@query
def op12_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return credential_links.digests(read(spark, folder, "documents"))


@query
def op13_exact_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return exact_whitening.whiten(read(spark, folder, "embeddings"))
