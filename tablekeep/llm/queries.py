"""The registered queries of the training-data operators, one per operator,
over whole tables with production parameters, and their DuckDB SQL where SQL
can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, heap_kmeans, kd_shards, line_dedup, lm_score, mixing, pu_quality, rules, simhash, suffix_dedup, token_counts, warc,
    whitening,
)
from .common import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return rules.apply_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes."""
    mix = mixing.mixture(load(spark, sf_dir, "documents"))
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fuzzy line dedup removes from every document."""
    return line_dedup.dedup_report(load(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document."""
    return suffix_dedup.dedup_substrings(load(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return pu_quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return token_counts.token_counts(load(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; target: labelled good."""
    targets = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score_documents(load(spark, sf_dir, "documents"), targets)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive, normalised and read back."""
    return (warc.round_trip(load(spark, sf_dir, "pages"), min_bytes=0)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return (simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return (decontam.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
            .select("doc_id", "item_id", "n_windows", "item_windows", "kind"))


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, 40 shards of near equal bytes."""
    return kd_shards.shard_report(load(spark, sf_dir, "documents"), 40)


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding of 64 components."""
    return heap_kmeans.cluster_report(load(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding."""
    return whitening.whitening_report(load(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_source_mixing, op3_line_dedup, op4_suffix_dedup, op5_pu_quality,
                                    op6_token_counts, op7_lm_scoring, op8_warc, op9_simhash, op10_decontamination, op11_kd_shards, op12_heap_clusters,
                                    op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.taken_sql(), "op8_warc": warc.ORACLE_SQL, "op12_heap_clusters": heap_kmeans.report_sql()}
