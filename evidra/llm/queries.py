"""The contract queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_packing, op2_quality, op3_minhash, op4_mixing, op5_topk, op6_html, op7_line_dedup, op8_warc, op9_sharding, op10_quality_rules
from .common import pick, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_minhash.deduplicate(table(spark, sf_dir, "documents"), percent=85)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op6_html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return op7_line_dedup.deduplicate(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op8_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.round_trip(table(spark, sf_dir, "pages"))


def op9_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_sharding.place(pick(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "slot", "shard")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_minhash_dedup, op4_mixing_sources, op5_va_file_top_k, op6_html_extraction, op7_line_dedup_join, op8_warc_captures, op9_shard_lookup, op10_host_rules)}
