"""Queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, filter_audit, fingerprints, html_extract, license_scan, mixing, quality, suffix_dedup, token_files, url_filters, warc
from .near_dedup import near_duplicates


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(_t(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_t(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_t(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_t(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_t(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records, without the blocks themselves: their lengths and digests. No table holds crawled files: each page stands for a response of a server that sends UTF-8."""
    records = warc.derive(warc.responses(_t(spark, sf_dir, "pages")))
    return records.select(F.col("source_id").cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_payload_digest", "content_length", "block_digest", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_t(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(_t(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(conversation_trie.rebuilt(_t(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_mixing, op4_decontamination, op5_near_dedup, op6_url_filters, op7_suffix_dedup, op8_token_files, op9_warc, op10_html_extraction, op11_license_scan, op12_conversation_trie, op13_filter_audit, pipeline)}


def oracle_sql() -> dict:
    return {"op3_mixing": mixing.sql(), "op4_decontamination": decontaminate.SQL, "op6_url_filters": url_filters.sql(), "op12_conversation_trie": conversation_trie.SQL, "op13_filter_audit": filter_audit.SQL}
