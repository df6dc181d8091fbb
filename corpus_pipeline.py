"""A training corpus from raw documents: quality, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns (mixing adds weight, which the token files keep); the last returns, from the files it wrote, each
document's place and checksum. Stages are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm import decontaminate, mixing, near_dedup, quality, token_files
from sensorspark.llm.common import cut, small_batches

THRESHOLD = 0.3
#: Trees don't go to SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    trees = quality.fit(docs, _table(spark, sf_dir, "labels"))
    with small_batches(spark):  # so it is written here
        return cut(quality.score(docs, trees, into="_score").where(F.col("_score") >= THRESHOLD).drop("_score"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    with small_batches(spark):
        return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the tempered shares of sources, languages and topics; weight says how often each counts."""
    return mixing.weighted(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files."""
    return token_files.round_trip(docs)


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("decontamination", decontaminated), ("mixing", mixed), ("token_files", tokenized)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
