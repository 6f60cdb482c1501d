"""Corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as
Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, packing, quality, simhash, suffix_dedup
from tessera.llm.shared import free_name, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of equal or nearly equal texts."""
    return simhash.without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes and more that also start earlier."""
    return suffix_dedup.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = free_name(docs, "leaks")
    found = decontam.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences of 2048."""
    import public_tokenizers

    # executors still hold what the stages before took, so workers keep fewer words than they do by default
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_pieces=150_000)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: The stages aren't SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
