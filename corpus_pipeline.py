"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import fit_quality, keep_quality
from tidemark.llm.shared import shared_path
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.llm.toxicity import drop_toxic, fit_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the field is learned from the labelled documents of the table."""
    return drop_toxic(docs, fit_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the quality threshold go; the rules are learned from the labelled documents of the table."""
    return keep_quality(docs, fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (3-word shingles, 3 bits)."""
    return drop_near_duplicates(docs, shingle=3, max_bits=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

# Learned models and tokenizers have no SQL form; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
