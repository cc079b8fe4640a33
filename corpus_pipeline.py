"""The corpus pipeline: each stage reads what its predecessor kept.

Toxic documents go, repeated line chunks are cut out, one document of each near-duplicate group stays,
repeated passages of 50 words and more are cut out, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import line_dedup, near_copies, packing, substring_dedup, toxicity
from quillon.llm.util import written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score under the threshold stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: all documents stay, without chunks of lines that stand elsewhere."""
    return line_dedup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 at a similarity: the document with the smallest id of each group stays; five-word shingles that agree to 0.8 make a
    group. SimHash parts with Hamming balls of their own choose pairs, which are compared exactly."""
    return near_copies.drop_near_copies(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents stay, without words of passages that stand in earlier ones."""
    return substring_dedup.drop_repeated_words(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of documents with their sequences and offsets."""
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("packing", pack),
]

#: The first and third stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
