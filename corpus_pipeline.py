"""Corpus pipeline over ``documents``; each stage's table is written and read again by the next.

Quality rules, exact and near de-duplication, mixing to target weights, packing. All stages but the last
return the columns of ``documents``; the mixture repeats a document that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyco.llm import exact, mixing, packing, quality, simhash
from glyco.session import write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist of content lines."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of Jaccard 0.8 or more in 5-word shingles."""
    return simhash.drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.draw(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packed),
]

# The line model, the fingerprints and both dynamic programmes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; ``drop_written`` deletes their tables.

    A missing text counts as empty, fails the quality rules and goes, as texts of fewer than 20 words do. Of tied or
    repeated rows each stage keeps what its operator says. Extra columns of any name pass through all stages but the
    last. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir))
    return docs
