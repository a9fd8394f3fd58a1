"""From raw documents to packed training sequences: each stage's rows are written as Parquet and are the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidejobs.functions.storage import stored, table
from slidejobs.llm import exact_dedup, near_dedup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from the labelled ones among docs."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) the one with the most characters, then the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of what is left, as pieces with their place in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
