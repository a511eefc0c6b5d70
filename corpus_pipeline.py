"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planecraft.llm import compression_rules, near_dup, packing, quality_classifier
from planecraft.llm.jobs import stored
from planecraft.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the compression bands accept."""
    return compression_rules.keep(docs)


def quality_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, fitted on the labels, accepts."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.Packing(tokenizer("word_bpe_49k.json")))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classes), ("near duplicates", near_duplicates), ("packing", packed)]

#: SQL has neither zstandard nor a trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
