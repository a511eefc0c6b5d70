"""The llm queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.llm import additive_ann, bpe, compression_rules, filter_audit, importance, language_id, main_text, near_dup, packing, perspectives, quality_classifier, token_files, web_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.assess(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer("word_bpe_49k.json")))


def op11_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.round_trip(table(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_quality_rules,
        op3_language_id,
        op4_bpe,
        op5_token_files,
        op6_near_dup,
        op7_additive_ann,
        op8_main_text,
        op9_perspectives,
        op10_packing,
        op11_web_archive,
        op12_importance_resampling,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op9_perspectives": perspectives.ROTATE_SQL,
    "op11_web_archive": web_archive.ROUND_TRIP_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
}
