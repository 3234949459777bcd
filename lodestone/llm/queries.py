"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, decontaminate, licenses, mixing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice or grant in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier 100-byte string, counted and removed in every document."""
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back through the capture index."""
    return warc.capture_digest(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates the template, folded from its event log, rendered and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.hostile(spark))
    return chat.digest(chat.render(chat.fold(chat.events_of(turns))))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their mixed order."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds four fifths."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_suffix_array_dedup,
        op3_quality_rules,
        op4_warc_captures,
        op5_toxicity,
        op6_chat_formatting,
        op7_simhash_near_dedup,
        op8_source_mixing,
        op9_benchmark_decontamination,
        op10_quality_classifier,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op2_suffix_array_dedup": suffix_dedup.ORACLE, "op4_warc_captures": warc.ORACLE, "op6_chat_formatting": chat.ORACLE, "op8_source_mixing": mixing.ORACLE, "op9_benchmark_decontamination": decontaminate.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
