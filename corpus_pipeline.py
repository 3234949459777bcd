"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier scores under 0.5 go.
2. near_duplicates: of each group of texts whose 5-word shingles are 0.8 similar the document of the smallest id stays.
3. repeats: bytes that repeat an earlier 100-byte string are cut out of the texts.
4. benchmark: documents that hold four fifths of a benchmark item go.
5. mixing: sources are mixed to their target weights; a row for each place of a document in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, near_text, quality_classifier, suffix_dedup
from lodestone.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more."""
    return quality_classifier.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_text.keep_representatives(docs.select(COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; ``n_chars`` follows the text."""
    return suffix_dedup.remove_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(block, position, doc_id, source, epoch, n_tokens, text) in the mixture's order."""
    return mixing.mixed_documents(docs.select(COLUMNS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier and the near duplicates have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None
