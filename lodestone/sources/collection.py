"""Text collections, query files, judgements and stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_number, query_id, query_text, tokens


def read_collection(spark: SparkSession, root: str) -> DataFrame:
    """(doc_name, block, text): every file of every immediate sub-directory of ``root``, a row each; files right under it, and files of no bytes, have none.

    ``doc_name`` is ``./<last part of root>/<block>/<file>`` wherever the root lies; ids may be ``row_number`` over it or ``document_number`` of it.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    blocks = sorted(e.getPath().toString() for e in entries if e.isDirectory())
    if not blocks:
        return spark.createDataFrame([], "doc_name string, block string, text string")
    rows = spark.read.text(blocks, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    parts = F.split(path, "/")
    name = F.concat(F.lit("./"), F.array_join(F.slice(parts, -3, 3), "/"))
    return rows.select(name.alias("doc_name"), F.element_at(parts, -2).alias("block"), F.col("value").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): lines of a query file; a first word that starts with Q is the id if more words follow, else the id is ``*``. Blank lines are skipped."""
    rows = spark.read.text(path)
    return rows.where(F.size(tokens("value")) > 0).select(query_id("value").alias("qid"), query_text("value").alias("query"))


def read_evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): the first word of a line is always the id. Blank lines are skipped."""
    words = tokens("value")
    rows = spark.read.text(path).where(F.size(words) > 0)
    return rows.select(words[0].alias("qid"), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " ").alias("query"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rel): the relevant pairs of a judgement file; all other pairs are not relevant."""
    words = tokens("value")
    rows = spark.read.text(path).where(F.size(words) >= 2)
    return rows.select(words[0].alias("qid"), words[1].cast("int").alias("docno"), F.lit(1).alias("rel")).distinct()


def with_document_numbers(rows: DataFrame, column: str = "doc_name") -> DataFrame:
    """Rows with the whole number of their document's file name as ``docno``."""
    return rows.withColumn("docno", document_number(column))


def as_queries(spark: SparkSession, *lines: str) -> DataFrame:
    """(qid, query): lines given directly, parsed like those of a query file."""
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return rows.where(F.size(tokens("value")) > 0).select(query_id("value").alias("qid"), query_text("value").alias("query"))
