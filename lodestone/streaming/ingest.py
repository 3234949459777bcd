"""Incremental indexing: a stream of documents appended to an index as postings deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, count_postings, token_rows


def ingest(docs: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Starts writing the postings of each micro-batch to ``path``, a folder per batch, and stops when the input is used up.

    A batch that is replayed after a failure overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        count_postings(token_rows(batch, id_col, text_col)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark, path: str) -> Index:
    """The index of all batches; a document that came in parts has the sum of its frequencies."""
    deltas = spark.read.parquet(path)
    return Index.of(deltas.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf")))
