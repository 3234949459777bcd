"""Bounded samples of labelled rows, for everything that is fitted here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, rows: int, size: int) -> list[tuple[int, str, float]]:
    """(id, text, label) of at most ``rows`` labelled rows of up to ``size`` bytes, in order: those of least id hash.

    ``known`` (_id, _y) has one label an id. Rows of equal id and text count once; a null text is empty. The bound holds before
    anything is collected, so the driver gets ``rows`` times ``size`` bytes at most.
    """
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.where(F.octet_length("_text") <= size).join(F.broadcast(some), "_id").dropDuplicates(["_id", "_text"])
    found = found.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_text").limit(rows)
    return sorted((r["_id"], r["_text"], r["_y"]) for r in found.collect())
