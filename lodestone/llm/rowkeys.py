"""Names of rows for joins: ids may be null or repeat, so a row is known by its id and its text together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text as a struct that is never null; rows of equal id and text share it; null is neither zero nor empty."""
    parts = [F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col).isNull(), F.col(text_col)]
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit("row"), *parts).alias("y"))


def unused(columns: list[str], name: str) -> str:
    """``name`` behind enough underscores to clash with none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
