"""Vocabulary lookups: ids both ways, prefixes, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_prefix
from .index import numbered


def terms(postings: DataFrame) -> DataFrame:
    """(term): every distinct term."""
    return postings.select("term").distinct()


def id_map(values: DataFrame, column: str, name: str) -> DataFrame:
    """(name, column): dense ids from 0 in string order."""
    return numbered(values, column, name)


def ids_of(values: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Values joined with their ids; unknown values have no row."""
    return values.join(mapping, column)


def with_prefix(values: DataFrame, prefix: str, column: str = "term") -> DataFrame:
    """The values that start with ``prefix``, in code-point order; all for an empty prefix."""
    return values.where(has_prefix(column, prefix)).select(column).orderBy(column)


def prefix_exists(values: DataFrame, prefix: str, column: str = "term") -> DataFrame:
    """(prefix, found): one row. The empty prefix is found even among no values."""
    found = F.coalesce(F.bool_or(has_prefix(column, prefix)), F.lit(False)) | F.lit(prefix == "")
    return values.agg(found.alias("found")).select(F.lit(prefix).alias("prefix"), "found")


def size(values: DataFrame) -> int:
    return values.distinct().count()
