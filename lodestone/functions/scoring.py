"""Columns of term weights. All logarithms are natural."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def sublinear_tf(tf: Column) -> Column:
    """``1 + ln(tf)``, 0 for no occurrence."""
    return F.when(tf > 0, 1 + F.ln(tf)).otherwise(F.lit(0.0))


def idf_classic(n: Column, df: Column) -> Column:
    return F.ln(n / df)


def idf_bm25(n: Column, df: Column) -> Column:
    """Always above 0."""
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_bound(idf: Column, max_tf: Column, k1: float = K1, b: float = B) -> Column:
    """No document's weight of the term is higher, for ``k1 >= 0`` and ``0 <= b <= 1``."""
    return idf * max_tf * (k1 + 1) / (max_tf + k1 * (1 - b))
