"""Ranking metrics: RBP, DCG, NDCG, average precision; means over queries and comparison of methods.

A ranking is rows (qid, rank, rel), ranks from 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("rbp", "dcg", "ndcg", "ap")


def ranking(results: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("qid", "doc_id")) -> DataFrame:
    """Results with the relevance of each document; what is not judged has 0. Extra columns of the results stay."""
    judged = qrels.select(*keys, F.col("rel").alias("_rel"))
    return results.join(judged, list(keys), "left").withColumn("rel", F.coalesce("_rel", F.lit(0))).drop("_rel")


def rbp(rows: DataFrame, p: float = 0.8, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Rank-biased precision ``(1 - p) * sum(rel * p**(rank - 1))``."""
    return rows.groupBy(*by).agg(((1 - p) * F.sum(F.col("rel") * F.pow(F.lit(p), F.col("rank") - 1))).alias("rbp"))


def dcg(rows: DataFrame, k: int | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Discounted gain ``sum(rel / log2(rank + 1))`` over the first ``k`` ranks; graded relevance is allowed."""
    gain = F.when(F.col("rank") <= k, F.col("rel")).otherwise(0) if k else F.col("rel")
    return rows.groupBy(*by).agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))


def ndcg(rows: DataFrame, k: int | None = None, by: tuple[str, ...] = ("qid",), judged: DataFrame | None = None) -> DataFrame:
    """DCG by the DCG of the best order, 0 if that is 0.

    The best order is that of the retrieved list itself; with ``judged`` (by, rel) it is that of all judged documents.
    """
    pool = judged if judged is not None else rows
    order = Window.partitionBy(*by).orderBy(F.desc("rel"))
    best = dcg(pool.select(*by, "rel").withColumn("rank", F.row_number().over(order)), k, by).withColumnRenamed("dcg", "best")
    share = F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(F.lit(0.0))
    return dcg(rows, k, by).join(best, list(by), "left").select(*by, share.alias("ndcg"))


def average_precision(rows: DataFrame, by: tuple[str, ...] = ("qid",), judged: DataFrame | None = None) -> DataFrame:
    """Mean of the precision at each hit (``rel`` of 1) over the relevant documents retrieved, or over ``judged`` (by, rel) ones; 0 without any."""
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col("rel") == 1).cast("int")
    sums = rows.withColumn("hits", F.sum(hit).over(upto)).groupBy(*by).agg(F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))).alias("s"), F.sum("rel").alias("total"))
    if judged is not None:
        sums = sums.drop("total").join(judged.groupBy(*by).agg(F.sum("rel").alias("total")), list(by), "left")
    return sums.select(*by, F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(F.lit(0.0)).alias("ap"))


def metrics(rows: DataFrame, p: float = 0.8, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(by, rbp, dcg, ndcg, ap) in one pass over the ranking: one exchange by query, two orders inside it."""
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = Window.partitionBy(*by).orderBy(F.desc("rel"))
    out = rows.withColumn("hits", F.sum((F.col("rel") == 1).cast("int")).over(upto)).withColumn("place", F.row_number().over(best))
    out = out.groupBy(*by).agg(
        ((1 - p) * F.sum(F.col("rel") * F.pow(F.lit(p), F.col("rank") - 1))).alias("rbp"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(F.col("rel") / F.log2(F.col("place") + 1.0)).alias("best"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))).alias("s"),
        F.sum("rel").alias("total"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(*by, "rbp", "dcg", ratio("dcg", "best").alias("ndcg"), ratio("s", "total").alias("ap"))


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame, p: float = 0.8) -> DataFrame:
    """(rbp, dcg, ndcg, ap): means over all queries (qid); one without results counts with zeros. No queries: nulls."""
    each = metrics(ranking(results, qrels), p)
    every = queries.select("qid").distinct().join(each, "qid", "left")
    return every.agg(*(F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in METRICS))


def evaluate_function(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, qrels: DataFrame, k: int = 1000, p: float = 0.8) -> DataFrame:
    """``evaluate`` for any retrieval function of (queries, k); all queries are answered in one call."""
    return evaluate(search(queries, k), qrels, queries, p)


def compare(by_method: dict[str, DataFrame], qrels: DataFrame, queries: DataFrame, p: float = 0.8) -> DataFrame:
    """(method, rbp, dcg, ndcg, ap): a row of means for each method's results."""
    rows = None
    for name, results in by_method.items():
        own = results.select("qid", "rank", "doc_id", F.lit(name).alias("method"))
        rows = own if rows is None else rows.unionByName(own)
    each = metrics(ranking(rows, qrels), p, by=("method", "qid"))
    names = F.explode(F.array(*map(F.lit, by_method))).alias("method")
    every = queries.select("qid").distinct().select("qid", names).join(each, ["method", "qid"], "left")
    return every.groupBy("method").agg(*(F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in METRICS))


def best_methods(table: DataFrame, order: list[str]) -> DataFrame:
    """(metric, method, value): for each metric the first method, in the given order, within 1e-9 of the highest mean."""
    long = table.select("method", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("x")).select("method", "x.metric", "x.value")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("method")), F.lit(0))
    high = Window.partitionBy("metric")
    near = long.withColumn("high", F.max("value").over(high)).where("value >= high - 1e-9")
    first = Window.partitionBy("metric").orderBy(place)
    return near.withColumn("r", F.row_number().over(first)).where("r = 1").select("metric", "method", "value")
