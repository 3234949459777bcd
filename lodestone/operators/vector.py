"""Dense vector search: exact inner-product top-k, and search by clusters.

Queries are a stated set. They are taken in blocks of bounded size; each block meets all vectors in matrix products of AT_ONCE scores at most,
and every task hands on its ``k`` best per query only. A final ranking merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .blocks import runs_of
from .retrieval import AT_ONCE, Best, top_k

#: Queries that one pass over the vectors answers.
QUERY_BLOCK = 4096
#: Recall that the number of probed cells is chosen for, above the 0.9 that is asked, and the queries that it is measured on.
RECALL, PROBE_QUERIES = 0.95, 200


def normalize(rows: DataFrame, column: str = "vec") -> DataFrame:
    """Rows with their vectors at length 1; a vector of zeros stays."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(column, lambda x: F.when(F.col("_norm") > 0, x.cast("double") / F.col("_norm")).otherwise(x.cast("double")))
    return rows.withColumn("_norm", norm).withColumn(column, unit).drop("_norm")


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocks_of(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries (qid, vec), QUERY_BLOCK or fewer at a time."""
    held: list = []
    for row in queries.select(F.col("qid").cast("long"), "vec").toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)
            held = []
    if held:
        yield np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)


def _meet(best: Best, ids: pa.Array, data: np.ndarray, vecs: np.ndarray, q: np.ndarray, v: np.ndarray) -> None:
    """Some queries with some vectors, a bounded product at a time."""
    for lo, hi in runs_of(np.full(len(v), len(q)), AT_ONCE):
        scores = vecs[q] @ data[v[lo:hi]].T
        a, b = np.nonzero(scores >= best.floor[q, None] - 2e-9)
        best.add(ids, v[lo + b], q[a], scores[a, b])


def _found(best: Best, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows in best.rows(["qid", "id", "score"]):
        yield rows.set_column(0, "qid", pa.array(ids[rows.column(0).to_numpy()]))


def search_exact(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, rank, id_col, score): the ``k`` vectors of highest inner product with each query (qid, vec); ties by id. Null vectors are left out."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    found = None
    for ids, vecs in blocks_of(queries.where("vec is not null")):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, vecs))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vecs = sent.value
            best = Best(len(ids), k, in_order=False)
            for batch in batches:
                if batch.num_rows:
                    _meet(best, batch.column(0), matrix(batch.column(1)), vecs, np.arange(len(ids)), np.arange(batch.num_rows))
            yield from _found(best, ids)

        part = rows.mapInArrow(run, "qid long, id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "qid long, id long, score double")
    return top_k(found, k, ids="id").withColumnRenamed("id", id_col)


def build_cells(vectors: DataFrame, n_cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42, stored: bool = True) -> tuple[DataFrame, np.ndarray]:
    """((id_col, vec_col, cell), centroids): vectors dealt to k-means cells, ``ceil(sqrt(n))`` by default and never more than vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    n = rows.count()
    cells = max(1, min(n, n_cells or ceil(sqrt(n))))
    if n < 2 or cells < 2:
        width = rows.select(F.size(vec_col)).first()
        return rows.withColumn("cell", F.lit(0)), np.zeros((1, width[0] if width else 0))
    features = rows.withColumn("_f", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))
    model = KMeans(k=cells, seed=seed, featuresCol="_f", predictionCol="cell", maxIter=10).fit(features)
    dealt = model.transform(features).select(id_col, vec_col, "cell")
    return materialize(dealt, "cells") if stored else dealt, np.array(model.clusterCenters())


def search_cells(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, k: int = 10, n_probe: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As ``search_exact`` over the ``n_probe`` cells whose centroids have the highest inner product with each query, ``probes_for`` by default. All cells: exact."""
    if n_probe is None:
        n_probe = probes_for(queries, cells, centroids, k, id_col=id_col, vec_col=vec_col)
    found = None
    wide = F.transform(vec_col, lambda x: x.cast("double"))
    rows = cells.select(F.col(id_col).cast("long").alias("id"), wide.alias("vec"), "cell")
    for ids, vecs in blocks_of(queries.where("vec is not null")):
        near = np.argsort(-(vecs @ centroids.T), axis=1, kind="stable")[:, :n_probe].astype(np.int32)
        # the queries of each cell
        asked = np.argsort(near.ravel(), kind="stable")
        start = np.searchsorted(near.ravel()[asked], np.arange(len(centroids) + 1))
        sent = cells.sparkSession.sparkContext.broadcast((ids, vecs, (asked // near.shape[1]).astype(np.int32), start))
        probed = np.flatnonzero(np.diff(start)).tolist()

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vecs, asked, start = sent.value
            best = Best(len(ids), k, in_order=False)
            for batch in batches:
                if batch.num_rows:
                    own, data = batch.column(2).to_numpy(), matrix(batch.column(1))
                    for cell in np.unique(own):
                        _meet(best, batch.column(0), data, vecs, asked[start[cell] : start[cell + 1]], np.flatnonzero(own == cell))
            yield from _found(best, ids)

        part = rows.where(F.col("cell").isin(probed)).mapInArrow(run, "qid long, id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = cells.sparkSession.createDataFrame([], "qid long, id long, score double")
    return top_k(found, k, ids="id").withColumnRenamed("id", id_col)


def probes_for(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, k: int = 10, least: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> int:
    """The fewest probed cells with which PROBE_QUERIES of the queries find ``least`` of their exact results on average; all cells without queries.

    The queries of least id hash are measured against ``search_exact``, once: each exact result counts by the place of its cell in
    its query's order of cells, so every number of probes is judged at once.
    """
    some = queries.where("vec is not null").select(F.col("qid").cast("long"), "vec").dropDuplicates(["qid"]).orderBy(F.expr(f"xxhash64(qid, {seed})"), "qid").limit(PROBE_QUERIES)
    some = materialize(some, "probes")
    exact = search_exact(some, cells, k, id_col, vec_col).join(cells.select(F.col(id_col).cast("long").alias(id_col), "cell"), id_col)
    # at most PROBE_QUERIES vectors, and k pairs of numbers for each
    vecs = {r[0]: np.array(r[1], np.float64) for r in some.collect()}
    place = {q: np.argsort(np.argsort(-(v @ centroids.T), kind="stable")) for q, v in vecs.items()}
    need = np.sort([place[r.qid][r.cell] for r in exact.select("qid", "cell").collect()])
    return int(need[ceil(least * len(need)) - 1]) + 1 if len(need) else len(centroids)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(recall): the share of the exact results that were found."""
    hit = exact.select("qid", id_col).join(found.select("qid", id_col, F.lit(1).alias("hit")), ["qid", id_col], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

