"""Latent semantic indexing: weighted term-document matrix, truncated SVD, fold-in of queries, cosine ranking of all documents.

Weights are ``(1 + ln tf) * ln(N / max(df, 1))``. The term basis V (terms x k) is computed once; documents and queries are both mapped
by it (a document to its row times V, a query likewise, without division by singular values) and compared by cosine.

The decomposition is, at every size, a subspace iteration, a randomized range finder. It works on the smaller side of the matrix: with fewer documents
than terms, the basis (documents x (k + 10)) is sent to partitions of terms, else the basis of terms to partitions of documents. Each pass adds up
the partitions' products, so neither postings nor vectors are gathered. The basis is a table of chunks of rows, and only SENT_NUMBERS of it, some of
its columns, are on the driver and in a broadcast at a time; it is made orthogonal by its Gram matrix, which is as small as k + 10. Passes end when the
leading singular values have settled. ``exact`` solves a small collection from the Gramian of its documents on the driver, if asked for.

Documents are ranked by exact search, or by cells (``vector.build_cells``) where the index has them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..shared import discard, materialize, remove
from .index import Index, numbered
from .retrieval import query_terms
from .vector import build_cells, matrix, search_cells, search_exact

#: Most documents and weights of a collection that ``exact`` takes: the driver holds them.
EXACT_DOCS, EXACT_WEIGHTS = 3000, 5_000_000
#: Numbers of a basis that are broadcast at a time: the smaller of documents and terms, times as many columns.
SENT_NUMBERS = 1 << 25
#: Components beyond those asked for; most passes, and the relative change of singular values at which they end.
OVERSAMPLE, PASSES, SETTLED, SEED = 10, 12, 1e-3, 42
_CHUNK = 4096
#: Entries of the matrix that are multiplied at a time: their products stay in the cache.
_ENTRIES = 2048


def weights(index: Index) -> DataFrame:
    """(term, doc_id, w): the weighted term-document matrix."""
    rows = index.postings.join(index.term_stats, "term").crossJoin(F.broadcast(index.collection.select("n")))
    w = scoring.sublinear_tf(F.col("tf")) * scoring.idf_classic(F.col("n"), F.greatest("df", F.lit(1)))
    return rows.select("term", "doc_id", w.alias("w"))


def matrix_shape(index: Index) -> DataFrame:
    """(documents, terms, entries, density) of the term-document matrix."""
    shape = index.summary().select("documents", F.col("vocabulary").alias("terms"), F.col("postings").alias("entries"))
    cells = F.col("documents") * F.col("terms")
    return shape.withColumn("density", F.when(cells > 0, F.col("entries") / cells).otherwise(F.lit(0.0)))


def query_weights(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, term, w): ``(1 + ln qtf) * idf`` of the query terms that the index has."""
    known = query_terms(queries).join(index.term_stats, "term").crossJoin(F.broadcast(index.collection.select("n")))
    w = scoring.sublinear_tf(F.col("qtf")) * scoring.idf_classic(F.col("n"), F.greatest("df", F.lit(1)))
    return known.select("qid", "term", w.alias("w"))


def rank_of(n_components: int, n_terms: int, n_docs: int) -> int:
    """Components that the matrix allows."""
    return max(0, min(n_components, n_terms - 1, n_docs - 1))


@dataclass
class LatentIndex:
    """Term vectors (term, vec), unit document vectors (doc_id, vec) and singular values, descending."""

    term_vecs: DataFrame
    doc_vecs: DataFrame
    singular: np.ndarray
    #: (doc_id, vec, cell) and the centroids, if documents are searched by cells.
    cells: DataFrame | None = None
    centroids: np.ndarray | None = None

    def with_cells(self, n_cells: int | None = None, seed: int = SEED) -> LatentIndex:
        """The index with its documents dealt to cells."""
        cells, centroids = build_cells(self.doc_vecs, n_cells, "doc_id", "vec", seed)
        return replace(self, cells=cells, centroids=centroids)

    def save(self, path: str) -> None:
        self.term_vecs.write.mode("overwrite").parquet(f"{path}/term_vecs")
        self.doc_vecs.write.mode("overwrite").parquet(f"{path}/doc_vecs")
        spark = self.term_vecs.sparkSession
        spark.createDataFrame([(json.dumps(self.singular.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/singular")
        remove(spark, f"{path}/centroids")
        if self.cells is not None:
            self.cells.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
            spark.createDataFrame([(json.dumps(self.centroids.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentIndex:
        values = json.loads(spark.read.text(f"{path}/singular").first()[0])
        found = cls(spark.read.parquet(f"{path}/term_vecs"), spark.read.parquet(f"{path}/doc_vecs"), np.array(values))
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            found.cells, found.centroids = spark.read.parquet(f"{path}/cells"), np.array(json.loads(spark.read.text(str(folder)).first()[0]))
        return found


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row in the batch, column number and weight of each entry of (id, columns, weights)."""
    ids, w = batch.column(1), batch.column(2)
    size = np.diff(ids.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), size), ids.flatten().to_numpy(), w.flatten().to_numpy()


def _products(row: np.ndarray, column: np.ndarray, w: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The batch's rows times the basis."""
    out = np.zeros((n, basis.shape[1]))
    # entries come by row
    for lo in range(0, len(row), _ENTRIES):
        part = slice(lo, lo + _ENTRIES)
        edge = np.flatnonzero(np.diff(row[part], prepend=-1))
        out[row[part][edge]] += np.add.reduceat(basis[column[part]] * w[part, None], edge, axis=0)
    return out


def _vectors(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(values, np.float32).ravel()))


class _Basis:
    """A matrix of ``n`` rows as a table (chunk, values) of _CHUNK rows each, times a small matrix that the driver holds."""

    def __init__(self, chunks: DataFrame, n: int, turn: np.ndarray) -> None:
        self.chunks, self.n, self.turn = chunks, n, turn

    def __matmul__(self, turn: np.ndarray) -> _Basis:
        return _Basis(self.chunks, self.n, self.turn @ turn)

    @classmethod
    def random(cls, spark: SparkSession, n: int, m: int, seed: int) -> _Basis:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in batch.column(0).to_pylist():
                    values = np.random.default_rng((seed, c)).normal(size=(min(_CHUNK, n - c * _CHUNK), m))
                    yield _chunk(c, values)

        return cls(materialize(spark.range(-(-n // _CHUNK)).mapInArrow(run, _CHUNKS), "basis"), n, np.eye(m))

    @classmethod
    def of(cls, spark: SparkSession, values: np.ndarray) -> _Basis:
        """A matrix that the driver holds."""
        rows = [(c, np.ascontiguousarray(values[c * _CHUNK : (c + 1) * _CHUNK], np.float64).tobytes()) for c in range(-(-len(values) // _CHUNK))]
        return cls(spark.createDataFrame(rows, _CHUNKS), len(values), np.eye(values.shape[1]))

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """Its columns, as many as may be sent at a time, and the number of the first."""
        width = max(1, SENT_NUMBERS // max(1, self.n))
        for lo in range(0, self.turn.shape[1], width):
            turn = self.turn[:, lo : lo + width]

            def run(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
                for c, values in _chunks(batches, len(turn)):
                    yield _chunk(c, (values @ turn).astype(np.float32))

            out = np.zeros((self.n, turn.shape[1]), np.float32)
            for row in self.chunks.mapInArrow(run, _CHUNKS).toLocalIterator():
                out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row["values"], np.float32).reshape(-1, turn.shape[1])
            yield lo, out

    def rows(self, work) -> DataFrame:
        """(r, vec) of ``work`` on its rows; r from 0."""
        turn = self.turn

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, values in _chunks(batches, len(turn)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32) + c * _CHUNK), _vectors(work(values @ turn))], ["r", "vec"])

        return self.chunks.mapInArrow(run, "r int, vec array<float>")


_CHUNKS = "chunk long, values binary"


def _chunk(c: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())], ["chunk", "values"])


def _chunks(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield c, np.frombuffer(x.as_py()).reshape(-1, m)


def _gram_step(entries: DataFrame, basis: _Basis) -> _Basis:
    """A'(A basis) of the matrix A whose rows are ``entries``, added up over all of them by chunks of rows."""
    parts, context = [], entries.sparkSession.sparkContext
    for lo, values in basis.slices():
        shape, sent = values.shape, context.broadcast(values)
        del values

        def run(batches: Iterator[pa.RecordBatch], sent=sent, shape=shape) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                row, column, w = _rows(batch)
                y = _products(row, column, w, batch.num_rows, sent.value)
                order = np.argsort(column, kind="stable")
                for at in range(0, len(order), _ENTRIES):
                    part = order[at : at + _ENTRIES]
                    edge = np.flatnonzero(np.diff(column[part], prepend=-1))
                    total[column[part][edge]] += np.add.reduceat(y[row[part]] * w[part, None], edge, axis=0)
            for c in range(0, shape[0], _CHUNK):
                yield _chunk(c // _CHUNK, total[c : c + _CHUNK].astype(np.float32))

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for x in batch.column(1):
                    total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64)
            yield _chunk(key[0].as_py(), total)

        parts.append((lo, shape[1], materialize(entries.mapInArrow(run, _CHUNKS).groupBy("chunk").applyInArrow(add, _CHUNKS), "step")))
        sent.destroy()
    m = basis.turn.shape[1]
    if len(parts) == 1:
        return _Basis(parts[0][2], basis.n, np.eye(m))

    def beside(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column(0).to_pylist(), table.column(2).to_pylist(), strict=True))
        return pa.Table.from_batches([_chunk(key[0].as_py(), np.hstack([np.frombuffer(x).reshape(-1, widths[lo]) for lo, x in own]))])

    widths = {lo: width for lo, width, _ in parts}
    every = None
    for lo, _, part in parts:
        own = part.select(F.lit(lo).alias("lo"), "chunk", "values")
        every = own if every is None else every.unionByName(own)
    out = materialize(every.groupBy("chunk").applyInArrow(beside, _CHUNKS), "step")
    discard(*(part for _, _, part in parts))
    return _Basis(out, basis.n, np.eye(m))


def _inner(left: _Basis, right: _Basis) -> tuple[np.ndarray, np.ndarray]:
    """left' right and right' right: small matrices, added up over the chunks of both."""
    a, b = left.turn, right.turn

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = dict(zip(table.column(0).to_pylist(), table.column(2).to_pylist(), strict=True))
        x, y = np.frombuffer(own[0]).reshape(-1, len(a)) @ a, np.frombuffer(own[1]).reshape(-1, len(b)) @ b
        return pa.Table.from_batches([_chunk(0, np.stack([x.T @ y, y.T @ y]))])

    both = left.chunks.select(F.lit(0).alias("side"), "chunk", "values").unionByName(right.chunks.select(F.lit(1).alias("side"), "chunk", "values"))
    total = 0.0
    for row in both.groupBy("chunk").applyInArrow(run, _CHUNKS).toLocalIterator():
        total = total + np.frombuffer(row["values"]).reshape(2, a.shape[1], b.shape[1])
    return total[0], total[1]


def _orthogonal(gram: np.ndarray) -> np.ndarray:
    """What a matrix of this Gram matrix is to be multiplied with to have orthonormal columns; dependent ones become zeros."""
    scale = 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
    values, turn = np.linalg.eigh(gram * scale * scale[:, None])
    kept = values > 1e-13 * max(values.max(initial=0), 1e-300)
    return scale[:, None] * turn * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)


def _exact(entries: DataFrame, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values from the Gramian of the documents, on the driver. ``entries`` are terms."""
    parts = entries.toArrow().combine_chunks().to_batches()
    m = np.zeros((n_docs, n_docs))
    for batch in parts:
        row, doc, w = _rows(batch)
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        for at, d in zip(np.split(w, edge[1:]), np.split(doc, edge[1:]), strict=True):
            m[np.ix_(d, d)] += np.outer(at, at)
    values, left = np.linalg.eigh(m)
    top = np.argsort(-values)[:k]
    return left[:, top], np.sqrt(np.maximum(values[top], 0))


def _randomized(entries: DataFrame, n: int, k: int, limit: int, seed: int) -> tuple[_Basis, np.ndarray]:
    """Singular vectors on the side of the entries' columns, and singular values, by subspace iteration."""
    start, last = _Basis.random(entries.sparkSession, n, min(k + OVERSAMPLE, limit), seed), None
    q = start @ _orthogonal(_inner(start, start)[1])
    for left in reversed(range(PASSES)):
        step = _gram_step(entries, q)
        ritz, gram = _inner(q, step)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        found = q @ turn[:, :k], np.sqrt(np.maximum(values[:k], 0))
        if last is not None and np.all(np.abs(found[1] - last) <= SETTLED * found[1].max(initial=0)):
            break
        # turned to the directions found, columns are nearly orthogonal, so that their Gram matrix loses none of the short ones
        if left:
            discard(q.chunks)
        q, last = step @ turn @ _orthogonal(turn.T @ gram @ turn), found[1]
    return found


def _arpack(entries: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by MLlib's distributed Lanczos iteration."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    # MLlib's matrices take rows of its own vectors
    rows = entries.rdd.map(lambda r: Vectors.sparse(n, sorted(zip(r.c, r.w, strict=True))))
    found = RowMatrix(rows, numCols=n).computeSVD(k)
    return found.V.toArray(), found.s.toArray()


def _held(spark: SparkSession, values: np.ndarray, singular: np.ndarray) -> tuple[_Basis, np.ndarray]:
    return _Basis.of(spark, values), singular


def _times(entries: DataFrame, basis: _Basis, work) -> DataFrame:
    """(r, vec) of ``work`` on the rows of ``entries`` times the basis."""
    parts = []
    for lo, values in basis.slices():
        sent = entries.sparkSession.sparkContext.broadcast(values)
        whole = values.shape[1] == basis.turn.shape[1]
        del values

        def run(batches: Iterator[pa.RecordBatch], sent=sent, whole=whole) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _products(*_rows(batch), batch.num_rows, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), _vectors(work(y) if whole else y)], ["r", "vec"])

        part = entries.mapInArrow(run, "r int, vec array<float>")
        if whole:
            return part
        parts.append(materialize(part.select("r", F.lit(lo).alias("lo"), "vec"), "part"))
        sent.destroy()
    if not parts:
        return entries.select("r", F.array().cast("array<float>").alias("vec"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("r").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "vec"))), lambda x: x.vec)).alias("vec"))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _vectors(work(matrix(batch.column(1))))], ["r", "vec"])

    return lists.mapInArrow(turned, "r int, vec array<float>")


def build_lsi(index: Index, n_components: int = 100, algorithm: str = "randomized", seed: int = SEED) -> LatentIndex:
    """The latent index of a collection.

    ``algorithm``: randomized (subspace iteration), arpack (distributed Lanczos of MLlib), or exact (Gramian; up to EXACT_DOCS documents and
    EXACT_WEIGHTS entries, an error beyond). Signs and rotations within equal singular values are arbitrary; cosines are not.
    """
    if algorithm not in ("exact", "randomized", "arpack"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    spark = index.postings.sparkSession
    terms = materialize(numbered(index.term_stats, "term", "row"), "term_rows").withColumnRenamed("row", "t")
    docs = materialize(numbered(index.doc_stats, "doc_id", "row"), "doc_rows").withColumnRenamed("row", "d")
    n_terms, n_docs, n_weights = terms.count(), docs.count(), index.postings.count()
    k = rank_of(n_components, n_terms, n_docs)
    by_term = n_docs <= n_terms
    numbers = weights(index).join(terms, "term").join(docs, "doc_id").select(F.col("t").cast("int"), F.col("d").cast("int"), "w")
    row, column = ("t", "d") if by_term else ("d", "t")
    # a term's list is as long as its documents are many; a document's is its words
    lists = numbers.groupBy(row).agg(F.collect_list(F.struct(F.col(column).alias("c"), "w")).alias("e"))
    entries = materialize(lists.select(F.col(row).alias("r"), F.col("e.c").alias("c"), F.col("e.w").alias("w")), "matrix")
    small = n_docs <= EXACT_DOCS and n_weights <= EXACT_WEIGHTS and by_term
    n = n_docs if by_term else n_terms
    if k == 0:
        basis, singular = _Basis.of(spark, np.zeros((n, 0))), np.zeros(0)
    elif algorithm == "exact":
        if not small:
            raise ValueError("too large for the exact algorithm, or fewer terms than documents")
        basis, singular = _held(spark, *_exact(entries, n_docs, k))
    elif algorithm == "arpack":
        basis, singular = _held(spark, *_arpack(entries, n, k))
    else:
        basis, singular = _randomized(entries, n, k, min(n_docs, n_terms), seed)
    s = np.maximum(singular, 1e-12)

    def unit(y: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return np.divide(y, norm, out=y, where=norm > 0)

    # r is a term or a document number
    rows = _times(entries, basis, lambda y: y / s if by_term else unit(y))
    own = basis.rows(lambda y: unit(y * s) if by_term else y)
    term_side, doc_side = (rows, own) if by_term else (own, rows)
    term_vecs = materialize(term_side.join(terms, F.col("r") == F.col("t")).select("term", "vec"), "term_vecs")
    doc_vecs = materialize(doc_side.join(docs, F.col("r") == F.col("d")).select("doc_id", "vec"), "doc_vecs")
    return LatentIndex(term_vecs, doc_vecs, singular)


def fold_in(queries: DataFrame, index: Index, latent: LatentIndex) -> DataFrame:
    """(qid, vec): unit latent vectors of the queries; those with a norm under 1e-10 have none."""
    rows = query_weights(queries, index).join(latent.term_vecs, "term").select("qid", "w", "vec")
    kind = dict(rows.dtypes)["qid"]

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + batch.column(1).to_numpy() @ matrix(batch.column(2))
        norm = float(np.linalg.norm(total))
        if norm >= 1e-10:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(total / norm).tolist()], pa.list_(pa.float64()))], ["qid", "vec"])

    return rows.groupBy("qid").applyInArrow(add, f"qid {kind}, vec array<double>")


def search_lsi(queries: DataFrame, index: Index, latent: LatentIndex, k: int = 10, n_probe: int | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): all documents ranked by cosine with each query; scores may be negative. Query ids are whole numbers.

    An index with cells is searched in ``n_probe`` of them, by default as many as a recall of 0.95 needs.
    """
    folded = fold_in(queries, index, latent)
    if latent.cells is None:
        return search_exact(folded, latent.doc_vecs, k, "doc_id", "vec")
    return search_cells(materialize(folded, "folded"), latent.cells, latent.centroids, k, n_probe, "doc_id", "vec")


def search_named(queries: DataFrame, index: Index, latent: LatentIndex, k: int = 10, n_probe: int | None = None) -> DataFrame:
    """``search_lsi`` where queries and documents have names instead of whole numbers; ties by name."""
    asked = materialize(numbered(queries, "qid", "q_row"), "query_rows")
    named = materialize(numbered(latent.doc_vecs, "doc_id", "d_row"), "doc_rows")
    folded = fold_in(queries.join(asked, "qid").select(F.col("q_row").alias("qid"), "query"), index, latent)
    if latent.cells is None:
        found = search_exact(folded, latent.doc_vecs.join(named, "doc_id").select("d_row", "vec"), k, "d_row", "vec")
    else:
        found = search_cells(materialize(folded, "folded"), latent.cells.join(named, "doc_id").select("d_row", "vec", "cell"), latent.centroids, k, n_probe, "d_row", "vec")
    out = found.withColumnRenamed("qid", "q_row").join(asked, "q_row").join(named, "d_row")
    return out.select("qid", "rank", "doc_id", "score")
