"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Signatures of whole documents lose short items in long documents: an item of 40 shingles wholly inside a document of
10,000 has a Jaccard similarity of 0.004. So the sketch is taken on the item's side. Items are partitioned by the size of
their shingle set (powers of two); in each partition of sizes up to u an item's MinHash sketch is its k = 2 ((1 - t) u + 1)
shingles of least hash. The share of a sketch that stands in a document estimates the containment of the item in it. A document
that holds a share t of m shingles misses at most (1 - t) m of them, so k - (1 - t) m of the sketch at least are in it: pairs
under that are dropped, and no match is lost. The other pairs are counted over all shingles and confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

#: Bytes of item text that one pass over the documents searches for; more items take more passes.
BLOCK_BYTES = 16 << 20
U = np.uint64


class Index:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int, threshold: float):
        self.ids = pa.array([i for i, _ in items], pa.int64())
        words = tb.Words([t for _, t in items], lower=True)
        hashes, n = words.hashes(), words.counts
        self.data = words.data.tobytes()
        width = np.minimum(n, size)
        self.total = np.zeros(len(items), np.int64)
        self.sketched = np.zeros(len(items), np.int64)
        self.tables: dict[int, tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]] = {}
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {w: [] for w in sorted(set(width.tolist()) - {0})}
        for k in np.flatnonzero(width).tolist():
            w = int(width[k])
            first = np.arange(words.offsets[k], words.offsets[k + 1] - w + 1)
            grams, at = np.unique(tb.gram_hashes(hashes, first, w), return_index=True)
            self.total[k] = m = len(grams)
            upper = (1 << int(m).bit_length()) - 1
            sketch = np.zeros(m, bool)
            sketch[np.argsort(tb.mix(grams ^ U(0xA5A5A5A5)), kind="stable")[: 2 * (int((1 - threshold) * upper + 1e-9) + 1)]] = True
            self.sketched[k] = sketch.sum()
            parts[w].append((grams, np.full(m, k), words.starts[first[at]], words.ends[first[at] + w - 1], sketch))
        self.need = np.ceil(threshold * self.total - 1e-9).astype(np.int64)
        #: The least of a sketch that a document with ``need`` shingles has.
        self.least = np.maximum(1, self.sketched - (self.total - self.need))
        for w, found in parts.items():
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            grams, owner, start, end, sketch = (c[order] for c in columns)
            self.tables[w] = (grams[sketch], owner[sketch]), (grams, owner, start, end)

    @staticmethod
    def _held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of ``h`` are in the ascending ``table``: a bit map first, then a search."""
        size = 1 << max(10, min(24, (64 * len(table)).bit_length()))
        seen = np.zeros(size, bool)
        seen[(table & U(size - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(h & U(size - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
        return maybe[table[at] == h[maybe]]

    @staticmethod
    def _meet(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (place in ``h``, place in the ascending ``table``) of equal values."""
        lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
        of = np.repeat(np.arange(len(h)), hi - lo)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]

    def search(self, rows: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(row, item, common shingles) of each match among ``rows``."""
        words = tb.Words(rows, lower=True)
        if not len(words.starts):
            return
        hashes, many = words.hashes(), len(self.total)
        for w, (sketch, shingles) in self.tables.items():
            first, last, text = words.windows(w)
            if not len(first):
                continue
            h = tb.gram_hashes(hashes, first, w)

            def distinct(own: np.ndarray) -> np.ndarray:
                order = np.lexsort((h[own], text[own]))  # noqa: B023
                own = own[order]
                return own[np.append(True, (h[own][1:] != h[own][:-1]) | (text[own][1:] != text[own][:-1]))[: len(own)]]  # noqa: B023

            own = distinct(self._held(sketch[0], h))
            if not len(own):
                continue
            of, at = self._meet(sketch[0], h[own])
            pairs, hits = np.unique(text[own][of] * many + sketch[1][at], return_counts=True)
            pairs = pairs[hits >= self.least[pairs % many]]
            if not len(pairs):
                continue
            candidate = np.zeros(len(rows), bool)
            candidate[pairs // many] = True
            own = np.flatnonzero(candidate[text])
            own = distinct(own[self._held(shingles[0], h[own])])
            of, at = self._meet(shingles[0], h[own])
            pair = text[own][of] * many + shingles[1][at]
            some = np.isin(pair, pairs)
            of, at, pair = own[of[some]], at[some], pair[some]
            order = np.argsort(pair, kind="stable")
            edge = np.flatnonzero(np.diff(pair[order], prepend=-1))
            for part in np.split(order, edge[1:]):
                k = int(pair[part[0]] % many)
                if len(part) < self.need[k]:
                    continue
                # the words themselves: equal hashes of other words do not count
                spans = zip(shingles[2][at[part]].tolist(), shingles[3][at[part]].tolist(), words.starts[first[of[part]]].tolist(), words.ends[last[of[part]]].tolist(), strict=True)
                common = sum(self.data[a:b] == words.data[s:e].tobytes() for a, b, s, e in spans)
                if common >= self.need[k]:
                    yield int(pair[part[0]] // many), k, common


def _indexes(items: DataFrame, item_col: str, item_text: str, size: int, threshold: float) -> Iterator:
    """A broadcast ``Index`` of each BLOCK_BYTES of items."""
    spark = items.sparkSession
    queries = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size_of = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-size_of // BLOCK_BYTES)
    for number in range(passes):
        block = queries.where(F.expr(f"pmod(xxhash64(i, t), {passes}) = {number}"))
        yield tb.share(spark, Index([(r.i, r.t.encode()) for r in block.collect()], size, threshold))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id_col, item_col, n_shingles, n_common, containment) for every document and item of which it holds at least ``threshold``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. The shingles of an item are its distinct windows of ``size``
    words, or of all its words if it has fewer; those of a document are its windows of as many words. ``containment`` is
    the share of the item's shingles that stand anywhere in the whole document. Items without a word (empty, null) match
    nothing, nor do such documents. Repeats of an item row count once; repeated document rows are returned as often. Null ids
    are kept. Columns other than these four are ignored, whatever their names. An empty table on either side gives no rows.
    Documents are read once for each BLOCK_BYTES of items.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, n_shingles long, n_common long"
    found = None
    for sent in _indexes(items, item_col, item_text, size, threshold):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent()
            for batch in batches:
                rows = tb.rows_of(batch.column(1))
                out = [(lo + r, k, n) for lo, hi in tb.blocks(rows) for r, k, n in own.search(rows[lo:hi])]
                if out:
                    row, item, common = map(np.array, zip(*out, strict=True))
                    columns = [own.ids.take(pa.array(item)), pa.array(own.total[item]), pa.array(common)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], ["id", "item", "n_shingles", "n_common"])

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    share = F.round(F.col("n_common") / F.col("n_shingles"), 6).alias("containment")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_common", share)


def remove_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item by ``contained_items``. Each row is judged by its own text, whatever its id; nothing is exchanged."""
    place = docs.columns.index(text_col)
    for sent in _indexes(items, item_col, item_text, size, threshold):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent()
            for batch in batches:
                rows = tb.rows_of(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                for lo, hi in tb.blocks(rows):
                    for r, _, _ in own.search(rows[lo:hi]):
                        clean[lo + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> '']"

ORACLE = f"""
WITH iw AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT row_number() OVER () AS k, item_id, w, least(5, len(w)) AS width FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT k, item_id, width, array_to_string(w[p:p + width - 1], ' ') AS g
       FROM (SELECT k, item_id, width, w, unnest(range(1, len(w) - width + 2)) AS p FROM i)),
n AS (SELECT k, count(*) AS n FROM ig GROUP BY k),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT r, doc_id, width, array_to_string(w[p:p + width - 1], ' ') AS g
       FROM (SELECT r, doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM i))),
c AS (SELECT r, doc_id, k, item_id, count(*) AS c FROM dg JOIN ig USING (width, g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS n_common, round(c / n, 6) AS containment
FROM c JOIN n USING (k) WHERE 10 * c >= 8 * n
"""
