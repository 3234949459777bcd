"""Postings in Arrow batches: tokens of documents counted where they lie, postings gathered to lists of a term and a block of ids.

Nothing here holds more than a bounded part of its input: runs of RUN_BYTES or RUN_POSTINGS, and one list of 2**BLOCK_BITS ids at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block of a postings list where lists are cut (arrays, gaps): 2 to this power.
BLOCK_BITS = 16
#: Bytes of texts (or one longer text) that a task counts at a time, postings that it sorts at a time, rows of a batch that it hands on.
RUN_BYTES, RUN_POSTINGS, OUT_ROWS = 1 << 23, 1 << 20, 1 << 18
_LOW = (1 << BLOCK_BITS) - 1


def lists(values: pa.Array, edge: np.ndarray) -> pa.Array:
    """Values cut at ``edge`` as lists."""
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values)


def bytes_of(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Numbers cut at ``edge`` as byte strings."""
    at = pa.array((edge * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(edge) - 1, [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def codes_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each distinct value, and the values by number; null is a value like any other."""
    known = _flat(column).dictionary_encode(null_encoding="encode")
    return known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that add up to ``most`` or are one row."""
    ahead, lo = np.append(0, np.cumsum(sizes)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ahead, ahead[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts, one text's after the other, and how many each has: split where ``functions.text.tokens`` splits."""
    parts = pc.utf8_split_whitespace(text)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten()
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~empty.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(pc.invert(empty))
    return words, sizes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Of bounded slices of (doc_id, text): ids, tokens, and tokens of each row."""
    for batch in batches:
        for lo, hi in runs_of(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), RUN_BYTES):
            yield batch.column(0).slice(lo, hi - lo), *split(batch.column(1).slice(lo, hi - lo))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of each run of (doc_id, text): terms by number, then of each posting the term's number, ascending, the id, the frequency and the row's tokens."""
    for ids, words, sizes in _texts(batches):
        n = len(ids)
        code, known = codes_of(words)
        key = code * n + np.repeat(np.arange(n), sizes)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        row = key[first] % n
        yield known, key[first] // n, ids.take(pa.array(row)), np.diff(np.append(first, len(key))).astype(np.int32), sizes[row]


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")


def _rows(given: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, code, ids, tf, dl in _count(batches):
            for lo in range(0, len(code), OUT_ROWS):
                part = slice(lo, lo + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([known.take(pa.array(code[part])), ids[part], pa.array(tf[part]), pa.array(dl[part])], ["term", "doc_id", "tf", "dl"])

    return given.mapInArrow(run, f"term string, doc_id {dict(given.dtypes)['doc_id']}, tf int, dl bigint")


def _lists(given: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, code, ids, tf, dl in _count(batches):
            first = np.flatnonzero(np.diff(code, prepend=-1))
            edge = np.append(first, len(code))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(code[first])), lists(ids, edge), lists(pa.array(tf), edge), lists(pa.array(dl), edge)], ["term", "doc_ids", "tfs", "dls"])

    return given.mapInArrow(run, f"term string, doc_ids array<{dict(given.dtypes)['doc_id']}>, tfs array<int>, dls array<bigint>")


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(_again): ids of more than one row."""
    return docs.groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again")


def _by_repeats(docs: DataFrame, id_col: str, text_col: str, once: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose id no other row has need no exchange; those of repeated ids, null too, are added up by ``again``."""
    several = repeated_ids(docs, id_col)
    if several.isEmpty():
        return once(_given(docs, id_col, text_col))
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return once(_given(docs.join(several, same, "left_anti"), id_col, text_col)).unionByName(again(docs.join(several, same, "left_semi")))


def _added(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, doc_id, tf): frequencies of each row counted where it lies, then added up by term and id."""
    return _rows(_given(docs, id_col, text_col)).groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf): the postings of a collection. Documents are counted where they lie; only rows of repeated ids are exchanged."""
    return _by_repeats(docs, id_col, text_col, lambda given: _rows(given).select("term", "doc_id", "tf"), lambda some: _added(some, id_col, text_col))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl): tokens of each document that has any."""
    given = _given(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, sizes in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes)], ["doc_id", "dl"])

    each = given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, dl bigint")
    return each.where("dl > 0").groupBy("doc_id").agg(F.sum("dl").alias("dl"))


def counted_lists(docs: DataFrame, doc_stats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_ids, tfs, dls): the postings of a collection in lists by runs of documents, with the lengths of their documents."""

    def again(some: DataFrame) -> DataFrame:
        # an id with many rows has as many lengths: these are joined by id, and their lists are single postings
        known = doc_stats.select(F.col("doc_id").alias("_doc"), "dl")
        rows = _added(some, id_col, text_col).join(known, F.col("doc_id").eqNullSafe(F.col("_doc")))
        return rows.select("term", F.array("doc_id").alias("doc_ids"), F.array("tf").alias("tfs"), F.array("dl").alias("dls"))

    return _by_repeats(docs, id_col, text_col, _lists, again)


def exploded(found: DataFrame, *kept: str) -> DataFrame:
    """(kept, doc_id, tf, dl): a row for each posting of lists."""
    rows = found.select(*kept, F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p"))
    return rows.select(*kept, F.col("p.doc_ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


# Lists of a term and a block of ids


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, low, tf, last) of (term, doc_id, tf) in any order: ids within their block and frequencies of each run as bytes."""

    def piece(run: pa.RecordBatch) -> pa.RecordBatch:
        code, known = codes_of(run.column(0))
        ids = run.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        block = ids >> BLOCK_BITS
        order = np.lexsort((ids, code))
        code, ids, block = code[order], ids[order], block[order]
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        edge = np.append(first, len(code))
        tf = run.column(2).to_numpy(zero_copy_only=False).astype(np.int32)[order]
        held = [known.take(pa.array(code[first])), pa.array(block[first]), bytes_of((ids & _LOW).astype(np.uint16), edge), bytes_of(tf, edge), pa.array(ids[edge[1:] - 1])]
        return pa.RecordBatch.from_arrays(held, ["term", "block", "low", "tf", "last"])

    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, RUN_POSTINGS):
            held.append(batch.slice(lo, RUN_POSTINGS))
            size += held[-1].num_rows
            if size >= RUN_POSTINGS:
                yield piece(pa.concat_batches(held))
                held, size = [], 0
    if size:
        yield piece(pa.concat_batches(held))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by their first columns, cut between groups of these: no group is in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            # with the last row held, to see whether its group goes on
            batch = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            held[-1] = held[-1].slice(0, held[-1].num_rows - 1)
        cut = int(np.flatnonzero(changes(batch, columns))[-1])
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def changes(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows at which a group of the first columns begins."""
    out = np.zeros(batch.num_rows, bool)
    for k in range(columns):
        out |= np.diff(codes_of(batch.column(k))[0], prepend=-1) != 0
    return out


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of a column of byte strings, one row's after the other."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8)[at[0] : at[-1]].view(kind) if held is not None and at[-1] > at[0] else np.zeros(0, kind)


def by_list(postings: DataFrame, work: Callable[..., pa.RecordBatch], schema: str, carried: bool = False) -> DataFrame:
    """``work`` on all lists of a term and a block of ids: (terms, blocks, edges, ids, tfs, last ids of the blocks before, places among the term's blocks from 1).

    Postings are gathered to pieces of lists before the exchange, so a row is no posting but the part of a list that a run of them has, of
    2 bytes an id. Lists of a block are merged by the task that gets them; a term of every document is no single row or task. With ``carried``, what a list
    must know of the term's blocks before is found from their last ids and goes to the same task beside its pieces; else those two are 0.
    """
    rows = postings.where("doc_id is not null").select("term", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tf").cast("int").alias("tf"))
    kind = dict(postings.dtypes)["term"]
    pieces = rows.mapInArrow(_pieces, f"term {kind}, block bigint, low binary, tf binary, last bigint")
    none = F.lit(0).cast("bigint")
    parts = pieces.select("term", "block", "low", "tf", none.alias("carried"), none.alias("place"))
    if carried:
        order = Window.partitionBy("term").orderBy("block")
        last = pieces.groupBy("term", "block").agg(F.max("last").alias("last"))
        empty = F.lit(b"")
        before = last.select("term", "block", empty.alias("low"), empty.alias("tf"), F.coalesce(F.lag("last").over(order), none).alias("carried"), F.row_number().over(order).cast("bigint").alias("place"))
        parts = parts.unionByName(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, 2):
            begins = np.flatnonzero(changes(whole, 2))
            size = pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, whole.num_rows)))
            count = np.add.reduceat(size, begins)
            # lists of bounded size together
            for lo, hi in runs_of(count, RUN_POSTINGS):
                a, b = begins[lo], (begins[hi] if hi < len(begins) else whole.num_rows)
                part = whole.slice(a, b - a)
                own = np.repeat(group[a:b] - lo, size[a:b])
                low = _numbers(part.column(2), np.uint16).astype(np.int64)
                order = np.argsort(own << BLOCK_BITS | low, kind="stable")
                block = part.column(1).to_numpy()[begins[lo:hi] - a]
                ids = (block[own] << BLOCK_BITS) + low[order]
                beside = [np.maximum.reduceat(part.column(k).to_numpy(), begins[lo:hi] - a) for k in (4, 5)]
                yield work(part.column(0).take(pa.array(begins[lo:hi] - a)), block, np.append(0, np.cumsum(count[lo:hi])), ids, _numbers(part.column(3), np.int32)[order], *beside)

    # a piece of a common term may be large
    return parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(run, schema)
