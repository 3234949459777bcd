"""Sizes of encoded postings: per term and for the whole index, by codec; encoded lists and their decoding.

All of it works on the lists of ``blocks.by_list``, in Arrow batches: what is exchanged are pieces of lists, then a row for each list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import CODECS, codec
from .blocks import by_list, bytes_of, lists, runs_of
from .index import gap_numbers

#: Encoded bytes that a task decodes at a time, or those of one list.
DECODED_BYTES = 1 << 18


def _bits(postings: DataFrame, names: list[str]) -> DataFrame:
    """(term, {name}_p, {name}_t): bits of each term's two lists by codec.

    A list's own gaps are added up where it is; its first gap, which hangs on the block before, is added from a row for each list.
    """

    def work(terms: pa.Array, block: np.ndarray, edge: np.ndarray, ids: np.ndarray, tfs: np.ndarray, before: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        gap = gap_numbers(edge, ids, ids[edge[:-1]])
        tf = tfs.astype(np.int64)
        sums = []
        for name in names:
            p = codec(name).gap_bits_of(gap)
            p[edge[:-1]] = 0
            sums += [np.add.reduceat(p, edge[:-1]), np.add.reduceat(codec(name).tf_bits_of(tf), edge[:-1])]
        return pa.RecordBatch.from_arrays([terms, *map(pa.array, (block, ids[edge[:-1]], ids[edge[1:] - 1], *sums))], ["term", "block", "first", "last", *columns])

    columns = [f"{n}_{k}" for n in names for k in "pt"]
    found = by_list(postings, work, f"term {dict(postings.dtypes)['term']}, block bigint, first bigint, last bigint, " + ", ".join(f"{c} bigint" for c in columns))
    order = Window.partitionBy("term").orderBy("block")
    gap = found.withColumn("gap", F.col("first") - F.coalesce(F.lag("last").over(order), F.lit(0)))
    whole = [F.sum(F.col(f"{n}_p") + codec(n).gap_bits(F.col("gap"))).alias(f"{n}_p") for n in names] + [F.sum(f"{n}_t").alias(f"{n}_t") for n in names]
    return gap.groupBy("term").agg(*whole)


def term_sizes(postings: DataFrame, name: str) -> DataFrame:
    """(term, postings_bytes, tf_bytes): encoded bytes of each term's two lists; every list is filled up to whole bytes. No list is encoded."""
    size = lambda k: F.ceil(F.col(f"{name}_{k}") / 8).cast("bigint")
    return _bits(postings, [name]).select("term", size("p").alias("postings_bytes"), size("t").alias("tf_bytes"))


def report(postings: DataFrame, baseline: str = "standard") -> DataFrame:
    """(encoder, terms, postings_bytes, tf_bytes, total_bytes, ratio, saving): a row for each codec; the ratio to the baseline is 1 if that is empty.

    One pass: the sums of all codecs come from the same lists.
    """
    by_term = _bits(postings, list(CODECS))
    whole = lambda c: F.coalesce(F.sum(F.ceil(F.col(c) / 8)), F.lit(0)).cast("bigint").alias(c)
    totals = by_term.agg(F.count("*").alias("terms"), *(whole(f"{n}_{k}") for n in CODECS for k in "pt"))
    each = [F.struct(F.lit(n).alias("encoder"), F.col(f"{n}_p").alias("p"), F.col(f"{n}_t").alias("t"), (F.col(f"{baseline}_p") + F.col(f"{baseline}_t")).alias("base")) for n in CODECS]
    rows = totals.select("terms", F.explode(F.array(*each)).alias("x")).select("x.encoder", "terms", "x.p", "x.t", "x.base")
    ratio = F.when(F.col("base") > 0, (F.col("p") + F.col("t")) / F.col("base")).otherwise(F.lit(1.0))
    return rows.select("encoder", "terms", F.col("p").alias("postings_bytes"), F.col("t").alias("tf_bytes"), (F.col("p") + F.col("t")).alias("total_bytes"), ratio.alias("ratio"), ((1 - ratio) * 100).alias("saving"))


def _hex(column: pa.Array) -> pa.Array:
    return pa.array([x.hex() for x in column.to_pylist()])


def vbe_segments(postings: DataFrame) -> DataFrame:
    """(term, block, postings_hex, tf_hex): variable-byte lists in segments of a block of ids each; a term's segments in order are its list."""

    def work(terms: pa.Array, block: np.ndarray, edge: np.ndarray, ids: np.ndarray, tfs: np.ndarray, before: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        pack = codec("vbe").pack_tf
        return pa.RecordBatch.from_arrays([terms, pa.array(block), _hex(bytes_of(*pack(gap_numbers(edge, ids, before), edge))), _hex(bytes_of(*pack(tfs.astype(np.int64), edge)))], ["term", "block", "postings_hex", "tf_hex"])

    return by_list(postings, work, f"term {dict(postings.dtypes)['term']}, block bigint, postings_hex string, tf_hex string", carried=True)


def encoded(postings: DataFrame, name: str) -> DataFrame:
    """(term, block, postings, tfs): binary lists by codec, each block of ids a list of its own."""
    own = codec(name)

    def work(terms: pa.Array, block: np.ndarray, edge: np.ndarray, ids: np.ndarray, tfs: np.ndarray, before: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms, pa.array(block), bytes_of(*own.pack(ids, edge)), bytes_of(*own.pack_tf(tfs.astype(np.int64), edge))], ["term", "block", "postings", "tfs"])

    return by_list(postings, work, f"term {dict(postings.dtypes)['term']}, block bigint, postings binary, tfs binary")


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of byte strings, and where each begins."""
    edge = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + edge[-1]], edge


def decoded(rows: DataFrame, name: str) -> DataFrame:
    """(term, doc_id, tf): the postings that ``encoded`` holds."""
    own = codec(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            for lo, hi in runs_of(size, DECODED_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, edge = own.unpack(*_flat_bytes(part.column(1)))
                tfs, _ = own.unpack_tf(*_flat_bytes(part.column(2)))
                term = part.column(0).take(pa.array(np.repeat(np.arange(hi - lo), np.diff(edge))))
                yield pa.RecordBatch.from_arrays([term, pa.array(ids), pa.array(tfs.astype(np.int32))], ["term", "doc_id", "tf"])

    return rows.select("term", "postings", "tfs").mapInArrow(run, f"term {dict(rows.dtypes)['term']}, doc_id bigint, tf int")


def gap_lists(postings: DataFrame) -> DataFrame:
    """(term, segment, gaps): the gaps of each term's ids in order, in segments numbered from the first; a list is its segments one after the other.

    No id is kept: the first gap of a segment is the distance from the last id of the segment before.
    """

    def work(terms: pa.Array, block: np.ndarray, edge: np.ndarray, ids: np.ndarray, tfs: np.ndarray, before: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms, pa.array(place.astype(np.int32)), lists(pa.array(gap_numbers(edge, ids, before)), edge)], ["term", "segment", "gaps"])

    return by_list(postings, work, f"term {dict(postings.dtypes)['term']}, segment int, gaps array<bigint>", carried=True)


def from_gaps(rows: DataFrame) -> DataFrame:
    """(term, doc_id): ids back from ``gap_lists``, by running sums in two levels: over the sums of segments, a row each, then inside segments."""
    before = Window.partitionBy("term").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.select("term", "segment", F.aggregate("gaps", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("whole"))
    carried = whole.select("term", "segment", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in runs_of(size, DECODED_BYTES):
                part = batch.slice(lo, hi - lo)
                n = size[lo:hi]
                total = np.append(0, np.cumsum(part.column(1).flatten().to_numpy()))
                ids = total[1:] + np.repeat(part.column(2).to_numpy() - total[np.append(0, np.cumsum(n)[:-1])], n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(hi - lo), n))), pa.array(ids)], ["term", "doc_id"])

    both = rows.join(carried, ["term", "segment"]).select("term", "gaps", "carried")
    return both.mapInArrow(run, f"term {dict(rows.dtypes)['term']}, doc_id bigint")
