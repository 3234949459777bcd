"""SimHash near-duplicates: exact links within a Hamming radius, found tile by tile.

Fingerprints are cut into ``radius + 2`` bit blocks. Two fingerprints within the radius agree on two whole
blocks at least, so each pair of blocks deals all fingerprints into tiles that hold every link. A tile is
compared exactly with numpy exclusive-or and bit counts, over sub-tiles sorted by population count; sub-tile
pairs whose population counts differ by more than the radius are skipped. Tiles of a hot block value are split
and met pairwise. Only a spanning forest of a tile's links leaves it, so a group of k copies gives less than
k links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import textblocks as tb
from .components import connected_components, labelled

SEED = 42
#: Most fingerprints of one side of a tile.
TILE = 8192
_SUB = 1024
_SMALL = 48
_SHINGLES = 1 << 16


def fingerprint_block(rows: list[bytes], size: int = 4) -> np.ndarray:
    """64-bit SimHash of each text over its ``size``-word shingles, repeats included."""
    import xxhash

    words = tb.Words(rows, lower=True)
    first, last, text = words.windows(size, short=True)
    ones = np.zeros((len(rows), 64), np.int64)
    count = np.bincount(text, minlength=len(rows))
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    for lo in range(0, len(text), _SHINGLES):
        part = slice(lo, lo + _SHINGLES)
        spans = zip(words.starts[first[part]].tolist(), words.ends[last[part]].tolist(), strict=True)
        h = np.array([digest(data[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = text[part]
        edge = np.flatnonzero(np.diff(at, prepend=-1))
        ones[at[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    major = (2 * ones > count[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp long, deal int) for every row of ``docs``; ``deal`` numbers the rows of a batch, so that equal rows can be dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tb.rows_of(batch.column(1))
            out = np.zeros(len(rows), np.uint64)
            for lo, hi in tb.blocks(rows):
                out[lo:hi] = fingerprint_block(rows[lo:hi], size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), pa.array(np.arange(len(rows), dtype=np.int32))], ["id", "fp", "deal"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long, deal int")


def _block_keys(radius: int) -> list:
    """A (table, key) struct for each pair of bit blocks."""
    n = radius + 2
    width = [64 // n + (i < 64 % n) for i in range(n)]
    at = [sum(width[:i]) for i in range(n)]
    cut = [F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << width[i]) - 1)) for i in range(n)]
    pairs = enumerate(combinations(range(n), 2))
    return [F.struct(F.lit(t).alias("t"), (F.shiftleft(cut[i], width[j]) + cut[j]).alias("k")) for t, (i, j) in pairs]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-index labels after joining a[i] with b[i]."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _tile_links(fp: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Joins the labels of all pairs of a left and a right index within the radius."""
    ones = np.bitwise_count(fp)

    def cut(index: np.ndarray) -> list[np.ndarray]:
        index = index[np.argsort(ones[index], kind="stable")]
        return [index[i : i + _SUB] for i in range(0, len(index), _SUB)]

    lefts, rights = cut(left), cut(right)
    for i, a in enumerate(lefts):
        for b in rights[i:] if left is right else rights:
            if int(ones[b[0]]) - int(ones[a[-1]]) > radius or int(ones[a[0]]) - int(ones[b[-1]]) > radius:
                continue
            root = label[a[0]]
            if (label[a] == root).all() and (label[b] == root).all():
                continue
            x, y = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
            label = merge_labels(label, a[x], b[y])
    return label


def _groups_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each group; ``group`` ascends, ``side`` is -1 in whole tiles, else 0 or 1."""
    label = np.arange(len(fp))
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, int)
    size = np.diff(np.append(edge, len(fp)))
    of = np.repeat(size, size)
    small = (of <= _SMALL) & (side < 0)
    for shift in range(1, min(_SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:])) if shift < len(fp) else []
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius]
        label = merge_labels(label, i, i + shift)
    for lo, n in zip(edge.tolist(), size.tolist(), strict=True):
        if small[lo]:
            continue
        index = np.arange(lo, lo + n)
        own = side[lo : lo + n]
        if (own < 0).all():
            label = _tile_links(fp, index, index, label, radius)
        elif 0 < own.sum() < n:
            label = _tile_links(fp, index[own == 0], index[own == 1], label, radius)
    far = np.flatnonzero(label != np.arange(len(fp)))
    return fp[far], fp[label[far]]


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of all pairs within ``radius``."""
    keyed = nodes.select("fp", F.explode(F.array(*_block_keys(radius))).alias("x")).select("fp", "x.t", "x.k")
    hot = keyed.groupBy("t", "k").count().where(F.col("count") > TILE).select("t", "k", F.ceil(F.col("count") / TILE).cast("int").alias("n"))
    hot = materialize(hot, "hot")
    dealt = keyed.join(hot, ["t", "k"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("s", F.expr("cast(pmod(xxhash64(fp, t), n) as int)"))
    dealt = dealt.select("fp", "t", "k", "s", F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    dealt = dealt.select("t", "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), F.when(F.col("s") == F.col("o"), -1).when(F.col("s") < F.col("o"), 0).otherwise(1).alias("side"), "fp")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = own if kept is None else [np.concatenate(x) for x in zip(kept, own, strict=True)]
            n = len(kept[0])
            if not n:
                continue
            new = np.any([np.diff(c, prepend=c[0]) != 0 for c in kept[:4]], axis=0)
            group = np.cumsum(new)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from emit(group[:last], [c[:last] for c in kept])
                kept = [c[last:] for c in kept]
        if kept is not None and len(kept[0]):
            yield from emit(np.zeros(len(kept[0]), int), kept)

    def emit(group: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = _groups_links(group, columns[4], columns[5].view(np.uint64), radius)
        if len(a):
            pairs = np.unique(np.stack([a, b], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _dealt_join(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of their fingerprint; the rows of a fingerprint that has more than an even share of a task are dealt over several.

    At most as many fingerprints as shuffle partitions are above an even share, so the list of them may be broadcast, and they take at most
    twice as many copies of their class.
    """
    share = max(1, rows.count() // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = rows.groupBy("fp").count().where(F.col("count") > share).select("fp", F.ceil(F.col("count") / share).cast("int").alias("parts"))
    hot = F.broadcast(materialize(hot, "hot"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, "fp", "left").select("id", "fp", F.pmod(F.xxhash64("deal"), parts).cast("int").alias("part"))
    copies = classes.join(hot, "fp", "left").select("fp", "component", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(copies, ["fp", "part"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    A-Z are lower-cased; the shingles of a text are its ``size``-word windows, repeats included; a text of fewer
    words is one shingle; an empty, blank or null text has fingerprint zero and links like any other.
    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits. Repeated rows
    and repeated ids are returned as often as they come; a null id is returned, and is a component_id only
    where all ids of the component are null. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    stars = connected_components(links(nodes, radius))
    classes = labelled(nodes.select(F.col("fp").alias("node"), "least"), stars)
    named = _dealt_join(rows, classes.withColumnRenamed("node", "fp"))
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
