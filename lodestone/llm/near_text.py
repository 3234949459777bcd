"""Near-duplicate texts: Jaccard similarity of word shingles, found by SimHash in tiles that lose no pair and verified exactly.

A set of n shingles and one at similarity t or more share a shingle among the first floor((1 - t) n) + 1 of each, in any order that
both follow. Each of these first shingles deals its sets into a tile; shingles that a sample finds common come last in the order, so
passages that many texts hold make no tiles. Inside a tile, 128-bit SimHashes are compared by exclusive-or and bit counts. Only a
spanning forest of the pairs within the radius leaves a tile; the sets of each of its components meet once more and are compared
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import textblocks as tb
from .components import connected_components, labelled
from .rowkeys import row_key, unused
from .simhash import merge_labels

#: Words of a shingle and the least similarity of near duplicates.
SIZE, SIMILARITY = 5, 0.8
#: Differing bits of 128 within which sets are compared exactly: at a similarity of 0.8 about 19 differ, with a deviation of 4.
RADIUS = 36
#: Rows of the sample, its longest text, its rows that make a shingle common, and most common shingles.
SAMPLE_ROWS, SAMPLE_BYTES, COMMON, COMMON_MOST = 2000, 32_768, 4, 50_000
#: Most sets of one side of a tile.
TILE = 4096
_SUB, _SMALL, _SHINGLES = 1024, 48, 1 << 16


def shingle_sets(rows: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``size``-word shingles of each text, ascending, and the offsets of the texts; a shorter text is one shingle."""
    words = tb.Words(rows, lower=True)
    first, last, text = words.windows(size, short=True)
    h, long = words.hashes() if len(first) else np.zeros(0, np.uint64), last - first + 1
    grams = np.zeros(len(first), np.uint64)
    for n in np.unique(long).tolist():
        grams[long == n] = tb.gram_hashes(h, first[long == n], n)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))[: len(grams)]
    return grams[fresh], np.searchsorted(text[fresh], np.arange(len(rows) + 1))


def describe(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and its SimHash as two numbers."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    name, ones = n.astype(np.uint64), np.zeros((len(n), 128), np.int64)
    for lo in range(0, len(text), _SHINGLES):
        g, at = grams[lo : lo + _SHINGLES], text[lo : lo + _SHINGLES]
        edge = np.flatnonzero(np.diff(at, prepend=-1))
        name[at[edge]] += np.add.reduceat(tb.mix(g + np.uint64(1)), edge)
        bits = np.unpackbits(np.stack([g, tb.mix(g)], 1).view(np.uint8).reshape(-1, 16), axis=1)
        ones[at[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return tb.mix(name), np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64)


def _sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    rows = tb.rows_of(column)
    for lo, hi in tb.blocks(rows):
        yield lo, hi, *shingle_sets(rows[lo:hi], size)


def prints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, x, y, node, a, b, n) for every row (id, x, y, text): the hash of its shingle set, its SimHash and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, offsets in _sets_of(batch.column(3), size):
                name, fp = describe(grams, offsets)
                columns = [name, fp[:, 0].copy(), fp[:, 1].copy(), np.diff(offsets)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:3], *(pa.array(c.astype(np.int64)) for c in columns)], ["id", "x", "y", "node", "a", "b", "n"])

    return docs.mapInArrow(run, "id long, x long, y long, node long, a long, b long, n long")


def common_shingles(docs: DataFrame, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of COMMON or more rows of a sample, ascending, and the rows of ``docs`` that they stand for."""
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    some = docs.where(F.octet_length("text") <= SAMPLE_BYTES).where(F.pmod(F.xxhash64("text", "id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, _ in _sets_of(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["g"])

    counted = some.mapInArrow(run, "g long").groupBy("g").count().where(F.col("count") >= COMMON)
    # at most COMMON_MOST rows of two numbers
    found = counted.orderBy(F.desc("count"), "g").limit(COMMON_MOST).collect()
    g, n = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.float64)
    order = np.argsort(g)
    return g[order], np.ceil(n[order] / share)


def entries(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(k, side, node): the tiles of each distinct set of a task. Tiles of common shingles are split and met pairwise; side is -1 in whole tiles, else 0 or 1."""
    sent, tile = tb.share(docs.sparkSession, common), TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rows = sent()
        seen: set[int] = set()
        for batch in batches:
            for _, _, grams, offsets in _sets_of(batch.column(1), size):
                name, n = describe(grams, offsets)[0], np.diff(offsets)
                fresh = np.array([not (x in seen or seen.add(x)) for x in name.tolist()], bool)
                text = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(hot, grams), max(0, len(hot) - 1))
                late = hot[at] == grams if len(hot) else np.zeros(len(grams), bool)
                order = np.lexsort((grams, late, text))
                place = np.arange(len(grams)) - offsets[:-1][text]
                order = order[(place < np.floor((1 - similarity) * n + 1e-9)[text] + 1) & fresh[text]]
                key, node = grams[order], name[text[order]]
                parts = np.ones(len(order), np.int64)
                parts[late[order]] = np.ceil(rows[at[order]][late[order]] / tile).astype(np.int64) if len(hot) else 1
                own = (tb.mix(node ^ key) % parts.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.arange(len(order)), parts)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(parts) - parts, parts)
                own, key, node = own[copy], key[copy], node[copy]
                pair = np.minimum(own, other) * (1 << 31) + np.maximum(own, other)
                key = np.where(parts[copy] > 1, tb.mix(key + tb.mix(pair.astype(np.uint64))), key)
                side = np.where(own == other, -1, np.where(own < other, 0, 1)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side), pa.array(node.view(np.int64))], ["k", "side", "node"])

    return docs.mapInArrow(run, "k long, side byte, node long")


def _by_group(batches: Iterator[pa.RecordBatch], keys: int, work) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of whole groups, where rows come sorted by their first ``keys`` columns."""
    kept: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        kept = new if kept is None else pa.concat_tables([kept, new]).combine_chunks()
        heads = [kept.column(c).to_numpy() for c in range(keys)]
        if kept.num_rows:
            fresh = np.flatnonzero(np.any([np.diff(h, prepend=h[0]) != 0 for h in heads], axis=0))
            if len(fresh):
                yield from work(kept.slice(0, fresh[-1]).combine_chunks())
                kept = kept.slice(fresh[-1]).combine_chunks()
    if kept is not None and kept.num_rows:
        yield from work(kept)


def _pairs(label: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    far = np.flatnonzero(label != np.arange(len(label)))
    if len(far):
        yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[label[far]])], ["a", "b"])


def candidates(tiles: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(k, side, node, a, b, n) to links (a, b) whose components are those of all pairs of a tile within the radius and of like size."""

    def close(fp: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
        bits = np.bitwise_count(fp[i, 0] ^ fp[j, 0]).astype(np.int16) + np.bitwise_count(fp[i, 1] ^ fp[j, 1])
        return (bits <= radius) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, side, node, a, b, n = (c.to_numpy() for c in rows.columns)
        names, at = np.unique(node, return_inverse=True)
        fp, label = np.stack([a, b], 1).view(np.uint64), np.arange(len(names))
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        small = np.repeat(size, size) <= _SMALL
        for shift in range(1, min(_SMALL, int(size.max()))):
            i = np.flatnonzero(small[:-shift] & (key[:-shift] == key[shift:]) & ((side[:-shift] < 0) | (side[:-shift] != side[shift:])))
            i = i[label[at[i]] != label[at[i + shift]]]
            i = i[close(fp, n, i, i + shift)]
            label = merge_labels(label, at[i], at[i + shift])
        for lo, m in zip(edge[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
            index = np.arange(lo, lo + m)
            left, right = (index, index) if side[lo] < 0 else (index[side[index] == 0], index[side[index] == 1])
            # only sets of like size meet
            left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
            for x in range(0, len(left), _SUB):
                i = left[x : x + _SUB]
                lo_n, hi_n = np.searchsorted(n[right], [similarity * n[i[0]] - 1e-9, n[i[-1]] / similarity + 1e-9], "left")
                for y in range(int(lo_n), min(len(right), int(hi_n) + 1), _SUB):
                    j = right[y : y + _SUB]
                    if (label[at[i]] == label[at[i[0]]]).all() and (label[at[j]] == label[at[i[0]]]).all():
                        continue
                    p, q = np.nonzero(close(fp, n, i[:, None], j[None, :]))
                    label = merge_labels(label, at[i[p]], at[j[q]])
        yield from _pairs(label, names)

    tiles = tiles.repartition("k").sortWithinPartitions("k")
    return tiles.mapInArrow(lambda batches: _by_group(batches, 1, work), "a long, b long")


def similar(grams: np.ndarray, offsets: np.ndarray, side: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Least-index labels of the components of all pairs of sets of ``similarity`` or more, sides -1 or unlike."""
    n = np.diff(offsets)
    value, ids = np.unique(grams, return_inverse=True)
    flag = np.zeros(len(value), bool)
    label, left = np.arange(len(n)), np.arange(len(n))
    while len(left):
        root, todo = left[0], [int(left[0])]
        left = left[1:]
        while todo and len(left):
            x = todo.pop()
            flag[ids[offsets[x] : offsets[x + 1]]] = True
            near = left[(side[left] < 0) | (side[left] != side[x])]
            near = near[(np.minimum(n[near], n[x]) >= similarity * np.maximum(n[near], n[x]) - 1e-9) & (n[near] > 0)]
            if len(near):
                start = np.cumsum(n[near]) - n[near]
                where = np.arange(int(n[near].sum())) - np.repeat(start - offsets[near], n[near])
                both = np.add.reduceat(flag[ids[where]].astype(np.int64), start)
                # in whole numbers of a thousandth, so that 0.8 is reached exactly
                hit = near[1000 * both >= round(1000 * similarity) * (n[near] + n[x] - both)]
                label[hit] = root
                todo += hit.tolist()
                left = left[~np.isin(left, hit)]
            flag[ids[offsets[x] : offsets[x + 1]]] = False
    return label


def verified(groups: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(root, node, text), a text for each set, to links (a, b) whose components are those of all pairs of a root with ``similarity``."""
    parts = materialize(groups.groupBy("root").count().select("root", F.ceil(F.col("count") / TILE).cast("int").alias("m")), "parts")
    dealt = groups.join(parts, "root").withColumn("s", F.expr("cast(pmod(xxhash64(node), m) as int)"))
    dealt = dealt.select("root", "s", F.explode(F.expr("sequence(0, m - 1)")).alias("o"), "node", "text")
    dealt = dealt.select("root", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), F.when(F.col("s") == F.col("o"), -1).when(F.col("s") < F.col("o"), 0).otherwise(1).alias("side"), "node", "text")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        heads = [rows.column(c).to_numpy() for c in range(3)]
        edge = np.flatnonzero(np.any([np.diff(h, prepend=h[0]) != 0 for h in heads], axis=0))
        cuts = [0, *edge.tolist(), rows.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = rows.slice(lo, hi - lo)
            sets = [(g, o) for _, _, g, o in _sets_of(part.column(5).combine_chunks(), size)]
            n = np.concatenate([np.diff(o) for _, o in sets])
            label = similar(np.concatenate([g for g, _ in sets]), np.append(0, np.cumsum(n)), part.column(3).to_numpy(), similarity)
            yield from _pairs(label, part.column(4).to_numpy())

    return dealt.mapInArrow(lambda batches: _by_group(batches, 3, work), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, node) for every row of ``docs``: its id, its ``row_key`` and its set of shingles; and (node, least) for every set: the least (id, x, y) reachable over links of ``similarity`` or more.

    A-Z are lower-cased; similarity is the Jaccard similarity of the sets of ``size``-word shingles; a text of fewer words is one
    shingle; empty, blank and null texts are equal. Rows of a null id are linked like others but are never ``least``, which is null
    only where all ids of the component are.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    rows = materialize(prints(texts.select("id", "key.x", "key.y", "text"), size), "prints")
    texts = texts.drop("key")
    named_row = F.when(F.col("id").isNotNull(), F.struct("id", "x", "y"))
    nodes = rows.groupBy("node").agg(F.min(named_row).alias("least"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n"))
    common = common_shingles(texts, rows.count(), size)
    tiles = entries(texts, common, size, similarity).groupBy("k").agg(F.collect_set(F.struct("side", "node")).alias("x")).where(F.size("x") > 1)
    tiles = tiles.select("k", F.explode("x").alias("x")).select("k", "x.side", "x.node").join(nodes.drop("least"), "node")
    found = connected_components(candidates(tiles.select("k", "side", "node", "a", "b", "n"), similarity))
    members = materialize(found.union(found.select("root", "root").distinct()), "members")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, _, grams, offsets in _sets_of(batch.column(1), size):
                name = describe(grams, offsets)[0]
                fresh = [i for i, x in enumerate(name.tolist()) if not (x in seen or seen.add(x))]
                yield pa.RecordBatch.from_arrays([pa.array(name[fresh].view(np.int64)), batch.column(1).take(pa.array([lo + i for i in fresh], pa.int64()))], ["node", "text"])

    groups = texts.mapInArrow(named, "node long, text string").join(members, "node").dropDuplicates(["node"]).select("root", "node", "text")
    stars = connected_components(verified(materialize(groups, "groups"), size, similarity))
    return rows.select("id", "x", "y", "node"), labelled(nodes.select("node", "least"), stars).withColumnRenamed("component", "least")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their near-duplicate group: those of its smallest id.

    Rows of the same id and text count once. Where an id has several texts, each is judged by itself, the text of the least hash
    first. A null id names no document: such rows are not judged and stay once for each distinct text.
    """
    rows, found = classes(docs, id_col, text_col, size, similarity)
    keep = found.where("least is not null").select("least.x", "least.y").union(rows.where("id is null").select("x", "y")).distinct()
    x, y = unused(docs.columns, "x"), unused(docs.columns, "y")
    key = row_key(id_col, text_col)
    kept = docs.withColumns({x: key["x"], y: key["y"]}).join(keep.select(F.col("x").alias(x), F.col("y").alias(y)), [x, y], "left_semi")
    # one exchange by the key serves the join and the removal of repeats
    return kept.dropDuplicates([x, y]).select(docs.columns)
