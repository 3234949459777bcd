"""Removal of every byte covered by a long string that also starts earlier, by a distributed sparse suffix array.

Order: rows by id, then by a hash of their text, then by text; in a row by position. A *window* is a string of ``LENGTH``
bytes inside one text; it is removed if an equal window starts earlier.

1. Anchors. Each window selects the least-hashed of its ``SPAN`` grams (leftmost of equals), so equal windows
   select equal anchors at equal offsets. The windows of one anchor are neighbours and form a *unit*.
2. Units are range-partitioned by the leading bytes at their anchor, then by the anchor and by their content, under sampled
   splitters, and sorted. Equal units (128 bits of content hash beside the anchor's): all but the first are removed whole.
   Units whose anchor stands nowhere else leave here.
3. What is left are units of repeated anchors whose contents differ. Their suffixes are range-partitioned under the same
   splitters; each bucket is sorted by multikey quicksort, eight bytes a character, and neighbours are compared over all
   ``LENGTH`` bytes.
4. Boundaries. Equal units never part, but a splitter may cut the units of one anchor (a hot passage is cut by many, in
   proportion to its share of the sample). Such an anchor stands on both sides of a boundary: it is taken to repeat with
   other content. The suffixes of cut anchors, and of those that the sample shows with many contents, would fill a bucket: they
   are dealt over all buckets one by one by their own content, so equal ones still meet.

Equal units and equal suffixes are combined in each map task before every exchange; what that removes leaves the task as
maximal ranges of a text, packed, so a passage that stands in a third of all rows sends a few numbers a row. Rows with the id
and text of another are removed without any search. The text is exchanged once, by id and hash; all three passes over it read
that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

LENGTH = 100
SPAN = 64
GRAM = LENGTH - SPAN + 1
#: Texts beyond this many bytes are taken in overlapping pieces of it.
PIECE = 1 << 19
#: Rows sampled for splitters, and anchors kept of each.
SAMPLE_ROWS, SAMPLE_ANCHORS = 2000, 256
#: An anchor with so many contents in the sample is hot.
HOT = 8
#: Bytes of text for which there is a bucket at least.
BUCKET_BYTES = 1 << 28
#: Stands for a null id.
LAST = (1 << 63) - 1
_WHOLE, _FINE = 1, 2
_FLUSH = 2_000_000
_KEYS = ["id", "tag"]
_SENT = "bucket int, units binary, ranges binary"
_RANGES = "id long, tag long, seq byte, start long, end long, mark byte"
U = np.uint64


def pieces(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: bytes, start of each piece in them, index of its row, offset in its row."""
    for lo, hi in tb.blocks(rows, PIECE):
        if hi - lo == 1 and len(rows[lo]) > PIECE:
            for at in range(0, len(rows[lo]) - LENGTH + 1, PIECE):
                part = np.frombuffer(rows[lo], np.uint8)[at : at + PIECE + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([lo]), np.array([at])
        else:
            own = rows[lo:hi]
            yield np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.arange(lo, hi), np.zeros(hi - lo, np.int64)


def units_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(anchor, first window, last window, anchor hash) of each unit, ascending; positions in ``data``."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return None
    sums = tb.prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = tb.range_hash(sums, at, at + GRAM)
    least = gram
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    most = np.zeros(n + 2 * SPAN - 2, U)
    most[SPAN - 1 : SPAN - 1 + n] = least
    for step in (1, 2, 4, 8, 16, 32):
        most = np.maximum(most[:-step], most[step:])
    candidates = np.flatnonzero(most == gram)
    valid = np.ones(n, bool)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[max(s, e - LENGTH + 1) : e] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n) - 1
    start, end = start[valid[start]], end[valid[start]]
    if not len(start):
        return None
    want = least[start]
    i = np.searchsorted(candidates, start)
    while True:
        off = gram[candidates[i]] != want
        if not off.any():
            break
        i[off] += 1
    anchor = candidates[i]
    tied = np.flatnonzero(end > anchor)
    if len(tied):
        found = [(np.delete(anchor, tied), np.delete(start, tied), np.delete(end, tied))]
        for t in tied.tolist():
            s, e = start[t], end[t]
            near = candidates[i[t] : np.searchsorted(candidates, e + SPAN)]
            near = near[gram[near] == want[t]]
            near = near[: np.searchsorted(near, e) + 1]
            found.append((near, np.append(s, near[:-1] + 1), np.minimum(near, e)))
        anchor, start, end = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        anchor, start, end = anchor[order], start[order], end[order]
    return anchor, start, end, gram[anchor]


def leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as a number that sorts like them."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[at].astype(U)


def contents(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the bytes from ``start`` to ``end``, as two numbers."""
    import xxhash

    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]), ">u8").reshape(-1, 2).astype(U)
    return both[:, 0].copy(), both[:, 1].copy()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class Splitters:
    """Cuts of the order (leading bytes, anchor, content) into even ranges, the anchors that they cut, and the hot ones."""

    def __init__(self, sample: np.ndarray, n: int):
        """``sample``: distinct (leading bytes, anchor, two halves of the content) rows in order."""
        self.n = n
        self.edges = sample[np.arange(1, n) * len(sample) // n] if len(sample) else np.zeros((0, 4), U)
        self.cut = np.unique(self.edges[:, 1])
        anchors, times = np.unique(sample[:, 1], return_counts=True)
        self.hot = np.union1d(self.cut, anchors[times >= HOT])

    def is_cut(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.cut)

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.hot)

    def slices(self, *keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of rows sorted by ``keys``, the first of an edge's; equal rows are in one bucket."""
        at = 0
        for bucket, edge in enumerate(self.edges):
            lo, hi = at, len(keys[0])
            for key, value in zip(keys, edge, strict=False):
                lo, hi = lo + int(np.searchsorted(key[lo:hi], value, "left")), lo + int(np.searchsorted(key[lo:hi], value, "right"))
            if hi > at:
                yield bucket, at, hi
            at = hi
        if at < len(keys[0]):
            yield len(self.edges), at, len(keys[0])


def _texts(docs: DataFrame, id_col: str, text_col: str, n: int, carry: list[str]) -> DataFrame:
    """(id, tag, seq, copy, text, _0, _1, …): the texts by id and text hash in ``n`` partitions, in order, with the columns to carry.

    The last bit of ``tag`` marks a null id. ``seq`` numbers unequal texts of one id and tag, ``copy`` marks a row that repeats
    the one before. All columns go through every pass, so that all passes read one exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = F.xxhash64(text).bitwiseAND(F.lit(-2)) + F.col(id_col).isNull().cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), tag.alias("tag"), text.alias("text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    by_key = Window.partitionBy(_KEYS).orderBy("text")
    seq, copy = (F.dense_rank().over(by_key) - 1).cast("byte"), F.coalesce(F.lag("text").over(by_key) == F.col("text"), F.lit(False))
    carried = [f"_{k}" for k in range(len(carry))]
    return rows.repartition(n, *_KEYS).select(*_KEYS, seq.alias("seq"), copy.alias("copy"), "text", *carried)


def _splitters(docs: DataFrame, text_col: str) -> Splitters:
    """Splitters from the anchors of about SAMPLE_ROWS texts, for a bucket a shuffle partition, or a BUCKET_BYTES of text if those are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in tb.rows_of(batch.column(0)):
                own = []
                for data, bounds, _, _ in pieces([row]):
                    if (found := units_of(data, bounds)) is not None:
                        anchor, start, end, h = found
                        # the same anchors are kept of every text that has them
                        least = np.argsort(tb.mix(h), kind="stable")[:SAMPLE_ANCHORS]
                        own.append(np.stack([leads(data, anchor[least]), h[least], *contents(data, start[least], end[least] + LENGTH)], 1))
                if own:
                    table = np.concatenate(own)
                    table = table[np.argsort(tb.mix(table[:, 1]), kind="stable")[:SAMPLE_ANCHORS]]
                    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["x"])

    texts = docs.select(text_col)
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = texts if share == 1 else texts.sample(False, share, 7)
    # at most about SAMPLE_ROWS times SAMPLE_ANCHORS rows of four numbers
    found = np.frombuffer(b"".join(r.x for r in sample.mapInArrow(run, "x binary").collect()), U).reshape(-1, 4)
    found = found[np.lexsort(found.T[::-1])]
    return Splitters(found[_changes(*found.T)], n)


def _sent(blobs: list[tuple[int, bytes]], ranges: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """A batch of packed units and packed ranges, each with its bucket."""
    bucket = pa.array([b for b, _ in blobs + ranges], pa.int32())
    units = pa.array([x for _, x in blobs] + [None] * len(ranges), pa.binary())
    return pa.RecordBatch.from_arrays([bucket, units, pa.array([None] * len(blobs) + [x for _, x in ranges], pa.binary())], ["bucket", "units", "ranges"])


def _pack_ranges(n: int, ids: np.ndarray, tags: np.ndarray, seqs: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """Ranges to remove, for any bucket that will hand them on."""
    return [(int(tb.mix(tags[:1].view(U))[0] % U(n)), tb.pack(ids, tags, seqs, start, end))] if len(ids) else []


def _marked(ids: np.ndarray, tags: np.ndarray, seqs: np.ndarray, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(c.astype(t)) for c, t in zip((ids, tags, seqs, start, end, mark), ("i8", "i8", "i1", "i8", "i8", "i1"), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["id", "tag", "seq", "start", "end", "mark"])


def _unpacked(batches: Iterator[pa.RecordBatch], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Hands on the ranges of what ``_sent`` made and gathers the units in ``blobs``."""
    for batch in batches:
        blobs += batch.column(1).drop_null().to_pylist()
        for blob in batch.column(2).drop_null():
            found = tb.unpack(blob.as_py())
            yield _marked(*found, np.full(len(found[0]), _WHOLE))


def _repeated_units(texts: DataFrame, splitters: Splitters) -> DataFrame:
    """(id, tag, seq, start, end, mark): ranges that are removed whole, and units to be compared."""
    n = splitters.n

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            owner, start, end, lead, h, u, v = map(np.concatenate, zip(*held, strict=True))
            ids, tags, seqs = map(np.concatenate, zip(*keys, strict=True))
            held.clear()
            keys.clear()
            # rows come in their order and sorting is stable, so the first of equal units is the earliest
            order = np.lexsort((v, u, h, lead))
            new = _changes(lead[order], h[order], u[order], v[order])
            first, rest = order[new], order[~new]
            again = np.append(~new[1:], False)[new]

            def send(x: np.ndarray, more: np.ndarray) -> bytes:
                own = owner[x]
                return tb.pack(h[x], u[x], v[x], ids[own], tags[own], seqs[own], start[x], (end - start)[x].astype(np.int16), more)

            blobs = [(b, send(first[lo:hi], again[lo:hi])) for b, lo, hi in splitters.slices(lead[first], h[first], u[first], v[first])]
            s, e, o = _ranges(start[rest], end[rest], owner[rest])
            yield _sent(blobs, _pack_ranges(n, ids[o], tags[o], seqs[o], s, e))

        rows = 0
        for batch in batches:
            fresh = np.flatnonzero(~batch.column(3).to_numpy(zero_copy_only=False))
            id_of, tag_of, seq_of = (batch.column(c).to_numpy()[fresh] for c in range(3))
            for data, bounds, row, offset in pieces(tb.rows_of(batch.column(4).take(pa.array(fresh)))):
                if (found := units_of(data, bounds)) is None:
                    continue
                anchor, start, end, h = found
                piece = np.searchsorted(bounds, anchor, "right") - 1
                shift = offset[piece] - bounds[piece]
                held.append((rows + piece, start + shift, end + shift + LENGTH, leads(data, anchor), h, *contents(data, start, end + LENGTH)))
                keys.append((id_of[row], tag_of[row], seq_of[row]))
                rows += len(row)
                if sum(len(x[0]) for x in held) > _FLUSH:
                    yield from flush()
                    rows = 0
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        yield from _unpacked(batches, blobs)
        if not blobs:
            return
        h, u, v, ids, tags, seqs, start, size, again = tb.unpack_all(blobs)
        blobs.clear()
        order = np.argsort(h, kind="stable")
        new = _changes(h[order])
        keep = order[~(new & np.append(new[1:], True)) | again[order] | splitters.is_cut(h[order])]
        order = keep[np.lexsort([x[keep] for x in (start, seqs, tags, ids, v, u, h)])]
        if not len(order):
            return
        h, u, v, ids, tags, seqs, start, size = (x[order] for x in (h, u, v, ids, tags, seqs, start, size))
        new = _changes(h)
        twin = ~_changes(h, u, v)
        group = np.cumsum(new) - 1
        varied = (np.bincount(group, ~twin) > 1)[group] | splitters.is_cut(h)
        mark = np.where(twin, _WHOLE, np.where(varied, _FINE, 0))
        some = mark > 0
        yield _marked(*(x[some] for x in (ids, tags, seqs, start, start.astype(np.int64) + size, mark)))

    sent = texts.mapInArrow(combine, _SENT)
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(settle, _RANGES)


def _ranges(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges of each owner: start, end, owner."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    # ends that only grow within an owner
    base = owner.astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(start), bool)
    new[1:] = (start + base)[1:] > reach[:-1]
    edge = np.flatnonzero(new)
    return start[edge], (reach - base)[np.append(edge[1:], len(start)) - 1], owner[edge]


def sort_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``LENGTH``-byte suffixes of ``data`` at ``at``, and in it which differ from the one before.

    Multikey quicksort with eight bytes a character: suffixes are sorted by the first character; only groups that
    are not yet equal over all bytes are sorted by the next. The order of equal suffixes is that of ``at``.
    """
    wide = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    depths = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    char = lambda index, depth: wide[at[index] + depth].astype(U)
    order = np.argsort(char(np.arange(len(at)), 0), kind="stable")
    new = np.ones(len(at), bool)
    first = char(order, 0)
    new[1:] = first[1:] != first[:-1]
    # positions in the order whose group may still hold unequal suffixes
    open_ = np.flatnonzero(~new | np.append(~new[1:], False))
    for k, depth in enumerate(depths[1:], 1):
        if not len(open_):
            break
        differ = np.zeros(len(open_), bool)
        for rest in depths[k:]:
            c = char(order[open_], rest)
            differ[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new[open_]) - 1
        uneven = np.bincount(group, differ & ~new[open_]) > 0
        open_ = open_[uneven[group]]
        if not len(open_):
            break
        group = np.cumsum(new[open_]) - 1
        c = char(order[open_], depth)
        turn = np.lexsort((c, group))
        order[open_] = order[open_][turn]
        c = c[turn]
        new[open_[1:]] |= c[1:] != c[:-1]
        same = ~new
        still = same[open_] | np.append(same[open_[1:]], False)
        open_ = open_[still]
    return order, new


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, tag, seq, copy, text, _0, _1, …, cuts): each text with the byte ranges (seq, start, end) whose union is removed of the rows of its key, and carried columns."""
    splitters = _splitters(docs, text_col)
    n = splitters.n
    texts = _texts(docs, id_col, text_col, n, carry or [])
    units = _repeated_units(texts, splitters).repartition(n, *_KEYS)
    listed = units.groupBy(_KEYS).agg(F.collect_list(F.struct("seq", "start", "end", "mark")).alias("units"))
    joined = texts.join(listed, _KEYS).select(*texts.columns, "units")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lead, h, u, v, ids, tags, seqs, at, size = map(np.concatenate, zip(*(x[:9] for x in held), strict=True))
            text = np.concatenate([x[9] for x in held])
            begin = np.cumsum(size) - size
            held.clear()
            # a join may bring rows in any order
            order = np.lexsort((at, seqs, tags, ids, v, u, h, lead))
            new = _changes(lead[order], h[order], u[order], v[order])
            first, rest = order[new], order[~new]

            def send(own: np.ndarray) -> bytes:
                take = np.repeat(begin[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
                return tb.pack(ids[own], tags[own], seqs[own], at[own], size[own].astype(np.int32), text[take])

            hot = splitters.is_hot(h[first])
            dealt, whole = first[hot], first[~hot]
            dealt = dealt[np.argsort(u[dealt] % U(n), kind="stable")]
            edge = np.append(np.flatnonzero(_changes(u[dealt] % U(n))), len(dealt))
            blobs = [(int(u[dealt[lo]] % U(n)), send(dealt[lo:hi])) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            # any other anchor lies in one bucket
            blobs += [(b, send(whole[lo:hi])) for b, lo, hi in splitters.slices(lead[whole], h[whole])]
            rest = rest[np.lexsort((at[rest], seqs[rest], tags[rest], ids[rest]))]
            fresh = _changes(ids[rest], tags[rest], seqs[rest])
            s, e, o = _ranges(at[rest], (at + size)[rest], np.cumsum(fresh) - 1)
            row = rest[fresh][o]
            yield _sent(blobs, _pack_ranges(n, ids[row], tags[row], seqs[row], s, e))

        for batch in batches:
            id_of, tag_of, seq_of = (batch.column(c).to_numpy() for c in range(3))
            listed = batch.column(batch.num_columns - 1)
            units, edge = listed.flatten(), listed.offsets.to_numpy()
            owner = np.repeat(np.arange(len(id_of)), np.diff(edge))
            u_seq, u_start, u_end, mark = (units.field(k).to_numpy() for k in range(4))
            own = (u_seq == seq_of[owner]) & ~batch.column(3).to_numpy(zero_copy_only=False)[owner]
            owner, u_start, u_end, mark = owner[own], u_start[own], u_end[own], mark[own]
            whole = mark == _WHOLE
            s, e, o = _ranges(u_start[whole], u_end[whole], owner[whole])
            if len(o):
                yield _sent([], _pack_ranges(n, id_of[o], tag_of[o], seq_of[o], s, e))
            fine = np.sort(((owner << 40) | u_start)[mark == _FINE])
            busy = np.unique(owner[mark == _FINE])
            for data, bounds, row, offset in pieces(tb.rows_of(batch.column(4).take(pa.array(busy)))):
                if (found := units_of(data, bounds)) is None:
                    continue
                anchor, start, end, h = found
                piece = np.searchsorted(bounds, anchor, "right") - 1
                shift = offset[piece] - bounds[piece]
                text_row = busy[row[piece]]
                some = np.isin((text_row << 40) | (start + shift), fine)
                anchor, start, end, h, shift, text_row = (x[some] for x in (anchor, start, end, h, shift, text_row))
                if not len(start):
                    continue
                # the suffixes of a unit in one run; those of a hot anchor one by one
                width = np.where(splitters.is_hot(h), end + 1 - start, 1)
                of = np.repeat(np.arange(len(start)), width)
                step = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
                a = start[of] + step
                b = np.where(width[of] > 1, a, end[of]) + LENGTH
                size = b - a
                text = data[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]
                row = text_row[of]
                held.append((leads(data, anchor)[of], h[of], *contents(data, a, b), id_of[row], tag_of[row], seq_of[row], a + shift[of], size, text))
                if sum(len(x[9]) for x in held) > 16 * _FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        yield from _unpacked(batches, blobs)
        if not blobs:
            return
        ids, tags, seqs, at, size, text = tb.unpack_all(blobs)
        blobs.clear()
        begin = np.cumsum(size, dtype=np.int64) - size
        order = np.lexsort((at, seqs, tags, ids))
        width = (size - LENGTH + 1)[order].astype(np.int64)
        of = np.repeat(order, width)
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        place, new = sort_suffixes(text, begin[of] + step)
        late = np.zeros(len(of), bool)
        late[place[~new]] = True
        of, step = of[late], step[late]
        if not len(of):
            return
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1] + 1)
        lo = np.flatnonzero(fresh)
        a, b, of = step[lo], step[np.append(lo[1:], len(step)) - 1] + LENGTH, of[lo]
        yield _marked(ids[of], tags[of], seqs[of], at[of] + a, at[of] + b, np.full(len(of), _WHOLE))

    sent = joined.mapInArrow(suffixes, _SENT)
    found = sent.repartitionById(n, F.col("bucket")).mapInArrow(compare, _RANGES)
    cuts = found.repartition(n, *_KEYS).groupBy(_KEYS).agg(F.collect_list(F.struct("seq", "start", "end")).alias("cuts"))
    return texts.join(cuts, _KEYS, "left").select(*texts.columns, "cuts")


def _merged(blob: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], int, int]:
    """Kept stretches, removed bytes, removed runs."""
    starts, ends, _ = _ranges(starts, ends, np.zeros(len(starts), np.int64))
    kept, last = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(blob[last:s])
        last = e
    kept.append(blob[last:])
    return kept, int((ends - starts).sum()), len(starts)


def _row_ranges(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Row number, text and its ranges of a batch of ``repeated_ranges``; of a copy the whole text."""
    seq, copy = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
    cuts = batch.column(batch.num_columns - 1)
    edge, flat = cuts.offsets.to_numpy(), cuts.values
    c_seq, c_start, c_end = (flat.field(k).to_numpy() for k in range(3))
    empty = cuts.is_null().to_numpy(zero_copy_only=False)
    for i, text in enumerate(tb.rows_of(batch.column(4))):
        if copy[i]:
            whole = np.array([len(text)] if len(text) >= LENGTH else [], np.int64)
            yield i, text, whole * 0, whole
            continue
        part = slice(0, 0) if empty[i] else slice(edge[i], edge[i + 1])
        own = c_seq[part] == seq[i]
        yield i, text, c_start[part][own], c_end[part][own]


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Every text is taken whole as UTF-8 bytes; null is empty. A byte is removed if a string of ``LENGTH`` bytes that covers
    it also starts earlier: in a row of smaller id, or earlier in the same row. Strings are judged on the input and never
    cross rows. Rows that share an id are ordered by the hash of their text, so the second of two equal rows is a copy; a null id is
    ordered like the largest id there is. Texts of fewer than ``LENGTH`` bytes stay whole. Other columns are ignored, whatever their names. No rows: no rows.
    """
    joined = repeated_ranges(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text, start, end in _row_ranges(batch):
                kept, removed, spans = _merged(text, start, end)
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                out.append((len(text), removed, spans, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(run, "id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("tag").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the bytes that ``removal_digest`` counts taken out of the texts; other columns as they are.

    A character of which only some bytes are removed goes whole. Rows stay even where nothing of their text is left; a null
    text stays null.
    """
    # null texts are told from empty ones by a carried flag
    others = [c for c in docs.columns if c != text_col]
    flag = "_" + "".join(docs.columns)
    rows = docs.withColumn(flag, F.col(text_col).isNull())
    joined = repeated_ranges(rows, id_col, text_col, [*others, flag])
    schema = T.StructType([docs.schema[c] for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(batch.num_columns - 2).to_pylist()
            kept = [None if null[i] else b"".join(_merged(t, s, e)[0] if len(s) else [t]).decode("utf-8", "ignore") for i, t, s, e in _row_ranges(batch)]
            columns = dict(zip(others, batch.columns[5:-2], strict=True)) | {text_col: pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in columns_of], columns_of)

    columns_of = docs.columns
    return joined.mapInArrow(run, schema)


#: The rule of ``removal_digest`` in DuckDB, over the hexadecimal digits of the texts: every window of 100 bytes against all others.
ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
cut AS (SELECT doc_id, q, substr(x, 2 * q + 1, 2198) AS piece FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99, 1000)) AS q FROM b)),
w AS (SELECT doc_id, q + o AS p, substr(piece, 2 * o + 1, 200) AS g FROM (SELECT doc_id, q, piece, unnest(range(0, least(1000, length(piece) // 2 - 99))) AS o FROM cut)),
late AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
isl AS (SELECT doc_id, p, count(*) FILTER (prev IS NULL OR p > prev + 100) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM late)),
r AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM isl GROUP BY doc_id, k),
gaps AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS z FROM r UNION ALL SELECT doc_id, max(e), NULL FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(z, length(x) // 2) - a)), '' ORDER BY a) AS y FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
