"""Quality rules: exact rule statistics of every document, and an isolation forest over them.

Path lengths over random splits tell how early a document's statistics stand alone. All nine statistics are split on, as far as they
leave the range of good text: inside it texts differ widely without being odd. Nothing comes from a sample: the range is the exact
quantiles of all good labelled rows past the base rules, the trees are grown over all labelled rows past them, each row in one tree
at least, and the threshold on the anomaly score is the best of all scores of these rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialize
from . import textblocks as tb

#: Trees, and rows of each at least; share of good rows that the threshold may cost; share of good rows beyond either end of the
#: usual range.
TREES, TREE_ROWS, COST, TAIL = 200, 256, 0.01, 0.002
#: Bits of a share that a pass over the rows settles; buckets that scores are counted in.
DIGIT, BUCKETS = 11, 1 << 16
#: Words of a repeated window.
WINDOW = 8
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_signs", "n_lines"]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` up to each end since the one before."""
    return np.diff(np.append(0, np.append(0, np.cumsum(values))[ends]))


def rule_block(rows: list[bytes]) -> np.ndarray:
    """The statistics ``_NAMES`` of each text."""
    words = tb.Words(rows)
    raw, space, ends = words.raw, words.space, words.row_ends
    out = np.zeros((len(rows), len(_NAMES)), np.int64)
    out[:, 0] = words.counts
    out[:, 1] = _sums(~space & ((raw & 0xC0) != 0x80), ends)
    for column, table in ((2, _SYMBOL), (6, _CAPITAL), (7, _SIGN)):
        out[:, column] = _sums(table[raw], ends)
    # lines with a word; a text ends with a line end
    stop = np.flatnonzero(raw == 10)
    start = np.append(0, stop[:-1] + 1)
    full = np.append(0, np.cumsum(~space))
    some = full[stop] > full[start]
    start, stop = start[some], stop[some]
    text = np.searchsorted(ends, start, "right")
    h = tb.range_hash(tb.prefix_hashes(raw), start, stop)
    order = np.lexsort((h, text))
    twin = np.append(False, (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])) if len(h) else np.zeros(0, bool)
    out[:, 3] = np.bincount(text[order][twin], minlength=len(rows))
    out[:, 8] = np.bincount(text, minlength=len(rows))
    if len(words.starts):
        w = words.hashes()
        owner = np.repeat(np.arange(len(rows)), words.counts)
        order = np.lexsort((w, owner))
        fresh = np.append(True, (w[order][1:] != w[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
        out[:, 5] = np.bincount(owner[order][fresh], minlength=len(rows))
        first, _, text = words.windows(WINDOW)
        if len(first):
            g = tb.gram_hashes(w, first, WINDOW)
            order = np.lexsort((g, text))
            same = (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
            twice = np.append(same, False) | np.append(False, same)
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, first[order][twice], 1)
            np.add.at(cover, first[order][twice] + WINDOW, -1)
            out[:, 4] = np.bincount(owner, np.cumsum(cover)[:-1] > 0, minlength=len(rows)).astype(np.int64)
    return out


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, and a long for each of the rule statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tb.rows_of(batch.column(1))
            parts = [rule_block(rows[lo:hi]) for lo, hi in tb.blocks(rows)]
            if parts:
                table = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k].copy()) for k in range(len(_NAMES)))], ["id", *_NAMES])

    schema = "id long, " + ", ".join(f"{x} long" for x in _NAMES)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def shares(table: np.ndarray) -> np.ndarray:
    """The statistics as shares of a text, drawn to a usual value in short ones, and the log of its length."""
    n, chars, symbols, lines, repeats, distinct, capitals, signs, full = table.T.astype(np.float64)
    by_word = [(chars + 50) / (n + 10), symbols / (n + 20), repeats / (n + 20), np.log(distinct + 5) / np.log(n + 5), (signs + 2.5) / (n + 20), (full + 2) / (n + 20)]
    return np.stack([np.log(n + 20), *by_word, lines / (full + 5), (capitals + 2) / (chars + 100)], 1)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """The statistics in a batch."""
    return np.stack([batch.column(x).to_numpy() for x in _NAMES], 1)


def order_statistics(rows: DataFrame, ranks: list[int]) -> np.ndarray:
    """The values of these ranks (from 0) of each share over all rows: (ranks, shares).

    A radix selection: each pass counts the next DIGIT bits of the values that begin as a wanted one does, so neither driver nor tasks
    hold more than 2^DIGIT counts a rank and share, whatever the rows are.
    """
    # bits of a double in the order of numbers: without the sign set, or with all turned
    heads = np.zeros((len(ranks), len(_NAMES)), np.uint64)
    left = np.repeat(np.array(ranks, np.int64)[:, None], len(_NAMES), 1)
    for shift in range(64 // DIGIT * DIGIT, -1, -DIGIT):
        wanted = [(k, head) for k in range(len(_NAMES)) for head in np.unique(heads[:, k])]

        def run(batches: Iterator[pa.RecordBatch], wanted: list = wanted, shift: int = shift) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(wanted), 1 << DIGIT), np.int64)
            for batch in batches:
                bits = (shares(_columns(batch)) + 0.0).view(np.uint64)
                digits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> np.uint64(shift)
                for i, (k, head) in enumerate(wanted):
                    own = digits[:, k]
                    own = own[own >> np.uint64(DIGIT) == head] & np.uint64((1 << DIGIT) - 1)
                    counts[i] += np.bincount(own.astype(np.int64), minlength=1 << DIGIT)
            which, digit = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(digit), pa.array(counts[which, digit])], ["which", "digit", "n"])

        found = np.zeros((len(wanted), 1 << DIGIT), np.int64)
        for r in rows.select(*_NAMES).mapInArrow(run, "which long, digit long, n long").groupBy("which", "digit").agg(F.sum("n").alias("n")).collect():
            found[r["which"], r["digit"]] = r["n"]
        upto = {(k, int(head)): np.cumsum(found[i]) for i, (k, head) in enumerate(wanted)}
        for (i, k), head in np.ndenumerate(heads):
            sums = upto[k, int(head)]
            digit = int(np.searchsorted(sums, left[i, k], "right"))
            left[i, k] -= sums[digit - 1] if digit else 0
            heads[i, k] = (int(head) << DIGIT) | digit
    return np.where(heads >> np.uint64(63), heads ^ np.uint64(1 << 63), ~heads).view(np.float64)


class Usual:
    """The range of each share in good text."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rows: int):
        # a range seen in few rows is widened
        more = 10 / max(1, rows) * (high - low)
        self.low, self.high = low - more, high + more

    @classmethod
    def fit(cls, good: DataFrame, rows: int) -> Usual:
        """The range from TAIL to 1 - TAIL of all ``rows`` good rows; without any, everything is usual."""
        if not rows:
            return cls(np.full(9, -np.inf), np.full(9, np.inf), 0)
        places = [(rows - 1) * TAIL, (rows - 1) * (1 - TAIL)]
        ranks = [min(rows - 1, int(p) + more) for p in places for more in (0, 1)]
        x = order_statistics(good, ranks)
        return cls(*(x[2 * i] + (x[2 * i + 1] - x[2 * i]) * (p - int(p)) for i, p in enumerate(places)), rows)

    def beyond(self, table: np.ndarray) -> np.ndarray:
        """What the trees split on: how far each share is below or above its range, in widths of it, by its logarithm."""
        x = shares(table)
        far = (x - np.clip(x, self.low, self.high)) / (self.high - self.low + 1e-9)
        return np.sign(far) * np.log1p(4 * np.abs(far))


class Forest:
    """Isolation trees over rows of features."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.depth = self.deep(self.size)
        self.trees = [self.grow(rows[rng.choice(len(rows), self.size, replace=False)], np.ones(self.size, np.int64), self.depth, rng) for _ in range(trees)] if len(rows) else []

    @classmethod
    def fit(cls, known: DataFrame, rows: int, usual: Usual, trees: int = TREES, size: int = TREE_ROWS) -> Forest:
        """Trees over all ``rows`` rows (key, statistics) of ``known``.

        Each row goes to the tree of its least hash, or to as many as give trees ``size`` rows. A task holds one tree's rows, usual
        ones as one with a count. Depth is bounded as for ``size`` rows: what a leaf holds beyond that counts by ``expected``.
        """
        out = cls(np.zeros((0, len(_NAMES))))
        if not rows:
            return out
        each = min(trees, -(-trees * size // rows))
        out.size, out.depth = rows * each // trees, cls.deep(min(size, rows))
        sent = tb.share(known.sparkSession, usual)
        depth = out.depth
        names = [f"x{k}" for k in range(len(_NAMES))]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent()
            salts = tb.mix(np.arange(1, trees + 1, dtype=np.uint64))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = own.beyond(_columns(batch))
                h = tb.mix(batch.column("key").to_numpy().view(np.uint64)[:, None] ^ salts)
                tree = np.argpartition(h, each - 1, 1)[:, :each].ravel()
                row = np.repeat(np.arange(len(x)), each)
                odd = x.any(1)[row]
                usual_rows = np.bincount(tree[~odd], minlength=trees)
                some = np.flatnonzero(usual_rows)
                x = np.concatenate([x[row[odd]], np.zeros((len(some), x.shape[1]))])
                tree = np.append(tree[odd], some)
                n = np.append(np.ones(int(odd.sum()), np.int64), usual_rows[some])
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(n), *(pa.array(x[:, k].copy()) for k in range(x.shape[1]))], ["tree", "n", *names])

        def grow(table: pa.Table) -> pa.Table:
            tree = table.column("tree")[0].as_py()
            # in an order of their own, whatever task they come from
            x, place = np.unique(np.stack([table.column(k).to_numpy() for k in names], 1), axis=0, return_inverse=True)
            n = np.zeros(len(x), np.int64)
            np.add.at(n, place.ravel(), table.column("n").to_numpy())
            grown = cls.grow(x, n, depth, np.random.default_rng(tree))
            return pa.table({"tree": [tree], **{name: pa.array([part]) for name, part in zip(("feature", "split", "length"), grown, strict=True)}})

        dealt = known.select("key", *_NAMES).mapInArrow(deal, "tree long, n long, " + ", ".join(f"{x} double" for x in names))
        grown = dealt.groupBy("tree").applyInArrow(grow, "tree long, feature array<long>, split array<double>, length array<double>").collect()
        out.trees = [(np.array(r["feature"]), np.array(r["split"]), np.array(r["length"])) for r in sorted(grown, key=lambda r: r["tree"])]
        return out

    @staticmethod
    def deep(size: int) -> int:
        """Depth at which trees of ``size`` rows end."""
        return max(1, int(np.ceil(np.log2(max(2, size)))))

    @staticmethod
    def expected(n: np.ndarray) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, np.float64)
        m = np.maximum(n, 2)
        return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))

    @classmethod
    def grow(cls, rows: np.ndarray, counts: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays by heap position: column (-1 at a leaf), split, path length at a leaf. Row i stands for ``counts[i]`` equal ones."""
        total = 2 ** (limit + 1)
        column, split, length = np.full(total, -1), np.zeros(total), np.zeros(total)
        todo = [(1, rows, counts, 0)]
        while todo:
            at, own, n, depth = todo.pop()
            spread = np.flatnonzero(own.min(0) < own.max(0)) if len(own) else []
            if depth == limit or not len(spread):
                length[at] = depth + cls.expected(n.sum())
                continue
            k = rng.choice(spread)
            column[at], split[at] = k, rng.uniform(own[:, k].min(), own[:, k].max())
            left = own[:, k] < split[at]
            todo += [(2 * at, own[left], n[left], depth + 1), (2 * at + 1, own[~left], n[~left], depth + 1)]
        return column, split, length

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1), to nine decimals: short mean paths are near 1. A forest of no rows gives 0.5."""
        if not self.trees:
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, split, length in self.trees:
            at = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                k = column[at]
                at = np.where(k < 0, at, 2 * at + (rows[every, np.maximum(k, 0)] >= split[at]))
            total += length[at]
        return np.round(2.0 ** (-total / len(self.trees) / max(float(self.expected(self.size)), 1e-9)), 9)


def calibrate(scored: DataFrame, cost: float = COST) -> float:
    """The threshold of best balanced accuracy over all rows (score, good), among those above which lie at most ``cost`` of the good
    rows, or one; infinity without rows of both kinds. The greatest of several.

    Every score is tried. Rows are counted by score, scores by bucket; a bucket has at most 10^9 / BUCKETS scores of nine decimals.
    """
    kinds = [F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")]
    counts = materialize(scored.groupBy("score").agg(*kinds).withColumn("bucket", F.floor(F.col("score") * BUCKETS)), "scores")
    found = sorted(((r["bucket"], r["good"], r["bad"]) for r in counts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()), reverse=True)
    good, bad = (sum(r[i] for r in found) for i in (1, 2))
    best = np.inf
    if good and bad:
        # of few rows one may always be odd
        most = max(1, int(cost * good))
        above, over = [], np.zeros(2, np.int64)
        for bucket, *own in found:
            if over[0] <= most:
                above.append((bucket, int(over[0]), int(over[1])))
            over += own
        tops = scored.sparkSession.createDataFrame(above, "bucket long, good_over long, bad_over long")
        higher = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        past = [(F.col(f"{x}_over") + F.coalesce(F.sum(x).over(higher), F.lit(0))).alias(f"{x}_past") for x in ("good", "bad")]
        tried = counts.join(tops, "bucket").select("score", *past).where(F.col("good_past") <= most)
        gain = F.col("bad_past") / F.lit(float(bad)) - F.col("good_past") / F.lit(float(good))
        best = tried.orderBy(gain.desc(), F.desc("score")).first()["score"]
    discard(counts)
    return float(best)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none. ``word_chars`` counts their code points, ``n_symbols``
    the characters of ``#*$%&|<>``, ``n_dup_lines`` the lines (split at \\n) with a word that equal an earlier line of the text,
    ``n_repeat_words`` the words inside windows of 8 words that stand twice or more in the text, the first included.
    ``base_failed``: fewer than 20 words, or more than 30 in 100 repeated. ``kept``: not failed, and an anomaly score at most
    the calibrated threshold; without labels of both kinds only the base decides. Range, trees and threshold come from all labelled
    rows that did not fail, rows that are equal in all counts once an id. Repeated rows are returned as often, null ids too. Other
    columns are ignored, whatever their names.
    """
    stats = materialize(rule_statistics(docs, id_col, text_col), "rules")
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null")
    known = known.groupBy("_id").agg((F.avg("_y") >= 0.5).alias("good"))
    sound = stats.where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words")
    known = sound.join(known, sound.id == known["_id"]).select("good", "id", *_NAMES).distinct()
    known = materialize(known.select("good", *_NAMES, F.xxhash64("id", *_NAMES).alias("key")), "labelled")
    number = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    usual = Usual.fit(known.where("good"), number.get(True, 0))
    forest = Forest.fit(known, sum(number.values()), usual)
    sent = tb.share(docs.sparkSession, (usual, forest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grown = sent()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(grown.scores(own.beyond(_columns(batch)))), batch.column("good")], ["score", "good"])

    threshold = calibrate(known.select("good", *_NAMES).mapInArrow(score, "score double, good boolean"))
    discard(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grown = sent()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _columns(batch)
            score = grown.scores(own.beyond(table))
            failed = (table[:, 0] < 20) | (100 * table[:, 4] > 30 * table[:, 0])
            kept = ~failed & (score <= threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(score), pa.array(kept)], ["id", *_NAMES[:5], "base_failed", "anomaly", "kept"])

    schema = "id long, " + ", ".join(f"{x} long" for x in _NAMES[:5]) + ", base_failed boolean, anomaly double, kept boolean"
    return stats.mapInArrow(run, schema).withColumnRenamed("id", id_col)
