"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network with calibrated temperature.

Tokens are runs of word characters and runs of other visible characters. Every token has a sparse random index vector, derived
from its hash. The context vector of a token adds up the index vectors of its neighbours in the fitting sample; tokens outside
the vocabulary share the context vector of their shape (case, digits, signs, length), which is learned like any other. A word
vector is both side by side. A document is the mean of its tokens' vectors, with the length of the index part (high where few
words repeat), by itself and against what so many different tokens would have, and the log of the token count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .samples import labelled_texts

#: Bounds of the fitting sample: labelled rows, and bytes of each. Longer labelled rows are not fitted on, but are scored.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32_768
#: Most tokens with a vector of their own.
VOCABULARY = 20_000
DIMENSIONS, NONZERO, WINDOW, HIDDEN = 64, 8, 2, 32
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """The class of a token without a vector of its own."""
    if token.isdigit():
        kind = "9"
    elif not (token[0].isalnum() or token[0] == "_"):
        kind = "!"
    elif len(token) > 1 and token.isupper():
        kind = "XX"
    else:
        kind = "Xx" if token[0].isupper() else "xx"
    return f"\x00{kind}{min(len(token).bit_length(), 5)}"


def index_vectors(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each token's index vector, the same in every run."""
    h = tb.mix(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in tokens], np.uint64))[:, None]
    turn = np.arange(NONZERO, dtype=np.uint64)
    places = (h >> (turn * np.uint64(6))) & np.uint64(DIMENSIONS - 1)
    signs = (h >> (turn + np.uint64(48))) & np.uint64(1)
    return places.astype(np.int64), 2.0 * signs.astype(np.float64) - 1.0


class Model:
    """Word vectors, network and temperature."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.layers = None
        if len(set(labels.tolist())) < 2:
            return
        seen: Counter = Counter()
        for text in texts:
            seen.update(set(TOKEN.findall(text)))
        common = sorted((x for x, n in seen.items() if n >= 3), key=lambda x: (-seen[x], x))[:VOCABULARY]
        del seen
        shapes = [f"\x00{k}{n}" for k in ("9", "!", "XX", "Xx", "xx") for n in range(1, 6)]
        self.ids = {x: i for i, x in enumerate([*common, *shapes])}
        places, signs = index_vectors(list(self.ids))
        index = np.zeros((len(self.ids), DIMENSIONS), np.float32)
        np.add.at(index, (np.arange(len(index))[:, None], places), signs)
        # token numbers of the whole sample; texts are kept apart by WINDOW fillers
        gap = np.full(WINDOW, -1, np.int32)
        run = np.concatenate([x for t in texts for x in (np.array([self.id_of(w) for w in TOKEN.findall(t)], np.int32), gap)])
        # frequent neighbours tell less
        light = index / np.sqrt(1 + np.bincount(run[run >= 0], minlength=len(index)))[:, None]
        context = np.zeros_like(index)
        for step in range(1, WINDOW + 1):
            left, right = run[:-step], run[step:]
            both = (left >= 0) & (right >= 0)
            for word, near in ((left[both], right[both]), (right[both], left[both])):
                order = np.argsort(word, kind="stable")
                for lo in range(0, len(order), 1 << 16):
                    part = order[lo : lo + (1 << 16)]
                    edge = np.flatnonzero(np.diff(word[part], prepend=-1))
                    context[word[part][edge]] += np.add.reduceat(light[near[part]], edge, axis=0)
        length = np.linalg.norm(context, axis=1, keepdims=True)
        self.contexts = context / np.maximum(length, 1e-6)
        x = np.stack([self.pooled(t) for t in texts])
        self.center, self.scale = x.mean(0), x.std(0) + 1e-3
        self._fit((x - self.center) / self.scale, labels.astype(np.float64), rng)

    def id_of(self, token: str) -> int:
        return self.ids[token] if token in self.ids else self.ids[shape(token)]

    def pooled(self, text: str) -> np.ndarray:
        counts = Counter(TOKEN.findall(text))
        total = counts.total()
        own, near, length = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS, np.float32), 0.0
        if total:
            ids = self.ids
            share = np.fromiter(counts.values(), np.float32, len(counts)) / total
            places, signs = index_vectors(list(counts))
            own = np.bincount(places.ravel(), (signs * share[:, None]).ravel(), DIMENSIONS) / np.sqrt(NONZERO)
            near = share @ self.contexts[[ids[x] if x in ids else ids[shape(x)] for x in counts]]
            length = float(own @ own)
        return np.concatenate([own, near, [np.sqrt(length), np.log(length * total + 1e-3), np.log1p(total)]])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 60, batch: int = 64) -> None:
        """Adam on the log loss of four fifths; the temperature is the one of least loss on the last fifth."""
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first = [np.zeros_like(p) for p in self.layers]
        second = [np.zeros_like(p) for p in self.layers]
        share = np.clip(y[own].mean(), 0.02, 0.98)
        step = 0
        for _ in range(rounds):
            rng.shuffle(own)
            for lo in range(0, len(own), batch):
                part = own[lo : lo + batch]
                w1, b1, w2, b2 = self.layers
                hidden = np.tanh(x[part] @ w1 + b1)
                p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
                # both classes weigh the same
                g = (p - y[part]) * np.where(y[part] > 0, 0.5 / share, 0.5 / (1 - share)) / len(part)
                back = g[:, None] * w2 * (1 - hidden**2)
                step += 1
                for k, d in enumerate((x[part].T @ back + 1e-3 * w1, back.sum(0), hidden.T @ g + 1e-3 * w2, g.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d**2
                    self.layers[k] = self.layers[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z = self._logit(x[held])
            loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -z, z) / t).mean()
            self.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        if self.layers is None or not texts:
            return np.full(len(texts), self.prior)
        x = (np.stack([self.pooled(t) for t in texts]) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the labelled rows whose crc32 of the id as text is not 1 modulo 3: of these the SAMPLE_ROWS of least id hash, up to SAMPLE_BYTES each."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null")
    known = known.where("pmod(crc32(cast(cast(_id as string) as binary)), 3) != 1").groupBy("_id").agg((F.avg("_y") >= 0.5).alias("_y"))
    rows = labelled_texts(docs, known, id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES)
    return Model([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    ``held_out`` marks ids whose crc32 as text is 1 modulo 3; their labels are never read. Scores depend on nothing but the
    whole text: null and empty texts have the score of no tokens. Without labels of both kinds every score is the share of
    label 1, or 0.5 without any. Several labels of one id count by their mean. Repeated rows are returned as often; a null id is
    not held out. Other columns are ignored, whatever their names.
    """
    sent = tb.share(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            texts = batch.column(1)
            out = [model.scores([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]) for lo, hi in tb.blocks(tb.rows_of(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    held = F.coalesce(F.expr("pmod(crc32(cast(cast(id as string) as binary)), 3) = 1"), F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more."""
    sent = tb.share(docs.sparkSession, fit(docs, labels, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            texts = batch.column(place)
            for lo, hi in tb.blocks(tb.rows_of(texts)):
                part = batch.slice(lo, hi - lo)
                good = model.scores([t or "" for t in part.column(place).to_pylist()]) >= 0.5
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
