"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with ascending theta. The expected
severity is the sum of these over k. Features are the distinct lower-cased words of the whole text, and the stems of STEM letters on
which it has two words or more: in languages that build many words on a stem each is rare by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .samples import labelled_texts

#: Bounds of the fitting sample: labelled rows, and bytes of each. Longer labelled rows are not fitted on, but are scored.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32_768
#: Most words with a weight, and the grades that toxic rows are split into where labels tell only toxic or not.
FEATURES, GRADES = 2000, 3
#: Deviations from chance beyond which a word is a feature.
SURE = 4.0
#: What a toxic row weighs in the loss beside a clean one, of which there are many more.
WEIGHT = 5.0
#: Letters of a stem; words longer than it by two have it.
STEM = 5
WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and ``stem*`` for each stem of several of them."""
    words = set(WORD.findall(text.lower()))
    stems = Counter(w[:STEM] for w in words if len(w) >= STEM + 2)
    return words | {f"{x}*" for x, n in stems.items() if n > 1}


def _contrast(rows: list[set[str]], bad: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, how many times likelier they are in a bad row, and the deviations of that difference of shares from none."""
    inside = Counter(w for r, b in zip(rows, bad, strict=True) if b for w in r)
    outside = Counter(w for r, b in zip(rows, bad, strict=True) if not b for w in r)
    words = sorted(w for w, n in (inside + outside).items() if n >= 3)
    n, m = bad.sum() + 1.0, (~bad).sum() + 1.0
    a = np.array([inside[w] for w in words]) + 0.5
    b = np.array([outside[w] for w in words]) + 0.5
    both = (a + b) / (n + m)
    return words, (a / n) / (b / m), (a / n - b / m) / np.sqrt(both * np.maximum(1 - both, 1e-9) * (1 / n + 1 / m))


def grades_of(rows: list[set[str]], label: np.ndarray) -> np.ndarray:
    """Ordinal grades: labels of more than two kinds as they are; else toxic rows by how many distinct marker words they have.

    Markers are words at least twenty times likelier in toxic rows, SURE deviations from chance. Toxic rows are cut at the
    terciles of their counts into grades 1 to GRADES.
    """
    if len(set(label.tolist())) > 2 or not (label > 0).any():
        return label.astype(np.int64)
    words, times, sure = _contrast(rows, label > 0)
    marker = {w for w, t, s in zip(words, times, sure, strict=True) if t > 20 and s > SURE}
    count = np.array([len(r & marker) for r in rows])
    cuts = np.unique(np.quantile(count[label > 0], np.arange(1, GRADES) / GRADES))
    return np.where(label > 0, 1 + np.searchsorted(cuts, count, "left"), 0)


class Model:
    """Shared weights and ascending thresholds."""

    def __init__(self, texts: list[str], label: np.ndarray, rounds: int = 400):
        rows = [words_of(t) for t in texts]
        grade = grades_of(rows, label) if len(rows) else label.astype(np.int64)
        self.weights: dict[str, float] = {}
        self.theta = np.zeros(0)
        if len(set(grade.tolist())) < 2:
            self.base = float(grade.mean()) if len(grade) else 0.0
            return
        self.base = 0.0
        top = int(grade.max())
        words, _, sure = _contrast(rows, grade > 0)
        best = sorted((i for i in range(len(words)) if abs(sure[i]) > SURE), key=lambda i: (-abs(sure[i]), words[i]))[:FEATURES]
        ids = {words[i]: k for k, i in enumerate(best)}
        found = [[ids[w] for w in r if w in ids] for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        column = np.array([k for f in found for k in f], np.int64)
        above, share = grade[:, None] > np.arange(top), np.where(grade > 0, WEIGHT, 1.0)[:, None] / len(rows)
        weight, self.theta = np.zeros(len(ids)), np.log((1.5 - above.mean(0)) / (above.mean(0) + 0.5)) + np.arange(top) * 1e-2
        moment = [np.zeros(len(ids)), np.zeros(top)], [np.zeros(len(ids)), np.zeros(top)]
        for step in range(1, rounds + 1):
            z = np.bincount(row, weight[column], minlength=len(rows))
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - self.theta, -30, 30)))
            g = (p - above) * share
            total = np.bincount(column, g.sum(1)[row], minlength=len(ids)) + 2e-4 * weight
            for k, d in enumerate((total, -g.sum(0))):
                moment[0][k] = 0.9 * moment[0][k] + 0.1 * d
                moment[1][k] = 0.999 * moment[1][k] + 0.001 * d**2
                move = 0.05 * (moment[0][k] / (1 - 0.9**step)) / (np.sqrt(moment[1][k] / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    weight = weight - move
                else:
                    # thresholds stay in order
                    self.theta = np.maximum.accumulate(self.theta - move)
        self.weights = {w: float(weight[k]) for w, k in ids.items() if abs(weight[k]) > 1e-3}

    def severities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the chance of any, of each text."""
        get = self.weights.get
        z = np.array([sum(get(w, 0.0) for w in words_of(t)) for t in texts], np.float64)
        if not len(self.theta):
            return np.full(len(texts), self.base), np.full(len(texts), float(self.base > 0))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - self.theta, -30, 30)))
        return p.sum(1), p[:, 0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the SAMPLE_ROWS labelled rows of least id hash, up to SAMPLE_BYTES each."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y >= 0")
    rows = labelled_texts(docs, known.groupBy("_id").agg(F.max("_y").alias("_y")), id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES)
    return Model([t for _, t, _ in rows], np.array([y for *_, y in rows], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, expected_severity, severity, toxic) for every row of ``docs``.

    ``expected_severity`` runs from 0 to the highest grade, ``severity`` is its nearest whole grade, ``toxic`` says whether any
    grade above 0 is likelier than not. Null and empty texts are scored as texts without words. Where labels tell one grade
    only, or there are none, all rows get that grade, or 0. Repeated rows are returned as often, null ids too. Other columns are
    ignored, whatever their names.
    """
    sent = tb.share(docs.sparkSession, fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in tb.blocks(tb.rows_of(texts)):
                expected, some = model.severities([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                whole = np.floor(expected + 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(expected), pa.array(whole), pa.array(some >= 0.5)], ["id", "expected_severity", "severity", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, expected_severity double, severity int, toxic boolean").withColumnRenamed("id", id_col)
