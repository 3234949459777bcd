import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality_classifier as qc
from lodestone.llm import quality_rules as qr

DOCS = "doc_id long, text string, score string, kept int"
LABELS = "doc_id long, quality int"


def corpus(n=400):
    r = random.Random(4)
    common = "the of and to in is that for with was on are be this".split()
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(r.randint(30, 200))]
        bad = r.random() < 0.25
        if bad:
            kind = r.randrange(3)
            if kind == 0:
                words = [w + r.choice(["$$$", "###", "%%%"]) for w in words]
            elif kind == 1:
                words = [w.upper() + "!!" for w in words]
            else:
                words = words[:5] * 9
        rows.append((i, " ".join(words).capitalize(), "s", 1))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None, None, None), (1001, "", None, None), (None, "text of no id", None, None), (1002, "a" * 3_000_000, None, None), (1002, "a", None, None)]
    out = qc.score(spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels + [(3, None), (None, 1)], LABELS)).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert len({r.score for r in out if r.doc_id in (1000, 1001)}) == 1
    truth = dict(labels)
    held = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean(held) > 0.9
    # held-out labels are never read
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    again = qc.score(spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(turned, LABELS)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_classifier_edges(spark):
    rows, labels = corpus(60)
    df = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in qc.score(df, none).collect()} == {0.5}
    assert {r.score for r in qc.score(df, spark.createDataFrame([(i, 1) for i, _ in labels], LABELS)).collect()} == {1.0}
    assert qc.score(df.limit(0), none).collect() == []
    kept = qc.keep_good(df, none)
    assert kept.columns == df.columns and kept.count() == 60


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g, n in collections.Counter(grams).items() if n > 1}
    cover = {i + j for i, g in enumerate(grams) if g in twice for j in range(8)}
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), failed


def test_rules_as_brute_force(spark):
    r = random.Random(8)
    rows, labels = corpus(200)
    for i in range(150):
        line = " ".join(r.choice(["é", "b#", "<c>", "dd"]) for _ in range(r.randint(0, 12)))
        rows.append((500 + i, r.choice(["\n", "\n\n", " \n"]).join(r.choice([line, line + " ", "", " ", "x", "uü|"]) for _ in range(r.randint(0, 9))), None, None))
    rows += [(None, "\n", None, None), (900, None, None, None), (901, "", None, None), (902, "w " * 200_000, None, None), (902, "w\n" * 30, None, None)]
    out = qr.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((i or -1, *rules(t)) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in out)
    truth = dict(labels)
    known = [(r.kept, truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert np.mean([k for k, y in known if y]) > 0.97 and np.mean([k for k, y in known if not y]) < 0.6


def test_rules_edges(spark):
    rows, _ = corpus(30)
    df = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in qr.judge(df, none).collect())
    assert qr.judge(df.limit(0), none).collect() == []


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 4))
    forest = qr.Forest(rows)
    s = forest.scores(np.concatenate([rows[:200], rng.normal(8, 1, (20, 4))]))
    assert s[200:].min() > np.quantile(s[:200], 0.99)
    assert qr.Forest(np.zeros((0, 4))).scores(rows).tolist() == [0.5] * 500
    assert qr.Forest(np.zeros((5, 4))).scores(rows).std() < 1e-9


def test_forest_as_plain_walks():
    r = np.random.default_rng(2)
    rows = np.round(r.normal(size=(300, 4)), 1)
    forest = qr.Forest(rows, trees=15, size=64, seed=3)

    def harmonic(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(tree, x):
        column, split, length = tree
        at = 1
        while column[at] >= 0:
            at = 2 * at + int(x[column[at]] >= split[at])
        return length[at]

    want = [2 ** (-np.mean([walk(t, x) for t in forest.trees]) / harmonic(64)) for x in rows]
    assert np.allclose(forest.scores(rows), want)
    far = np.concatenate([rows, [[9.0, -9.0, 9.0, 9.0]]])
    assert forest.scores(far).argmax() == 300


def test_rules_find_stuttered_words(spark):
    rows, labels = corpus(300)
    r = random.Random(9)
    odd = []
    for i in range(300, 330):
        words = [w for _ in range(30) for w in ["".join(r.choice("mnopq") for _ in range(5))] * r.randint(5, 7)]
        odd.append((i, " ".join(words), "s", 1))
    labels += [(i, 0) for i, *_ in odd[:20]]
    out = {x.doc_id: x for x in qr.judge(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert not any(out[i].base_failed for i, *_ in odd) and not any(out[i].kept for i, *_ in odd[20:])
    truth = dict(labels)
    assert np.mean([x.kept for i, x in out.items() if truth.get(i)]) > 0.95


def test_rules_use_every_labelled_row(spark):
    # bad texts in capitals stand only past the 6000 labelled rows of least id hash
    order = [x.id for x in spark.range(7500).orderBy(F.xxhash64("id")).collect()]
    r = random.Random(6)
    rows, labels, late = [], [], set(order[6200::2])
    for i in range(7500):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(r.randint(24, 40))]
        bad = i not in late and r.random() < 0.05
        if bad:
            words = [w + r.choice(["$$$", "###"]) for w in words]
        text = " ".join(words).capitalize()
        rows.append((i, text.upper() if i in late else text, None, None))
        labels.append((i, 0 if bad or i in late else 1))
    out = {x.doc_id: x.kept for x in qr.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert np.mean([out[i] for i, y in labels if y]) > 0.98
    assert not any(out[i] for i, y in labels if not y)


def test_range_of_all_rows(spark):
    r = np.random.default_rng(5)
    table = r.integers(0, 400, (3000, 9)) * r.integers(0, 2, (3000, 9))
    df = spark.createDataFrame([tuple(map(int, x)) for x in table], ", ".join(f"{x} long" for x in qr._NAMES)).repartition(5)
    x = np.sort(qr.shares(table), 0)
    ranks = [0, 7, 8, 1500, 2998, 2999]
    assert (qr.order_statistics(df, ranks) == x[ranks]).all()
    usual = qr.Usual.fit(df, 3000)
    low, high = np.quantile(x, [qr.TAIL, 1 - qr.TAIL], axis=0)
    more = 10 / 3000 * (high - low)
    assert np.allclose(usual.low, low - more) and np.allclose(usual.high, high + more)
    assert not qr.Usual.fit(df.limit(0), 0).beyond(table).any()


def test_forest_of_all_rows(spark):
    r = np.random.default_rng(7)
    table = r.integers(100, 140, (2000, 9))
    table[:40, 2] += 500
    names = ", ".join(f"{x} long" for x in qr._NAMES)
    df = spark.createDataFrame([(int(k), *map(int, x)) for k, x in zip(r.integers(-(2**62), 2**62, 2000), table)], "key long, " + names)
    usual = qr.Usual.fit(df.where("n_symbols < 500"), 1960)
    forest = qr.Forest.fit(df, 2000, usual, trees=16, size=64)
    assert len(forest.trees) == 16 and forest.size == 125 and forest.depth == 6
    again = qr.Forest.fit(df.repartition(3), 2000, usual, trees=16, size=64)
    assert all((a == b).all() for x, y in zip(forest.trees, again.trees) for a, b in zip(x, y))
    s = forest.scores(usual.beyond(table))
    assert s[:40].min() > np.quantile(s[40:], 0.99)
    # a tree of counted rows is the tree of the rows themselves
    own = np.repeat(np.eye(3), [5, 1, 2], axis=0)
    plain = qr.Forest.grow(own, np.ones(8, np.int64), 4, np.random.default_rng(1))
    counted = qr.Forest.grow(np.eye(3), np.array([5, 1, 2]), 4, np.random.default_rng(1))
    assert all((a == b).all() for a, b in zip(plain, counted))


def test_threshold_of_all_rows(spark):
    r = np.random.default_rng(3)
    for n, shift, cost in ((1, 0.1, 0.01), (40, 0.1, 0.01), (3000, 0.15, 0.01), (3000, 0.02, 0.2), (3000, -0.2, 0.05)):
        good = r.random(n) < 0.8
        scores = np.round(np.clip(r.normal(0.5 + shift * ~good, 0.05), 0, 1), 9 if n > 2000 else 2)
        got = qr.calibrate(spark.createDataFrame(list(zip(scores.tolist(), good.tolist())), "score double, good boolean"), cost)
        if not good.any() or good.all():
            assert got == np.inf
            continue
        most = max(1, int(cost * good.sum()))
        ways = [t for t in np.unique(scores) if (scores[good] > t).sum() <= most]
        assert got == max(ways, key=lambda t: (np.mean(scores[~good] > t) - np.mean(scores[good] > t), t))
