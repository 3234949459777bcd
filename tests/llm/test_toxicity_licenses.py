import random

import numpy as np

from lodestone.llm import licenses, toxicity

DOCS = "doc_id long, text string, toxic string"
BAD = ["idiot", "clown", "scum", "trash"]


def corpus(n=300):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3))) for _ in range(r.randint(10, 200))]
        grade = r.choice([0, 0, 0, 0, 1, 2, 3])
        for w in r.sample(BAD, grade):
            words.insert(r.randint(0, len(words)), r.choice([w, w.upper() + "!", w + ","]))
        rows.append((i, " ".join(words), None))
        labels.append((i, int(grade > 0), grade))
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus()
    extra = [(900, None, "x"), (901, "", "x"), (None, "Idiot", None), (902, "a b " * 100_000 + "scum clown trash", None), (902, "a", None)]
    df = spark.createDataFrame(rows + extra, DOCS)
    out = toxicity.score(df, spark.createDataFrame([x[:2] for x in labels[:200]], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: y for i, y, _ in labels[200:]}
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in out if r.doc_id in truth]) > 0.95
    grade = {i: g for i, _, g in labels[200:]}
    means = [np.mean([r.expected_severity for r in out if grade.get(r.doc_id) == g]) for g in range(4)]
    assert means == sorted(means) and all(r.severity == int(r.expected_severity + 0.5) for r in out)
    assert {r.toxic for r in out if r.doc_id in (900, 901)} == {False}
    assert {r.toxic for r in out if r.doc_id is None} == {True}
    # labels that are grades already
    out = toxicity.score(df, spark.createDataFrame([(i, g) for i, _, g in labels[:200]], "doc_id long, toxic int")).collect()
    assert np.corrcoef(*zip(*[(r.expected_severity, grade[r.doc_id]) for r in out if r.doc_id in grade], strict=True))[0, 1] > 0.9


def test_toxicity_edges(spark):
    rows, _ = corpus(20)
    df = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.expected_severity, r.severity, r.toxic) for r in toxicity.score(df, none).collect()} == {(0.0, 0, False)}
    assert toxicity.score(df.limit(0), none).collect() == []


def test_severity_as_plain_sums():
    rows, labels = corpus()
    model = toxicity.Model([t for _, t, _ in rows], np.array([g for *_, g in labels]))
    expected, some = model.severities([t for _, t, _ in rows])
    assert list(model.theta) == sorted(model.theta) and len(model.theta) == 3
    for k in range(0, 300, 17):
        words = {w for w in "".join(c if c.isalnum() or c == "_" else " " for c in rows[k][1].lower()).split()}
        stems = {w[:5] for w in words if len(w) >= 7}
        own = words | {f"{s}*" for s in stems if sum(w[:5] == s and len(w) >= 7 for w in words) > 1}
        z = sum(model.weights.get(w, 0.0) for w in own)
        above = [1 / (1 + np.exp(t - z)) for t in model.theta]
        assert np.isclose(expected[k], sum(above)) and np.isclose(some[k], above[0])

    def loss(m):
        z = np.array([sum(m.weights.get(w, 0.0) for w in toxicity.words_of(t)) for _, t, _ in rows])
        p = 1 / (1 + np.exp(-(z[:, None] - m.theta)))
        above = np.array([g for *_, g in labels])[:, None] > np.arange(3)
        weight = np.where(above[:, :1], toxicity.WEIGHT, 1.0)
        return -(weight * np.log(np.where(above, p, 1 - p))).sum() / len(rows)

    # the cumulative-link likelihood, far above that of thresholds alone
    best, kept = loss(model), model.weights
    model.weights = {}
    assert best < 0.5 * loss(model)
    # one weight vector serves all thresholds: a grade more means a higher sum
    model.weights = kept
    sums = [np.mean([sum(kept.get(w, 0.0) for w in toxicity.words_of(t)) for _, t, _ in [r for r, l in zip(rows, labels) if l[2] == g]]) for g in range(4)]
    assert sums == sorted(sums)


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_patience_is_an_alignment():
    r = random.Random(3)
    for _ in range(300):
        a = [r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.5 else [r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 25))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= common_length(a, b)
    assert licenses.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-notice"]
    cut = " ".join(w for i, w in enumerate(mit.split()) if i % 10)
    rows = [(1, "some words before. " + mit + " and after", None), (2, cut, None), (3, f"{apache}\n{apache.upper()}\nlicense", "x"), (4, None, None), (5, "", None)]
    rows += [(None, "Released under the MIT  license", None), (6, "the license of the version", None), (7, "wörter " * 100_000 + apache, None), (3, "plain", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    out = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    n = len(licenses.words_of(mit))
    got = {(r[0], r[1]): r for r in out}
    assert got[1, "MIT"][2:] == (1.0, 3, 2 + n)
    assert 0.85 < got[2, "MIT"][2] < 0.95
    assert [r[3:] for r in out if r[:2] == (3, "Apache-2.0-notice")] == [(0, 6), (7, 13)]
    assert got[7, "Apache-2.0-notice"][2:] == (1.0, 100_000, 100_006)
    assert got[None, "MIT-notice"][2] == 1.0
    assert {r[0] for r in out} == {1, 2, 3, 7, None}
    assert licenses.scan(df.limit(0)).collect() == [] and licenses.scan(df, templates={}).collect() == []


def test_inserted_words_as_whole_text_alignment():
    r = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    found = scanner.scan("Licensed under the terms of the CC BY-NC 4.0")
    assert (scanner.names.index("CC-BY-NC-4.0-notice"), 1.0, 0, 8) in found
    for k, words in enumerate(scanner.words):
        for _ in range(20):
            at = r.randrange(1, len(words))
            text = words[:at] + [f"x{r.random()}" for _ in range(r.randint(0, licenses.INSERTED * len(words)))] + words[at:]
            before = [f"y{i}" for i in range(r.randint(0, 50))]
            whole = licenses.patience(before + text, words)
            assert len(whole) == len(words)
            places = [x for x in scanner.scan(" ".join(before + text + before)) if x[0] == k]
            assert len(places) == 1 and places[0][1] >= licenses.THRESHOLD and len(before) <= places[0][2] <= places[0][3] < len(before) + len(text)
    # a close match stands, whatever precedes it
    notice = "Licensed under CC BY-NC 4.0."
    assert [x[1:] for x in scanner.scan("licensed things of many kinds " + notice) if scanner.names[x[0]] == "CC-BY-NC-4.0-notice"] == [(1.0, 5, 9)]


def test_scan_as_all_windows():
    some = ("MIT-notice", "Apache-2.0-notice", "CC-BY-NC-4.0-notice", "GPL-3.0-notice", "CC-BY-4.0-notice")
    scanner = licenses.Scanner({k: licenses.TEMPLATES[k] for k in some}, licenses.THRESHOLD)
    r = random.Random(1)
    matches = 0
    for _ in range(400):
        words = list(r.choice(scanner.words))
        if len(words) > 4 and r.random() < 0.5:
            words.pop(r.randrange(len(words)))
        for _ in range(r.choice([0, 1, 2, len(words) // 2, len(words)])):
            words.insert(r.randint(1, len(words) - 1), r.choice(["x", "of", "the", "license", "under", "by", "this"]))
        text = [r.choice(["a", "the", "license", "of", "under", "z"]) for _ in range(r.randint(0, 12))] + words + [r.choice(["b", "the", "license", "q"]) for _ in range(r.randint(0, 12))]
        found = {x[0] for x in scanner.scan(" ".join(text))}
        for k, template in enumerate(scanner.words):
            n = len(template)
            best = max(len(licenses.patience(text[a:b], template)) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 2 * n) + 1))
            assert (k in found) == (best >= 0.8 * n - 1e-9), (k, text)
            matches += best >= 0.8 * n - 1e-9
    assert matches > 200
    assert all(licenses.common_length(a, b) == common_length(a, b) for a, b in [([r.choice("abc") for _ in range(12)], [r.choice("abcd") for _ in range(9)]) for _ in range(50)])
