import random
import re

import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def finger(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, radius=4):
    least = list(range(len(ids)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[root(i)] = min(best.get(root(i), x), x)
    return [best.get(root(i)) for i in range(len(ids))]


def expected(rows):
    prints = [finger(t) for _, t in rows]
    ids = [i for i, _ in rows]
    return sorted(zip(ids, (f"{p:016x}" for p in prints), classes(ids, prints), strict=True), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_as_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}É" if i % 7 else f"W{i}" for i in range(300)]
    rows = []
    for i in range(250):
        text = r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 60, 300])))
        if rows and r.random() < 0.5:
            old = r.choice(rows)[1].split(" ")
            old[r.randrange(len(old))] = r.choice(words)
            text = " ".join(old)
        rows.append((1000 - i, text))
    rows += [(5, None), (6, ""), (7, " \n"), (None, "one"), (8, "one"), (None, "quite another text here"), (9, rows[3][1]), (9, rows[3][1])]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []


def test_split_tiles_lose_no_link(spark, monkeypatch):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(20)})
    ids = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "TILE", 7)
    monkeypatch.setattr(simhash, "_SUB", 4)
    monkeypatch.setattr(simhash, "_SMALL", 3)
    nodes = spark.createDataFrame([(i,) for i in ids], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    assert [roots.get(i, i) for i in ids] == classes(ids, prints)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_merge_labels():
    label = simhash.merge_labels(np.arange(6), np.array([5, 3, 1]), np.array([3, 1, 0]))
    assert label.tolist() == [0, 0, 2, 0, 4, 0]


def test_hot_fingerprint_is_dealt_out(spark):
    hot = "one text that stands in most rows of the table and in many tasks"
    rows = [(i if i % 5 else None, hot) for i in range(400)] + [(1000 + i, f"text {i} of its own " * 3) for i in range(40)] + [(2000, None), (2001, ""), (None, " ")]
    assert got(spark, rows) == expected(rows)
