import random

import corpus_pipeline as cp
from lodestone.llm import near_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == x) for x in set(root))


def lightly_edited():
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for i in range(260):
        if rows and r.random() < 0.6:
            # up to 5 far apart words replaced: similarities on both sides of 0.8
            old = r.choice(rows)[1].split()
            for k in range(r.randint(0, max(1, len(old) // 25))):
                old[min(len(old) - 1, k * 25 + r.randrange(20))] = r.choice(words)
        else:
            old = [r.choice(words) for _ in range(r.choice([1, 4, 5, 9, 60, 120, 200]))] + passage * r.randint(0, 1)
        rows.append((1000 - i, " ".join(old)))
    return [*rows, (3, None), (4, ""), (5, " "), (6, "ONE two"), (7, "one TWO")]


def test_stage_as_brute_force(spark, monkeypatch):
    rows = lightly_edited()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    want = expected(rows)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == want
    # split tiles and groups lose no pair
    monkeypatch.setattr(near_text, "TILE", 7)
    monkeypatch.setattr(near_text, "_SMALL", 3)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == want


def test_null_and_reused_ids(spark):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("abcdefghijklmnop") + str(r.randrange(90)) for _ in range(n))
    a, b, c, d = (say(40) for _ in range(4))
    rows = [(2, a, "p"), (2, b, "q"), (2, b, "q"), (5, b + " z", "r"), (None, a, "s"), (None, c, "t"), (None, c, "u"), (None, d, "v"), (9, d, "w"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, X string")
    out = near_text.keep_representatives(df)
    assert out.columns == df.columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    assert got == sorted([(2, a), (2, b), (None, a), (None, c), (None, d), (9, d), (None, None)], key=str)
    assert near_text.keep_representatives(df.limit(0)).collect() == []
