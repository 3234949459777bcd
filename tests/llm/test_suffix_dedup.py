import hashlib
import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"


def place(row):
    """The order of rows: id, null as the largest, then the signed text hash with its last bit for null ids."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return sd.LAST if row[0] is None else row[0], ((h - (1 << 64) if h >> 63 else h) & -2) + (row[0] is None), row[1] or ""


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha) by id order from a set of all strings of the length seen so far."""
    seen, out = set(), []
    for i, text in sorted(rows, key=place):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - sd.LENGTH + 1):
            w = b[p : p + sd.LENGTH]
            if w in seen:
                gone[p : p + sd.LENGTH] = True
            seen.add(w)
        spans = int(np.sum(gone & ~np.append(False, gone[:-1])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, rows):
    df = sd.removal_digest(spark.createDataFrame(rows, SCHEMA))
    return [tuple(r) for r in df.collect()]


def rank(rows):
    return sorted(rows, key=str)


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéfg") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [say(n) for n in (15, 30, 60, 200)]
    rows = []
    for i in range(160):
        text = say(r.choice([0, 3, 20, 100, 400]))
        for _ in range(r.randint(0, 3)):
            text += r.choice(["", " ", "\n"]) + r.choice(passages) + say(r.randint(0, 20))
        if rows and r.random() < 0.3:
            old = list(r.choice(rows)[1] or "")
            for _ in range(r.randint(0, 4)):
                if old:
                    old[r.randrange(len(old))] = r.choice("xyz")
            text = "".join(old)
        if r.random() < 0.1:
            text += r.choice(["a" * 500, "Der " * 200, "ab" * 99, "x" * 99])
        rows.append((i, text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = made(seed)
    assert rank(got(spark, rows)) == rank(brute(rows))


def test_nulls_ties_repeats_and_empty(spark):
    long = "the same words stand here again and again " * 4
    rows = [(1, None), (2, ""), (None, long), (5, long), (5, long), (5, long + "z"), (3, long[:100]), (4, long[:99]), (None, None)]
    assert rank(got(spark, rows)) == rank(brute(rows))
    assert got(spark, []) == []


def test_hot_passage_and_pieces(spark, monkeypatch):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(r.choice("ijklmnop ") for _ in range(150)) + passage + "".join(r.choice("qrstuv ") for _ in range(150))) for i in range(300)]
    rows.append((400, "".join(r.choice("abcd") for _ in range(3 * sd.PIECE)) + passage))
    out = {x[0]: x for x in got(spark, rows)}
    assert out[0][2] == 0 and out[400][1] - 3 * sd.PIECE == 400
    some = [x for x in rows if x[0] < 40]
    assert rank(got(spark, some)) == rank(brute(some))
    assert all(400 <= out[i][2] <= 420 for i in range(1, 300)) and out[400][2] >= 400


def test_text_and_other_columns(spark):
    same = "é" + "".join(chr(97 + (i * i // 3) % 26) for i in range(120))
    df = spark.createDataFrame([(1, same, "a", 1), (2, "x" + same, None, 2), (3, None, "c", 3)], "doc_id long, text string, seq string, id int")
    out = {r.doc_id: tuple(r) for r in sd.remove_repeats(df).collect()}
    assert sd.remove_repeats(df).columns == df.columns
    assert out == {1: (1, same, "a", 1), 2: (2, "x", None, 2), 3: (3, None, "c", 3)}


def test_sort_suffixes():
    r = np.random.default_rng(0)
    data = r.choice(np.frombuffer(b"ab", np.uint8), 3000)
    data[1000:1400] = data[2000:2400]
    at = r.permutation(2900)[:2000]
    order, new = sd.sort_suffixes(data, at)
    raw = data.tobytes()
    strings = [raw[p : p + sd.LENGTH] for p in at[order]]
    assert strings == sorted(strings)
    assert [a != b for a, b in zip(strings, strings[1:])] == new[1:].tolist()


def test_order_of_rows_does_not_matter(spark):
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = say(60)
    rows = [(i, say(60) + (" " + passage if i % 3 else "")) for i in range(120)]
    want = {x[0]: x[1] - x[2] for x in brute(rows)}
    for threshold in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            # kept in another order than that of ids
            df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3, "text").cache()
            df.count()
            assert {x.doc_id: len(x.text) for x in sd.remove_repeats(df).collect()} == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_rows_of_one_id(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = say(30)
    texts = [say(40) + (passage if i % 3 else "") for i in range(1500)]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:700]] + [(None, texts[0])] * 500 + [(sd.LAST, texts[1]), (sd.LAST, say(40))]
    assert rank(got(spark, rows)) == rank(brute(rows))


def test_splitters():
    r = np.random.default_rng(4)
    sample = np.unique(r.integers(0, 9, (400, 4)).astype(np.uint64), axis=0)
    cuts = sd.Splitters(sample, 12)
    rows = r.integers(0, 9, (3000, 4)).astype(np.uint64)
    rows = rows[np.lexsort(rows.T[::-1])]
    bucket = np.full(len(rows), -1)
    for b, lo, hi in cuts.slices(*rows.T):
        bucket[lo:hi] = b
    assert bucket.tolist() == [sum(tuple(e) < tuple(x) for e in cuts.edges.tolist()) for x in rows.tolist()]
    for h in set(range(9)) - set(cuts.cut.tolist()):
        whole = {(tuple(x[:2]), b) for x, b in zip(rows.tolist(), bucket.tolist()) if x[1] == h}
        assert len(whole) == len({k for k, _ in whole})


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_as_brute_force(seed):
    import duckdb

    texts = {i: t for i, t in made(seed) if i is not None}
    rows = [*texts.items(), (10**9, None), (10**9 + 1, "é" * 400), (10**9 + 2, ""), (10**9 + 3, "x" * 2500)]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        found = db.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({sd.ORACLE})").fetchall()
    assert rank(found) == rank(brute(rows))
