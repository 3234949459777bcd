import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import mixing

DOCS = "doc_id long, text string, source string, block int, n long"


def corpus(n=300):
    r = random.Random(9)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 12 + ["a", "b", "c", "d", None])
        rows.append((i, r.choice([" ", "\n\t"]).join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), source, 1, 2))
    return rows + [(5, "a b c", "a", 0, 0), (5, "a b c", "a", 0, 0), (None, "x y", "b", None, None), (700, None, "b", None, None), (701, "", "empty", 0, 0), (702, "y " * 100, "c", 0, 0)]


def got(spark, rows, **p):
    return sorted((tuple(r) for r in mixing.mixture(spark.createDataFrame(rows, DOCS), **p).collect()), key=str)


@pytest.mark.parametrize("p", [{}, {"entropy": 0.999, "repeats": 1.5}, {"entropy": 0.5, "budget": 0.3, "block_tokens": 50}, {"entropy": 1.0, "repeats": 50.0, "budget": 3.0, "block_tokens": 1000}])
def test_as_sql(spark, p):
    rows = corpus()
    documents = spark.createDataFrame(rows, DOCS).toArrow()  # noqa: F841
    want = duckdb.sql(mixing.oracle(**p)).fetchall()
    assert got(spark, rows, **p) == sorted(want, key=str)


def test_conditions(spark):
    rows = corpus()
    n = defaultdict(int)
    for _, text, source, *_ in rows:
        n[source or ""] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    del n["empty"]
    total = sum(n.values())
    out = got(spark, rows, entropy=0.99, repeats=100.0, block_tokens=200)
    size = defaultdict(int)
    blocks = defaultdict(list)
    for block, position, _, source, _, tokens in out:
        size[source] += tokens
        blocks[block].append(position)
    weights = [x / sum(size.values()) for x in size.values()]
    assert abs(-sum(w * math.log(w) for w in weights) / math.log(len(n)) - 0.99) < 0.02
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values())
    assert abs(sum(size.values()) - total) < 600
    few = got(spark, rows, entropy=1.0, repeats=1.2)
    size = defaultdict(int)
    for r in few:
        size[r[3]] += r[5]
    assert all(size[s] <= 1.2 * n[s] + 5000 for s in size)
    # the shuffle is the keyed one
    a = [r for r in out if r[3] == "a" and r[4] == 0]
    keys = [hashlib.md5(f"17:0:{r[2]}".encode()).hexdigest() for r in sorted(a)]
    assert [r[2] for r in sorted(a)] == [x for _, x in sorted(zip(keys, [r[2] for r in sorted(a)], strict=True))] or len({r[0] for r in a}) > 1


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "", "a", 0, 0), (2, None, None, 0, 0)]) == []
    assert got(spark, [(1, "a b", "a", 0, 0)]) == [(0, 1, 1, "a", 0, 2)]
    texts = mixing.mixed_documents(spark.createDataFrame([(1, "a b", "s", 0, 0)], DOCS)).collect()
    assert [r.asDict() for r in texts] == [{"block": 0, "position": 1, "doc_id": 1, "source": "s", "epoch": 0, "n_tokens": 2, "text": "a b"}]


def test_texts_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s", 0, 0), (None, "d e", "s", 0, 0), (None, "d e", "s", 0, 0), (None, None, "s", 0, 0), (1, "f", "s", 0, 0), (1, "g h i j", "s", 0, 0), (2, "k l", "s", 0, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("block", "x")
    out = mixing.mixed_documents(df, budget=1.0)
    assert out.columns == ["block", "position", "doc_id", "source", "epoch", "n_tokens", "text"]
    got = sorted(((r.doc_id, r.text, r.n_tokens) for r in out.collect()), key=str)
    assert got == sorted([(i, t, len((t or "").split())) for i, t, *_ in rows], key=str)


def test_counts_of_many_partitions_make_few_files(spark, monkeypatch):
    made, write = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    docs = spark.createDataFrame(corpus(), DOCS)
    want = sorted((tuple(r) for r in mixing.mixed_documents(docs.coalesce(1)).collect()), key=str)
    made.clear()
    assert sorted((tuple(r) for r in mixing.mixed_documents(docs.repartition(64)).collect()), key=str) == want
    assert len(made["tokens"].inputFiles()) <= spark.sparkContext.defaultParallelism


def test_whole_budgets_do_not_lose_a_token(spark):
    r = random.Random(3)
    rows = [(i, f"s{i % 20}", "w " * r.randint(90, 110)) for i in range(400)]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_tokens=500)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        want = db.execute(f"SELECT block, position, doc_id, source, epoch, n_tokens FROM ({mixing.oracle(block_tokens=500)})").fetchall()
    assert len(want) == len(rows)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
