"""What is exchanged and held must not grow faster than the input; results stay those of brute force."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import blocks, compression, lsi, retrieval, vector
from lodestone.operators.index import build_index, gap_rows, postings_arrays


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    ids = [*range(0, 300_000, 1000), None, None, 7000, 7000]
    return spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) if x < 400)) for i in ids], "doc_id long, text string").repartition(3).cache()


def counts(docs):
    out = Counter()
    for r in docs.collect():
        for w in r.text.split():
            out[w, r.doc_id] += 1
    return out


def test_documents_are_counted_where_they_lie(spark, docs):
    once = docs.where("doc_id <> 7000")
    assert "Aggregate" not in plan(blocks.counted(once))
    for some in (once, docs):
        want = counts(some)
        assert {(r.term, r.doc_id): r.tf for r in blocks.counted(some).collect()} == want
        index = build_index(some)
        assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == want
        dl = Counter()
        for (_, d), n in want.items():
            dl[d] += n
        assert {r.doc_id: r.dl for r in index.doc_stats.collect()} == dl
        assert all(r.dl == dl[r.doc_id] for r in index.impacts.collect())
        stats = {r.term: (r.df, r.max_tf) for r in index.term_stats.collect()}
        assert stats == {w: (len(x), max(x)) for w in {w for w, _ in want} for x in [[n for (v, _), n in want.items() if v == w]]}


def test_splitting_texts_in_arrow_and_in_spark(spark):
    every = [f" x{chr(c)}y " for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["", "  "]
    words, sizes = blocks.split(pa.array(every))
    assert words.to_pylist() == [w for t in every for w in t.split()] and sizes.tolist() == [len(t.split()) for t in every]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "i int, t string").select("i", tokens("t").alias("w")).orderBy("i").collect()
    assert [len(r.w) for r in rows] == sizes.tolist()


@pytest.mark.parametrize("passes", [1 << 18, 3])
def test_searches_exchange_postings_and_no_pairs(spark, docs, monkeypatch, passes):
    monkeypatch.setattr(retrieval, "PASS_PAIRS", passes)
    index = build_index(docs)
    queries = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "w1 w3 none"), (None, "w5 w1"), ("d", "none"), ("e", "w9 w2 w4 w1")], "qid string, query string")
    post, n = counts(docs), index.doc_stats.count()
    df = Counter(w for w, _ in post)
    for k in (1, 5, 1000):
        found = retrieval.search_tfidf(queries, index, k)
        assert "Aggregate" not in plan(found)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (str(r.qid), r.rank)):
            got.setdefault(r.qid, []).append(r.doc_id)
        for q in queries.collect():
            score = Counter()
            for w in q.query.split():
                for (v, d), tf in post.items():
                    if v == w:
                        score[d] += np.log(n / df[w]) * (1 + np.log(tf))
            # nulls first
            want = sorted(score, key=lambda d: (-round(score[d], 9), -1 if d is None else d))[:k]
            assert got.get(q.qid, []) == want
    have = {(r.qid, r.doc_id) for r in retrieval.containing(queries, index).collect()}
    assert have == {(q.qid, d) for q in queries.collect() for d in {d for _, d in post} if all((w, d) in post for w in q.query.split())}


def test_the_best_of_a_task_are_bounded_and_lose_no_tie(monkeypatch):
    monkeypatch.setattr(retrieval, "AT_ONCE", 64)
    rng = np.random.default_rng(4)
    best, every = retrieval.Best(3, 4), []
    for lo in range(0, 6000, 50):
        ids = np.arange(lo, lo + 50)
        q, score = rng.integers(0, 3, 50), rng.integers(0, 30, 50) + rng.integers(0, 2, 50) * 4e-10
        best.add(pa.array(ids), np.arange(50), q, score)
        every += zip(q.tolist(), score.tolist(), ids.tolist(), strict=True)
        assert best.size <= 64 + 50
    rows = [tuple(x.values()) for b in best.rows(["q", "id", "s"]) for x in b.to_pylist()]
    assert len(rows) <= 3 * 2 * 4
    for q in range(3):
        top = lambda x: sorted((-round(s, 9), i) for s, i in x)[:4]
        assert top((s, i) for p, i, s in rows if p == q) == top((s, i) for p, s, i in every if p == q)


def test_lists_are_gathered_before_the_exchange(spark, docs):
    post = build_index(docs).postings.where("doc_id is not null").repartition(5).cache()
    made = [gap_rows(post), postings_arrays(post), compression.encoded(post, "elias"), compression.gap_lists(post), compression.report(post)]
    assert all("collect_list" not in plan(df) for df in made)
    want = sorted((r.term, r.doc_id, r.tf) for r in post.collect())
    gaps, last = [], {}
    for t, d, tf in want:
        gaps.append((t, d, tf, d - last.get(t, 0)))
        last[t] = d
    assert sorted(map(tuple, made[0].collect())) == gaps
    for name in ("standard", "vbe", "elias"):
        assert sorted(map(tuple, compression.decoded(compression.encoded(post, name), name).collect())) == want
    assert sorted(map(tuple, compression.from_gaps(made[3]).collect())) == [(t, d) for t, d, _ in want]
    vb = lambda v: -(-max(v.bit_length(), 1) // 7)
    size = {r.term: (r.postings_bytes, r.tf_bytes) for r in compression.term_sizes(post, "vbe").collect()}
    assert size == {w: (sum(vb(g) for t, _, _, g in gaps if t == w), sum(vb(tf) for t, _, tf, _ in gaps if t == w)) for w in last}


def test_lists_of_equal_groups_over_batches():
    rows = [("a", 0)] * 5 + [("a", 1)] * 7 + [("b", 1)] + [("c", 2)] * 9
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["t", "b"])
    for step in (1, 2, 3, 8, 22):
        whole = list(blocks.whole_groups((batch.slice(i, step) for i in range(0, len(rows), step)), 2))
        assert [tuple(r.values()) for w in whole for r in w.to_pylist()] == rows
        groups = [{tuple(r.values()) for r in w.to_pylist()} for w in whole]
        assert sum(map(len, groups)) == 4


def test_a_task_of_vector_search_holds_a_bounded_product():
    rng = np.random.default_rng(6)
    data, vecs = rng.normal(size=(10_000, 8)), rng.normal(size=(vector.QUERY_BLOCK, 8))
    best = retrieval.Best(len(vecs), 3, in_order=False)
    tracemalloc.start()
    vector._meet(best, pa.array(np.arange(10_000)[::-1].copy()), data, vecs, np.arange(len(vecs)), np.arange(10_000))
    rows = next(best.rows(["q", "id", "s"]))
    # all scores at once are 328 MB
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()
    got = sorted(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(1).to_pylist(), strict=True), key=lambda x: (x[0], -x[1]))
    for q in (0, 1, 4095):
        score = data @ vecs[q]
        assert [i for p, _, i in got if p == q] == (9999 - np.argsort(-score)[:3]).tolist()


def test_the_driver_holds_few_columns_of_the_latent_basis(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"t{i % 6}w{int(x)}" if rng.random() < 0.7 else f"w{int(x)}" for x in rng.integers(0, 25, 60))) for i in range(90)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    whole = lsi.build_lsi(index, 6)
    sent = []
    slices = lsi._Basis.slices

    def watched(self):
        for lo, values in slices(self):
            sent.append(values.size)
            yield lo, values

    monkeypatch.setattr(lsi._Basis, "slices", watched)
    # fewer than a basis of 90 rows and 6 columns, which an earlier limit refused
    monkeypatch.setattr(lsi, "SENT_NUMBERS", 400)
    cut = lsi.build_lsi(index, 6)
    assert max(sent) <= 400 and np.allclose(whole.singular, cut.singular, rtol=1e-4)
    a, b = (np.array([r.vec for r in x.doc_vecs.orderBy("doc_id").collect()]) for x in (whole, cut))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3)
    a, b = (np.array([r.vec for r in x.term_vecs.orderBy("term").collect()]) for x in (whole, cut))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3) and np.allclose(b.T @ b, np.eye(6), atol=1e-3)
