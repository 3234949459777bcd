import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, lsi, retrieval, vector, vocabulary
from lodestone.operators.index import Index, build_index, count_postings, gap_rows, merge_full_outer, merge_runs, postings_arrays, token_rows
from lodestone.plans import cli
from lodestone.plans.demo import demo
from lodestone.sources.collection import read_collection, read_evaluation_queries, read_qrels, read_queries
from lodestone.streaming.ingest import ingest, read_ingested

TEXTS = ["a b a c", "b c d", "", "a a a a e", "f", None, "b\tb\nb g a"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"b{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, block string")


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs)


def plain():
    return {(w, i): n for i, t in enumerate(TEXTS) for w, n in Counter((t or "").split()).items()}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_index_relations(docs, index):
    post = plain()
    assert rows(index.postings, "term", "doc_id", "tf") == sorted((w, i, n) for (w, i), n in post.items())
    assert rows(index.term_stats, "term", "df", "max_tf") == sorted((w, len(x), max(x)) for w, x in _by(post, 0).items())
    assert rows(index.doc_stats, "doc_id", "dl") == sorted((i, sum(x)) for i, x in _by(post, 1).items())
    assert tuple(index.collection.first()) == (5, sum(post.values()) / 5)
    assert tuple(index.summary().first()) == (len(_by(post, 0)), 5, len(post), sum(post.values()))
    assert rows(build_index(docs, "bsbi", "block").postings, "term", "doc_id", "tf") == rows(index.postings, "term", "doc_id", "tf")
    with pytest.raises(ValueError):
        build_index(docs, "other")


def _by(post, k):
    out = defaultdict(list)
    for key, n in post.items():
        out[key[k]].append(n)
    return out


def test_empty_collection(spark):
    empty = build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert tuple(empty.collection.first()) == (0, 1.0) and tuple(empty.summary().first()) == (0, 0, 0, 0)
    q = spark.createDataFrame([(1, "a")], "qid long, query string")
    assert retrieval.search_bm25(q, empty).collect() == []


def test_merges(spark):
    a = spark.createDataFrame([("t", 1, 34), ("t", 3, 2), ("t", 4, 23)], "term string, doc_id long, tf int")
    b = spark.createDataFrame([("t", 1, 11), ("t", 2, 4), ("t", 4, 3), ("t", 6, 13)], "term string, doc_id long, tf int")
    want = [("t", 1, 45), ("t", 2, 4), ("t", 3, 2), ("t", 4, 26), ("t", 6, 13)]
    assert rows(merge_runs(a, b), "term", "doc_id", "tf") == want == rows(merge_full_outer(a, b), "term", "doc_id", "tf")
    with pytest.raises(ValueError):
        merge_runs()


def test_document_lengths(spark):
    one = [(1, d, t) for d, t in zip([2, 3, 4, 8, 10], [2, 4, 2, 3, 30], strict=True)] + [(2, d, t) for d, t in zip([3, 4, 5], [34, 23, 56], strict=True)]
    i = Index.of(spark.createDataFrame(one, "term int, doc_id long, tf int"))
    assert dict(rows(i.doc_stats, "doc_id", "dl")) == {2: 2, 3: 38, 4: 25, 5: 56, 8: 3, 10: 30}
    assert dict(rows(i.term_stats, "term", "max_tf")) == {1: 30, 2: 56}


def test_gaps_over_blocks(spark):
    ids = [0, 5, 65535, 65536, 65537, 400000]
    post = spark.createDataFrame([("t", i, 1) for i in ids] + [("u", 9, 2)], "term string, doc_id long, tf int")
    assert rows(gap_rows(post).where("term = 't'"), "doc_id", "gap") == [(0, 0), (5, 5), (65535, 65530), (65536, 1), (65537, 1), (400000, 334463)]
    assert rows(postings_arrays(post).where("term = 't'"), "block", "doc_ids") == [(0, [0, 5, 65535]), (1, [65536, 65537]), (6, [400000])]


def test_store_and_lookup(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    loaded = Index.load(spark, str(tmp_path / "i"))
    assert rows(loaded.lookup("a"), "doc_id", "tf") == [(0, 2), (3, 4), (6, 1)]
    assert loaded.lookup("zz").collect() == []
    plan = loaded.lookup("a")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan


def test_vocabulary(spark):
    words = spark.createDataFrame([(w,) for w in "interest interesting interests inter internal halo 𝒳 ￿ interest".split()], "term string")
    found = vocabulary.with_prefix(words.distinct(), "interest").collect()
    assert [r.term for r in found] == ["interest", "interesting", "interests"]
    flag = lambda p, w=words: vocabulary.prefix_exists(w, p).first().found
    assert flag("intern") and not flag("x") and flag("") and flag("", words.limit(0))
    ids = vocabulary.id_map(words, "term", "id").orderBy("id").collect()
    assert [r.id for r in ids] == list(range(8)) and [r.term for r in ids] == sorted({r.term for r in words.collect()})
    assert vocabulary.size(words) == 8
    assert vocabulary.ids_of(spark.createDataFrame([("halo",), ("no",)], "term string"), vocabulary.id_map(words, "term", "id"), "term").count() == 1


def score(method, query, k1=1.2, b=0.75):
    post = plain()
    dl = {i: sum(x) for i, x in _by(post, 1).items()}
    n, avg = len(dl), sum(dl.values()) / len(dl)
    out = defaultdict(float)
    words = query.split()
    for w in dict.fromkeys(words) if method == "wand" else words:
        have = {i: t for (x, i), t in post.items() if x == w}
        for i, tf in have.items():
            if method == "tfidf":
                out[i] += math.log(n / len(have)) * (1 + math.log(tf))
            else:
                out[i] += math.log((n - len(have) + 0.5) / (len(have) + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[i] / avg))
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("method", ["tfidf", "bm25", "wand"])
def test_retrieval(spark, index, method):
    texts = {1: "a b", 2: "a a c zz", 3: "zz", 4: "", 5: "f e d c b a", 6: "b"}
    queries = spark.createDataFrame(list(texts.items()), "qid long, query string")
    for k in (1, 2, 10):
        got = defaultdict(list)
        for r in retrieval.METHODS[method](queries, index, k).orderBy("qid", "rank").collect():
            got[r.qid].append((r.doc_id, r.score))
        for q, text in texts.items():
            want = score(method, text)[:k]
            assert [d for d, _ in got[q]] == [d for d, _ in want]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want])
    with pytest.raises(ValueError):
        retrieval.METHODS[method](queries, index, 0)


def test_pruning_changes_nothing(spark):
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) if x < 500)) for i in range(300)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    queries = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.integers(1, 60, 5))) for i in range(20)], "qid long, query string")
    flat = lambda df: [(r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in df.orderBy("qid", "rank").collect()]
    assert flat(retrieval.search_wand(queries, index, 5, prune=True)) == flat(retrieval.search_wand(queries, index, 5))
    with pytest.raises(ValueError):
        retrieval.search_wand(queries, index, 5, b=2.0, prune=True)


def test_metrics(spark):
    r = spark.createDataFrame([("x", i, v) for i, v in enumerate([1, 0, 1, 0, 1], 1)] + [("y", i, v) for i, v in enumerate([1, 1, 0], 1)] + [("z", 1, 0), ("g", 1, 1), ("g", 2, 3)], "qid string, rank int, rel int")
    one = lambda df, c: {x.qid: x[c] for x in df.collect()}
    want = {"rbp": 0.40992, "dcg": 1.8868528, "ndcg": 0.8854599, "ap": 0.7555556}
    for m, f in {"rbp": evaluation.rbp, "dcg": evaluation.dcg, "ndcg": evaluation.ndcg, "ap": evaluation.average_precision}.items():
        assert one(f(r), m)["x"] == pytest.approx(want[m], abs=1e-6)
        assert one(evaluation.metrics(r), m) == pytest.approx(one(f(r), m))
    assert one(evaluation.ndcg(r), "ndcg")["y"] == 1.0
    assert one(evaluation.average_precision(r), "ap")["z"] == 0.0 == one(evaluation.ndcg(r), "ndcg")["z"]
    assert one(evaluation.dcg(r, 1), "dcg") == {"x": 1.0, "y": 1.0, "z": 0.0, "g": 1.0}
    judged = spark.createDataFrame([("x", 1)] * 6, "qid string, rel int")
    assert one(evaluation.average_precision(r.where("qid = 'x'"), judged=judged), "ap")["x"] == pytest.approx(0.7555556 / 2, abs=1e-6)
    assert one(evaluation.ndcg(r.where("qid = 'x'"), judged=judged), "ndcg")["x"] < 0.8854


def test_evaluation_of_methods(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "qid long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 11, 1), (2, 11, 1)], "qid long, doc_id long, rel int")
    mean = evaluation.evaluate(results, qrels, queries).first()
    assert (mean.rbp, mean.ap) == pytest.approx((0.16 / 2, 0.25))
    table = evaluation.compare({"p": results, "q": results.limit(0), "r": results}, qrels, queries)
    assert {r.method: round(r.ap, 6) for r in table.collect()} == {"p": 0.25, "q": 0.0, "r": 0.25}
    assert {(r.metric, r.method) for r in evaluation.best_methods(table, ["q", "r", "p"]).collect()} == {(m, "r") for m in evaluation.METRICS}


def test_evaluating_a_function(spark, index):
    queries = spark.createDataFrame([(1, "a"), (2, "zz")], "qid long, query string")
    qrels = spark.createDataFrame([(1, 3, 1)], "qid long, doc_id long, rel int")
    mean = evaluation.evaluate_function(lambda q, k: retrieval.search_tfidf(q, index, k), queries, qrels).first()
    assert mean.ap == pytest.approx(0.5)
    assert tuple(lsi.matrix_shape(index).first())[:3] == (5, 7, 12)


def test_demo(spark, folder):
    assert demo(spark, str(folder / "collection"), 1).first().doc_id == "./collection/1/7.txt"


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(500, 8)).astype(np.float32)
    data[7] = data[3]
    rows_ = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None)]
    vectors = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").repartition(5)
    queries = vectors.where("vec_id % 20 = 0 or vec_id = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    got = defaultdict(list)
    for r in vector.search_exact(queries, vectors, 6).orderBy("qid", "rank").collect():
        got[r.qid].append(r.vec_id)
    full = data.astype(np.float64)
    for q, found in got.items():
        s = np.round(full @ full[q], 9)
        assert found == sorted(range(500), key=lambda i: (-s[i], i))[:6]
    assert got[3][:2] == [3, 7]
    cells, centroids = vector.build_cells(vectors, 12)
    every = vector.search_cells(queries, cells, centroids, 6, 12)
    assert vector.recall(every, vector.search_exact(queries, vectors, 6)).first().recall == 1.0
    some = vector.search_cells(queries, cells, centroids, 6, 6)
    assert 0.7 < vector.recall(some, vector.search_exact(queries, vectors, 6)).first().recall <= 1.0
    unit = vector.normalize(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, vec array<double>")).orderBy("i").collect()
    assert [r.vec for r in unit] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("n", [40, 2000])
def test_recall_of_cells_by_default(spark, n):
    data = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS qid", "embedding AS vec")
    found = vector.search_cells(queries, *vector.build_cells(vectors))
    assert vector.recall(found, vector.search_exact(queries, vectors)).first().recall >= 0.9


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"t{i % 6}w{int(x)}" if rng.random() < 0.7 else f"w{int(x)}" for x in rng.integers(0, 25, 60))) for i in range(90)]
    return texts, build_index(spark.createDataFrame(texts, "doc_id long, text string"))


@pytest.mark.parametrize("algorithm", ["exact", "randomized", "arpack"])
def test_lsi(spark, corpus, tmp_path, algorithm):
    texts, index = corpus
    words = sorted({w for _, t in texts for w in t.split()})
    counts = np.array([[t.split().count(w) for w in words] for _, t in texts], float)
    m = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.log(len(texts) / (counts > 0).sum(0))
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    latent = lsi.build_lsi(index, 6, algorithm)
    assert np.allclose(latent.singular, s[:6], rtol=0.02)
    latent.save(str(tmp_path / algorithm))
    latent = lsi.LatentIndex.load(spark, str(tmp_path / algorithm))
    basis = np.array([r.vec for r in latent.term_vecs.orderBy("term").collect()], float)
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-3)
    text = "t2w1 t2w5 t2w5 w7 unknown"
    queries = spark.createDataFrame([(1, text), (2, "unknown")], "qid long, query string")
    got = {r.doc_id: r.score for r in lsi.search_lsi(queries, index, latent, 1000).collect()}
    q = np.array([text.split().count(w) for w in words], float)
    q = np.where(q > 0, 1 + np.log(np.maximum(q, 1)), 0) * np.log(len(texts) / (counts > 0).sum(0))
    v = vt[:6].T
    want = (m @ v) @ (q @ v) / np.linalg.norm(m @ v, axis=1) / np.linalg.norm(q @ v)
    assert len(got) == 90 and np.allclose([got[i] for i in range(90)], want, atol=0.02)
    celled = latent.with_cells(6)
    celled.save(str(tmp_path / f"{algorithm}-cells"))
    celled = lsi.LatentIndex.load(spark, str(tmp_path / f"{algorithm}-cells"))
    near = {r.doc_id: r.score for r in lsi.search_lsi(queries, index, celled, 10).collect()}
    best = sorted(got, key=lambda i: (-round(got[i], 9), i))[:10]
    assert len(near) == 10 and len(set(near) & set(best)) >= 9 and all(np.isclose(near[i], got[i], atol=1e-6) for i in near)
    assert {r.doc_id for r in lsi.search_lsi(queries, index, celled, 10, n_probe=6).collect()} == set(best)
    named = lsi.search_named(queries.withColumn("qid", F.concat(F.lit("Q"), "qid")), index, latent, 3).orderBy("rank").collect()
    assert [r.doc_id for r in named] == sorted(got, key=lambda i: (-round(got[i], 9), i))[:3]


def test_streaming_ingest(spark, tmp_path):
    for part in (0, 1):
        spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if i % 2 == part], "doc_id long, text string").write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    index = read_ingested(spark, str(tmp_path / "out"))
    assert rows(index.postings, "term", "doc_id", "tf") == sorted((w, i, n) for (w, i), n in plain().items())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("c") / "collection"
    for block, number, text in [("1", 7, "lipid metabolism in toxemia\r\nand lipid"), ("1", 8, "normal pregnancy"), ("2", 9, "lipid pregnancy é"), ("2", 10, "")]:
        (root / block).mkdir(parents=True, exist_ok=True)
        (root / block / f"{number}.txt").write_text(text)
    (root / "stray.txt").write_text("not read")
    (root.parent / "queries.txt").write_text("Q1 lipid metabolism\nQ2 pregnancy\n\n")
    (root.parent / "qrels.txt").write_text("Q1 7\nQ2 8\nQ2 9\n")
    return root.parent


def test_sources(spark, folder):
    got = rows(read_collection(spark, str(folder / "collection")), "doc_name", "block")
    assert got == [("./collection/1/7.txt", "1"), ("./collection/1/8.txt", "1"), ("./collection/2/9.txt", "2")]
    assert rows(read_queries(spark, str(folder / "queries.txt")), "qid", "query") == [("Q1", "lipid metabolism"), ("Q2", "pregnancy")]
    assert rows(read_evaluation_queries(spark, str(folder / "queries.txt")), "qid", "query") == [("Q1", "lipid metabolism"), ("Q2", "pregnancy")]
    assert rows(read_qrels(spark, str(folder / "qrels.txt")), "qid", "docno", "rel") == [("Q1", 7, 1), ("Q2", 8, 1), ("Q2", 9, 1)]


def test_command_line(spark, folder, tmp_path):
    base = ["--output-dir", str(tmp_path / "index")]
    data = ["--data-dir", str(folder / "collection")]
    out = cli.main(["index", *base, *data, "--mode", "spimi"], spark).first()
    assert (out.documents, out.vocabulary) == (3, 8)
    cli.main(["lsi", *base, *data, "--n-components", "2"], spark)
    for method in cli.METHODS:
        found = cli.main(["search", *base, "--method", method, "--query", "metabolism", "--query-file", str(folder / "queries.txt"), "-k", "2"], spark).collect()
        assert {r.qid for r in found} == {"* metabolism", "Q1", "Q2"}
        assert [r.doc_id for r in found if r.qid == "Q1"][0] == "./collection/1/7.txt"
    table = cli.main(["evaluate", *base, *data, "--qrel-file", str(folder / "qrels.txt"), "--query-file", str(folder / "queries.txt"), "--lsi-build", "--n-components", "2"], spark)
    assert {r.method for r in table.collect()} == {"tfidf", "bm25", "lsi"} and all(r.ap > 0.7 for r in table.collect())
    assert {r.encoder for r in cli.main(["compress", *base], spark).collect()} == {"standard", "vbe", "elias"}
    with pytest.raises(SystemExit):
        cli.main(["search", *base], spark)


#: A folder of abstracts in numbered blocks, from which the values below were derived by hand-written formulas.
COLLECTION = os.environ.get("LODESTONE_COLLECTION")


@pytest.mark.skipif(not COLLECTION, reason="LODESTONE_COLLECTION names no folder")
def test_golden_values(spark):
    index = build_index(read_collection(spark, COLLECTION), id_col="doc_name")
    assert tuple(index.summary().first()) == (11018, 607, 40261, 61055)
    assert index.collection.first().avgdl == pytest.approx(100.58484349258649)
    queries = spark.createDataFrame([(1, "alkylated with radioactive iodoacetate"), (2, "psychodrama for disturbed children"), (3, "lipid metabolism in toxemia and normal pregnancy")], "qid long, query string")
    want = {
        "tfidf": [("6/507", 27.088869), ("9/820", 20.808623), ("1/7", 34.822761)],
        "bm25": [("6/507", 19.098862), ("9/820", 16.906585), ("1/7", 25.546331)],
    }
    for method, top in want.items():
        got = retrieval.METHODS[method](queries, index, 1).orderBy("qid").collect()
        assert [(r.doc_id[13:-4], round(r.score, 6)) for r in got] == top
    numbers = index.postings.select("term", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("doc_id")).cast("bigint").alias("doc_id"), "tf")
    assert numbers.count() == 40261
    latent = lsi.build_lsi(index, 100)
    assert np.allclose(latent.singular[:5], [127.1925, 73.0527, 69.3135, 66.2925, 64.7012], atol=1e-3)
    top = lsi.search_named(queries, index, latent, 2).orderBy("qid", "rank").collect()
    assert [(r.doc_id[13:-4], round(r.score, 3)) for r in top] == [("6/507", 0.958), ("8/793", 0.41), ("9/820", 0.779), ("7/613", 0.746), ("1/7", 0.846), ("4/328", 0.549)]


def test_token_rows_ignore_other_columns(spark):
    df = spark.createDataFrame([(1, "x y", "term")], "doc_id long, text string, term string")
    assert rows(count_postings(token_rows(df)), "term", "doc_id") == [("x", 1), ("y", 1)]
