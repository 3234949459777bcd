import random

import pytest

import corpus_pipeline as cp
from lodestone.llm import quality_classifier, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(40)) for i in range(5)]
    passage = say(60)
    rows, labels = [], []
    for i in range(240):
        bad = i % 5 == 0
        text = say(r.randint(40, 160))
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 7 == 1:
            text += " " + passage
        elif i % 11 == 2:
            text += " " + r.choice(items)[1]
        elif i % 13 == 3 and i > 20:
            text = rows[i - 13][1] + " " + word()
        rows.append((i, text, "en", f"s{r.choice([0, 0, 0, 1, 2])}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(rows[8][0], *rows[8][1:]), (500, None, None, None, None), (501, "", None, "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    steps = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder).cache()
        steps.append(docs)
        if name != "mixing":
            assert docs.columns == cp.COLUMNS
    good, single, cut, clean, mixed = steps
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    scores = {(r.doc_id, r.predicted) for r in quality_classifier.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores if p}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth[r.doc_id] for r in good.collect() if r.doc_id in truth) >= 0.97 * sum(truth.values())
    # one of each group of fingerprints, by a plain union of all close pairs
    rows = sorted(set(key(good)))
    prints = simhash.fingerprint_block([(t or "").encode() for _, t in rows]).tolist()
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert key(single) == sorted({rows[x] for x in root})
    seen, want = set(), []
    for i, t in key(single):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - suffix_dedup.LENGTH + 1):
            w = b[p : p + suffix_dedup.LENGTH]
            if w in seen:
                gone[p : p + suffix_dedup.LENGTH] = b"\1" * suffix_dedup.LENGTH
            seen.add(w)
        want.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode() if t is not None else None))
    assert key(cut) == want
    hit = set()
    for q in (r.text.split() for r in items.collect()):
        own = {tuple(q[k : k + 5]) for k in range(len(q) - 4)}
        for i, t in want:
            w = (t or "").split()
            if len(own & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= 0.8 * len(own):
                hit.add(i)
    assert hit and key(clean) == [x for x in want if x[0] not in hit]
    texts = dict(key(clean))
    out = mixed.collect()
    assert out and all(r.text == texts[r.doc_id] and r.n_tokens == len((r.text or "").split()) for r in out)
    assert {r.source for r in out} == {r.source or "" for r in clean.collect() if r.text}


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert cp.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert 4 <= len(cp.STAGES) <= 5


def test_null_and_repeated_ids_keep_their_texts(spark, folder):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    texts = [say(60) for _ in range(6)]
    rows = [(None, t, "en", "s", None) for t in texts[:3]] + [(4, t, "en", "s", None) for t in texts[3:5]] + [(5, texts[5], "en", "s", None)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in cp.STAGES[1:]:
        docs = stage(spark, docs, folder).cache()
    got = docs.collect()
    assert {(x.doc_id, x.text) for x in got} == {(i, t) for i, t, *_ in rows}
    assert all(x.n_tokens == 60 for x in got) and sum(x.epoch == 0 for x in got) == 6
