import random
import re

from lodestone.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, lang string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def grams(text, w):
    x = words(text)
    return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)} if w else set()


def brute(docs, items):
    out = []
    for d, t, _ in docs:
        for i, q, _ in set(items):
            w = min(5, len(words(q)))
            own = grams(q, w)
            n = len(own & grams(t, w))
            if own and 10 * n >= 8 * len(own):
                out.append((d, i, len(own), n, round(n / len(own), 6)))
    return sorted(out, key=str)


def got(spark, docs, items):
    df = dc.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return sorted((tuple(r) for r in df.collect()), key=str)


def made():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "The"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([1, 3, 4, 5, 6, 7, 12, 30, 80, 200]))), "x") for i in range(60)]
    docs = []
    for d in range(120):
        text = say(r.randint(0, 300))
        for _ in range(r.randint(0, 2)):
            own = words(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "other"
            at = r.randint(0, len(text))
            text = text[:at] + own + text[at:]
        docs.append((d, r.choice([" ", "\n", " \t"]).join(text), d))
    return docs, items


def test_as_brute_force(spark):
    docs, items = made()
    assert got(spark, docs, items) == brute(docs, items)


def test_many_passes(spark, monkeypatch):
    docs, items = made()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    assert got(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    item = "one two three four five six seven"
    docs = [(1, None, 0), (2, "", 0), (None, item.upper(), 0), (3, item, 0), (3, item, 0), (4, "one", 0), (5, "x y " * 20000 + item, 0)]
    items = [(1, item, None), (1, item, None), (2, None, "a"), (3, " ", "a"), (None, "one", "a"), (-1, "four five six", "a")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    kept = dc.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:2], ITEMS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_removal_judges_each_row(spark):
    docs, items = made()
    docs = [(None if d % 4 == 0 else -1 if d % 4 == 1 else d, t, d) for d, t, _ in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, _bad int")
    hit = {x[0] for x in brute([(t, t, 0) for _, t, _ in docs], items)}
    kept = dc.remove_contaminated(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns and hit
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where(~df.text.isin(*hit)).collect()))
