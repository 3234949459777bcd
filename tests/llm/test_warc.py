import hashlib
import random

from lodestone.llm import warc
from lodestone.shared import materialize, shared_path

PAGES = "page_id long, url string, html string, size int"


def made(n=300):
    r = random.Random(4)
    texts = ["é<p>" * 300, "a" * 999, "b" * 1000, "c" * 1001]
    rows = []
    for i in range(n):
        text = r.choice(texts + ["".join(r.choice("abc \r\n") for _ in range(r.randint(0, 3000)))] * 4)
        host = r.choice(["hot.example.org"] * 3 + [f"h{r.randint(0, 30)}.example.com"])
        rows.append((i, f"https://www.{host}/p/{r.randint(0, 50)}?q={r.randint(0, 3)}#f", text, 0))
    return rows + [(None, None, None, 0), (None, "http://x.org", texts[2], 0), (900, "x\r\nWARC-Type: evil", "d" * 2_000_000, None), (901, "u", "e" * 1500, 0), (901, "u", "e" * 1500, 0)]


def expected(rows):
    last = {}
    for i, _, t, _ in rows:
        if t and len(t.encode()) >= 1000 and i is not None:
            last[t] = max(last.get(t, -1), i)
    out = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        other = last.get(t)
        again = other is not None and i != other
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


def test_records_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rows = made()
    df = spark.createDataFrame(rows, PAGES)
    assert sorted((tuple(r) for r in warc.capture_digest(df).collect()), key=str) == expected(rows)
    archives, index = shared_path(spark, "a"), shared_path(spark, "i")
    warc.write_archives(df, archives)
    warc.write_index(spark, archives, index)
    entries = warc.lookup_all(spark, index, warc.keys_of(df))
    assert entries.count() == len(rows)
    captures = {(r.page_id, r.url): r for r in warc.read_captures(spark, archives, entries).collect()}
    some = spark.createDataFrame([(warc.url_key(rows[k][1]),) for k in (0, 7, 100)] + [("no,such)/",), ("zz", ), ("", )], "key string")
    got = sorted((r.page_id, r.key) for r in warc.lookup_all(spark, index, some).collect())
    want = {r.key for r in some.collect()}
    assert got == sorted((i, warc.url_key(u)) for i, u, *_ in rows if u and warc.url_key(u) in want)
    found = warc.CaptureIndex(spark, archives, index)
    assert len(found.tops) > 1
    # one lookup reads a few blocks and the records it finds, not the archives
    read, ranged = [], found._range
    found._range = lambda path, at, size: read.append(size) or ranged(path, at, size)
    own = found.lookup(rows[0][1])
    whole = sum(r.size for r in entries.collect())
    assert own and len(read) <= len(own) + 6 and sum(read) < whole / 10
    for url in [rows[0][1], rows[7][1], rows[100][1], "x\r\nWARC-Type: evil"]:
        want = sorted((i for i, u, *_ in rows if warc.url_key((u or "").replace("\r\n", " ")) == warc.url_key(url.replace("\r\n", " "))), key=str)
        got = found.lookup(url.replace("\r\n", " "))
        assert sorted((g["page_id"] for g in got), key=str) == want
        for g in got:
            assert g["kind"] == "revisit" or g["payload"] == captures[g["page_id"], g["headers"]["warc-target-uri"]].payload
    assert found.lookup("http://absent.example") == []


def test_files_follow_bytes(spark, monkeypatch):
    rows, held = made(), {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("64", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        df = materialize(spark.createDataFrame(rows, PAGES).repartition(64), "pages")
        archives, index = shared_path(spark, "a"), shared_path(spark, "i")
        warc.write_archives(df, archives)
        warc.write_index(spark, archives, index)
        assert warc._files(spark, archives).count() <= spark.sparkContext.defaultParallelism
        assert warc._files(spark, f"{index}/blocks").count() == 1
        # many sorted ranges, too, hold every capture
        monkeypatch.setattr(warc, "TASK_CAPTURES", 20)
        monkeypatch.setattr(warc, "BLOCK_LINES", 7)
        assert sorted((tuple(r) for r in warc.capture_digest(df).collect()), key=str) == expected(rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_empty_table(spark):
    assert warc.capture_digest(spark.createDataFrame([], PAGES)).collect() == []


def test_members():
    import gzip

    data = [b"one", b"x" * 70_000, b"y" * (1 << 24), b"z"]
    content = b"".join(warc.gzip_member(d) + b"\0" for d in data)
    assert gzip.decompress(content) == b"".join(data)
    assert [d for _, _, d in warc.members(content)] == data
    for at, size, d in warc.members(content):
        assert gzip.decompress(content[at : at + size]) == d


def test_url_keys():
    assert warc.url_key("https://WWW.Example.org:443/A?b#c") == "org,example)/A?b"
    assert warc.url_key("http://a.b.co:8080") == "co,b,a:8080)/"
    assert warc.url_key("http://u@h.org?q=1") == "org,h)/?q=1"
    assert warc.url_key("") == ")/"
