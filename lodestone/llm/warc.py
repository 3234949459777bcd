"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so a record is read by its offset and length alone. The index has a line per capture,
sorted by reversed-host URL key and cut into blocks, a gzip member each; a sparse directory keeps each block's first key and place.
A lookup searches the directory by bisection, reads one block by range, then one record by range; a table of lookups does the same
for all its URLs at once, file by file.

All files go through Spark's writers and readers, so any store that Spark reaches will do. A gzip member ends with the high byte
of its length, zero below 16 MB (longer records get an empty member, whose last byte is zero, after them): the byte is left to
the text writer, as its line separator.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialize, shared_path, writers
from . import textblocks as tb

#: Least payload that is deduplicated.
LEAST = 1000
#: Most records of a file, captures of an index block.
FILE_RECORDS, BLOCK_LINES = 4096, 512
#: Bytes after which an archive is closed; one longer record makes a longer one.
FILE_BYTES = 1 << 27
#: Bytes of pages that a task writes to archives, captures that one sorts into blocks.
TASK_BYTES, TASK_CAPTURES = 1 << 24, 1 << 15
#: Copies of the table of repeated payloads that share the joining of one payload.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
_ENTRY = "key string, page_id long, file string, at long, size long, kind string"


def url_key(url: str) -> str:
    """The reversed-host key of a URL: scheme, ``www.`` and fragment dropped, host labels reversed, lower case before the path."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url.strip()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", f"?{query}"
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = host.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (slash or "/") + path


def gzip_member(data: bytes) -> bytes:
    """One record as gzip, without the final zero byte that the writer adds."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += empty.flush()
    return out[:-1]


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each record of a file; an empty member belongs to the record before it."""
    at, held = 0, None
    while at < len(content):
        reader = zlib.decompressobj(31)
        # the rest is not copied for each record
        data, size = [], 0
        while not reader.eof:
            part = content[at + size : at + size + 65536]
            if not part:
                raise ValueError("the archive ends inside a record")
            data.append(reader.decompress(part))
            size += len(part) - len(reader.unused_data)
        whole = b"".join(data)
        if whole or held is None:
            if held:
                yield held
            held = (at, size, whole)
        else:
            held = (held[0], held[1] + size, held[2])
        at += size
    if held:
        yield held


def _identity(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}'.encode() + digest).digest()[:16], version=4)}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _record(page_id: int | None, url: str, size: int, digest: bytes, payload: bytes, more: list[str]) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Record-ID: {_identity(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", *more]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str, payload: bytes) -> bytes:
    """A record with its payload."""
    return _record(page_id, url, len(payload), hashlib.sha1(payload).digest(), payload, ["WARC-Type: response"])


def revisit(page_id: int | None, url: str, size: int, digest: bytes, refers_to: int) -> bytes:
    """A record of a payload that the page ``refers_to`` has: its size and digest only."""
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record(page_id, url, size, digest, b"", ["WARC-Type: revisit", profile, f"WARC-Refers-To: {_identity(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"])


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""

    def fields(lines: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record has another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _write(rows: DataFrame, path: str) -> None:
    """Writes column ``member`` of each row to files of at most FILE_RECORDS in folders of column ``part``, in the order of its partition."""
    rows.select("part", F.col("member").cast("string")).write.partitionBy("part").option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _members(members: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """(part, member) rows; a new part begins after FILE_BYTES."""
    part = size = 0
    for some in members:
        parts = []
        for member in some:
            if size and size + len(member) > FILE_BYTES:
                part, size = part + 1, 0
            size += len(member)
            parts.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(some, pa.binary())], ["part", "member"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all files in the folders of ``path``; ``file`` is the path from there."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+/[^/]+$", 0).alias("file"), "content")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Writes every row of ``pages`` as a record to files in ``path``.

    Of rows with equal payloads of LEAST bytes or more, that with the largest id is the response and the others revisit it; rows
    that repeat the largest id are responses too. Null ids revisit any other; if all are null, all are responses. Null texts
    and URLs are empty. Records are packed before the one exchange, by digest, that meets each with the largest id of its payload.
    The tasks that write follow the size of ``pages``, not the partitions of that exchange.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest"))
    last = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("rows")).where("rows > 1")
    spread = last.select("digest", "n", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [gzip_member(response(*(c[i].as_py() for c in batch.columns[:3]))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[3:], pa.array(out, pa.binary())], ["page_id", "url", "n", "digest", "member"])

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for batch in batches:
            ids, urls, sizes, digests, others = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))
            yield [m.as_py() if o is None else gzip_member(revisit(i, u, n, bytes.fromhex(d), o)) for i, u, n, d, m, o in zip(ids, urls, sizes, digests, batch.column(4), others, strict=True)]

    keyed = rows.mapInArrow(responses, "page_id long, url string, n int, digest string, member binary")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    dealt = keyed.join(spread, ["digest", "n", "salt"], "left").select("page_id", "url", "n", "digest", "member", other)
    dealt = dealt.coalesce(writers(pages.select(id_col, url_col, text_col), TASK_BYTES))
    _write(dealt.mapInArrow(lambda batches: _members(revisits(batches)), "part int, member binary"), path)


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """Indexes the archives: blocks of sorted captures in ``path``/blocks, their directory in ``path``/directory."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for at, size, data in members(content.as_py()):
                    warc, _, _ = parse(data)
                    page = warc.get("x-page-id")
                    out.append((url_key(warc["warc-target-uri"]), page and int(page), file, at, size, warc["warc-type"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "page_id", "file", "at", "size", "kind"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        held: list[str] = []

        def close(lines: list[str]) -> list[bytes]:
            return [gzip_member("".join(lines).encode())]

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(json.dumps(row, ensure_ascii=False) + "\n")
                if len(held) == BLOCK_LINES:
                    yield close(held)
                    held = []
        if held:
            yield close(held)

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(json.loads(data.partition(b"\n")[0])[0], file, at, size) for at, size, data in members(content.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["first", "file", "at", "size"])

    rows = materialize(_files(spark, archives).mapInArrow(captures, _ENTRY), "captures")
    n = -(-rows.count() // TASK_CAPTURES)
    ranges = rows.repartitionByRange(n, "key", "page_id", "file", "at") if n > 1 else rows.coalesce(1)
    ordered = ranges.sortWithinPartitions("key", "page_id", "file", "at")
    _write(ordered.mapInArrow(lambda batches: _members(blocks(batches)), "part int, member binary"), f"{path}/blocks")
    _files(spark, f"{path}/blocks").mapInArrow(directory, "first string, file string, at long, size long").write.parquet(f"{path}/directory")


def _tops(spark: SparkSession, index: str) -> list[tuple[str, str]]:
    """(first key, file) of each file of blocks, in order: a row for FILE_RECORDS blocks, that is 2 million captures."""
    return sorted((r.first, r.file) for r in spark.read.parquet(f"{index}/directory").groupBy("file").agg(F.min("first").alias("first")).collect())


def _ranges(files: DataFrame, places: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on (file, ranges of its content): each file of ``files`` meets the (file, at, size) that ``places`` names in it.

    A file holds at most FILE_RECORDS places. Whether the places are broadcast is for their measured size to decide.
    """
    listed = places.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                held = memoryview(content.as_buffer())
                yield from work(file, ((p["at"], p["size"], zlib.decompressobj(31).decompress(held[p["at"] : p["at"] + p["size"]])) for p in found))

    return files.join(listed, "file").select("file", "content", "places").mapInArrow(run, schema)


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the index key of every row's URL; null is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(_line(x or "")) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key string")


def lookup_all(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """(key, page_id, file, at, size, kind): the index lines of every distinct ``key`` of ``keys``; keys that no capture has give none.

    Each key finds its files by bisection over their first keys, its blocks by merging with the directory of the file, where both
    are sorted; only such blocks are read, by their ranges.
    """
    sent = tb.share(spark, _tops(spark, index))
    keys = keys.select("key").where("key is not null").distinct()

    def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = sent()
        firsts = [t for t, _ in tops]
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                # captures of a key may start in the last file that opens before it, and go on in all that open with it
                out += [(tops[k][1], key) for k in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["file", "key"])

    def lines(file: str, found) -> Iterator[pa.RecordBatch]:
        for _, _, data in found:
            out = [json.loads(x) for x in data.decode().splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "page_id", "file", "at", "size", "kind"])

    directory = spark.read.parquet(f"{index}/directory")
    asked = keys.mapInArrow(files_of, "file string, key string")
    in_file = Window.partitionBy("file")
    opened = directory.select("file", "at", "size", F.col("first").alias("key"), F.lead("first").over(in_file.orderBy("at")).alias("next"), F.lit(0).alias("asked"))
    both = opened.unionByName(asked.select("file", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("size"), "key", F.lit(None).cast("string").alias("next"), F.lit(1).alias("asked")))
    # the least key that is asked for from a block's first on
    ahead = in_file.orderBy(F.desc("key"), F.desc("asked"), F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.last(F.when(F.col("asked") == 1, F.col("key")), ignorenulls=True).over(ahead)
    wanted = both.withColumn("least", least).where("asked = 0 and least is not null and (next is null or least <= next)").select("file", "at", "size")
    return _ranges(_files(spark, f"{index}/blocks"), wanted, lines, _ENTRY).join(keys, "key", "left_semi").select(*[x.split()[0] for x in _ENTRY.split(", ")])


def read_captures(spark: SparkSession, archives: str, captures: DataFrame, payload: bool = True) -> DataFrame:
    """(file, at, size, page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each capture (file, at, size), read by its range.

    The payload of a revisit is null; its length and digest are those that its record states. Without ``payload`` none is returned.
    """
    schema = "file string, at long, size long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def records(file: str, found) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        out, held = [], 0
        for at, size, data in found:
            warc, http, body = parse(data)
            page, other = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
            full = warc["warc-type"] == "response"
            digest = hashlib.sha1(body).hexdigest() if full else base64.b32decode(warc["warc-payload-digest"][5:]).hex()
            out.append((file, at, size, page and int(page), warc["warc-target-uri"], body if full and payload else None, len(body) if full else int(http["content-length"]), digest, warc["warc-type"], other and int(other)))
            held += len(body) if payload else 0
            if len(out) == 256 or held > 1 << 24:
                yield close(out)
                out, held = [], 0
        if out:
            yield close(out)

    return _ranges(_files(spark, archives), captures.select("file", "at", "size"), records, schema)


class CaptureIndex:
    """Lookups by URL: bisection over block directories, then range reads."""

    def __init__(self, spark: SparkSession, archives: str, index: str):
        self.spark, self.archives, self.index = spark, archives, index
        self.directory = spark.read.parquet(f"{index}/directory")
        # the blocks of a file are read when they are asked for
        self.tops = _tops(spark, index)

    def _range(self, path: str, at: int, size: int) -> bytes:
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        stream = file.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(file)
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()

    def lookup(self, url: str) -> list[dict]:
        """The captures of a URL: page_id, kind, headers and payload each; none: an empty list."""
        key = url_key(url)
        found = []
        # captures of one key may run on over block and file ends; they may start in the block before the first that opens with the key
        start = max(0, bisect_right([t for t, _ in self.tops], key) - 1)
        while start > 0 and self.tops[start][0] == key:
            start -= 1
        for top, file in self.tops[start:]:
            if top > key:
                break
            blocks = sorted((r.first, r.at, r.size) for r in self.directory.where(F.col("file") == file).collect())
            firsts = [b[0] for b in blocks]
            lo = max(0, bisect_right(firsts, key) - 1)
            while lo > 0 and firsts[lo] == key:
                lo -= 1
            for first, at, size in blocks[lo:]:
                if first > key:
                    break
                lines = zlib.decompressobj(31).decompress(self._range(f"{self.index}/blocks/{file}", at, size)).decode().splitlines()
                for row in map(json.loads, lines):
                    if row[0] == key:
                        data = zlib.decompressobj(31).decompress(self._range(f"{self.archives}/{row[2]}", row[3], row[4]))
                        warc, _, payload = parse(data)
                        found.append({"page_id": row[1], "kind": row[5], "headers": warc, "payload": payload})
        return found


def capture_digest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of every row of ``pages``, read back through the index.

    Writes archives and index to the shared folder by ``write_archives`` (which says how nulls, ties and repeats are taken) and
    ``write_index``. Other columns are ignored, whatever their names. No rows: no rows.
    """
    spark = pages.sparkSession
    archives, index = shared_path(spark, "archives"), shared_path(spark, "index")
    write_archives(pages, archives, id_col, url_col, text_col)
    write_index(spark, archives, index)
    found = read_captures(spark, archives, lookup_all(spark, index, keys_of(pages, url_col)), payload=False)
    return found.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= {LEAST} GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p LEFT JOIN m USING (d, n)
"""
