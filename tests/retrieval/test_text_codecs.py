import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import codecs
from lodestone.functions.text import document_number, query_id, query_text, tokens


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens_break_where_python_does(spark):
    text = "a\x1cb c d\x85e​f　g h"
    every = "".join(f"x{chr(c)}y " for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    got = column(spark, [text, every, "", "  \n", None, " Mixed CASE, kept! "], "string", tokens)
    assert got[0] == text.split() == ["a", "b", "c", "d", "e​f", "g", "h"]
    assert got[1] == every.split()
    assert got[2:] == [[], [], None, ["Mixed", "CASE,", "kept!"]]


def test_query_lines_and_paths(spark):
    lines = ["Q1 a b", "Quick fox", "Q7", "plain words", "", "  "]
    assert column(spark, lines, "string", query_id) == ["Q1", "Quick", "*", "*", None, None]
    assert column(spark, lines, "string", query_text) == ["a b", "fox", "Q7", "plain words", "", ""]
    paths = ["./c/1/17.txt", "/a/b/9.txt", "a/b/9.txt", "./c/1/x.txt", None]
    assert column(spark, paths, "string", document_number) == [17, 9, None, None, None]


IDS, TFS = [34, 67, 89, 454, 2345738], [12, 10, 3, 4, 1]


@pytest.mark.parametrize(
    "name, ids, tfs",
    [("vbe", "a2a19602ed010f12c4", "8c8a838481"), ("elias", "0460882e016e0000047928a0", "182992")],
)
def test_known_encodings(spark, name, ids, tfs):
    own = codecs.codec(name)
    assert column(spark, [IDS], "array<bigint>", lambda v: F.lower(F.hex(own.encode(v)))) == [ids]
    assert column(spark, [TFS], "array<bigint>", lambda v: F.lower(F.hex(own.encode_tf(v)))) == [tfs]


def test_small_vbe_lists(spark):
    assert column(spark, [[2, 3, 4, 8, 10], [3, 4, 5]], "array<bigint>", lambda v: F.lower(F.hex(codecs.vbe_encode(v)))) == ["8281818482", "838181"]
    assert column(spark, [0, 127, 128, 16384], "bigint", codecs.vb_hex) == ["80", "FF", "0180", "010080"]
    assert column(spark, [1, 2, 5, 9], "bigint", codecs.gamma_string) == ["1", "010", "00101", "0001001"]


@pytest.mark.parametrize("name", list(codecs.CODECS))
def test_round_trips(spark, name):
    r = random.Random(name)
    lists = [sorted(r.sample(range(1 << r.choice([4, 10, 33])), r.randint(1, 12))) for _ in range(80)] + [[0], [0, 1, 2], [], list(range(0, 3000, 7))]
    tfs = [[r.randint(1, 1 << r.choice([1, 8, 20])) for _ in x] for x in lists]
    own = codecs.codec(name)
    rows = spark.createDataFrame(list(zip(lists, tfs, strict=True)), "d array<bigint>, t array<bigint>")
    path = rows.select("d", "t", own.encode(F.col("d")).alias("p"), own.encode_tf(F.col("t")).alias("q")).cache()
    for x in path.select("d", "t", own.decode(F.col("p")).alias("d2"), own.decode_tf(F.col("q")).alias("t2")).collect():
        assert x.d == x.d2 and x.t == x.t2
    bits = lambda f, c: F.aggregate(F.transform(c, f), F.lit(0).cast("bigint"), lambda a, v: a + v)
    sizes = path.select(F.length("p").alias("a"), F.ceil(bits(own.gap_bits, codecs.gaps(F.col("d"))) / 8).alias("b"), F.length("q").alias("c"), F.ceil(bits(own.tf_bits, F.col("t")) / 8).alias("e"))
    assert all(x.a == x.b and x.c == x.e for x in sizes.collect())


def test_four_byte_standard(spark):
    assert column(spark, [[1, 258]], "array<bigint>", lambda v: F.hex(codecs.standard_encode(v, 4))) == ["0100000002010000"]
    assert column(spark, [bytes([1, 0, 0, 0, 2, 1, 0, 0])], "binary", lambda v: codecs.standard_decode(v, 4)) == [[1, 258]]


def test_unknown_codec():
    with pytest.raises(ValueError):
        codecs.codec("gzip")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 1 << 40), max_size=40), max_size=6))
def test_gamma_and_vb_batches(lists):
    edge = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    values = np.array([v for x in lists for v in x], np.int64)
    data, cut = codecs._gamma_bytes(values, edge)
    for k, x in enumerate(lists):
        bits = "".join("0" * (v.bit_length() - 1) + f"{v:b}" for v in x)
        assert "".join(f"{b:08b}" for b in data[cut[k] : cut[k + 1]]) == bits.ljust(-(-len(bits) // 8) * 8, "0")
    out, back = codecs._gamma_numbers(data, cut)
    assert out.tolist() == values.tolist() and back.tolist() == edge.tolist()
    raw = [b"".join(bytes([v >> 7 * i & 127 | (128 if not i else 0) for i in range((v.bit_length() - 1) // 7, -1, -1)]) for v in x) for x in lists]
    cut = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    out, back = codecs._vb_numbers(np.frombuffer(b"".join(raw), np.uint8), cut)
    assert out.tolist() == values.tolist() and back.tolist() == edge.tolist()


def test_null_and_empty_lists(spark):
    lists = [None, [1, 5], [], None, [3]]
    for own in codecs.CODECS.values():
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<bigint>").coalesce(1)
        stored = rows.select("i", own.encode(F.col("v")).alias("p"), own.encode_tf(F.col("v")).alias("q")).cache()
        back = stored.select("i", own.decode(F.col("p")).alias("d"), own.decode_tf(F.col("q")).alias("t")).orderBy("i").collect()
        assert [r.d for r in back] == lists and [r.t for r in back] == lists
