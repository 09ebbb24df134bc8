import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolake.functions import codec as C
from chronolake.functions import native_bytes as N
from chronolake.sources import wal


def test_crc32c_vector_and_increments():
    assert N.crc32c(b"hello") == 0x9A71BB4C
    assert N.crc32c(b"lo", N.crc32c(b"hel")) == N.crc32c(b"hello")


def plain_crc(data, c=0):
    c ^= 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@given(st.lists(st.binary(max_size=50) | st.integers(900, 3100).map(lambda n: bytes(i * i % 251 for i in range(n))), max_size=5), st.integers(0, 2**32 - 1))
def test_crc32c_of_many_against_bits(data, start):
    assert N.crc32c_many(data, start).tolist() == [plain_crc(x, start) for x in data]


def test_filter_hash_against_a_plain_version(spark):
    def plain(b):
        h = 0xBC9F1D34 ^ len(b) * 0xC6A4A793 & 0xFFFFFFFF
        cut = len(b) // 4 * 4
        for i in range(0, cut, 4):
            h = (h + int.from_bytes(b[i : i + 4], "little")) * 0xC6A4A793 & 0xFFFFFFFF
            h ^= h >> 16
        if cut < len(b):
            h = (h + int.from_bytes(b[cut:], "little")) * 0xC6A4A793 & 0xFFFFFFFF
            h ^= h >> 24
        return h

    keys = ["", "a", "ab", "abc", "abcd", "abcde", "hello world", "é\u65e5\u672c", "x" * 1001, "\0\xff"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.filter_hash(F.col("k")).alias("h"), C.bloom_probes(F.col("k"), 968, 6).alias("p")).collect()
    for r in rows:
        h = plain(r["k"].encode())
        step = (h >> 17 | h << 15) & 0xFFFFFFFF
        assert r["h"] == h and r["p"] == [(h + i * step & 0xFFFFFFFF) % 968 for i in range(6)]


def test_layout_is_that_of_the_log():
    sizes = [0, 5, 32761, 32755, 1, 100_000, 32768 - 14, 0, 70_000, 9]
    got = C.laid_out(pd.DataFrame({"doc_id": range(len(sizes)), "size": sizes, "log": 0}))
    data = b""
    for n, start, count in zip(sizes, got["start"], got["fragments"]):
        part = wal.fragments(b"x" * n, len(data))
        pad = -len(data) % 32768 if 32768 - len(data) % 32768 < 7 else 0
        assert start == len(data) + pad and len(part) == pad + n + 7 * count
        data += part


def test_characters_and_text(spark):
    df = spark.createDataFrame([("h\u00e9", 0), ("h\u00e9", 1), ("h\u00e9", 2), ("h", -1), (None, 0)], "s string, i int").select(C.char_at(F.col("s"), F.col("i")))
    assert [r[0] for r in df.collect()] == ["h", "\u00e9", None, None, None]
    assert spark.createDataFrame([(bytearray(b"ab\0c"),), (bytearray(b""),), (None,)], "b binary").select(C.to_text(F.col("b"))).collect() == [("ab",), ("",), (None,)]


@given(st.binary(max_size=600) | st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=2), st.integers(1, 700)))
def test_rle_round_trip(data):
    assert N.rle_decode(N.rle_encode(data)) == data


def test_rle_sizes():
    assert N.rle_encode(b"Z" * 127) == bytes((255, 127, 90))
    assert N.rle_encode(b"aaa") == b"aaa"
    assert N.rle_encode(b"\xff") == b"\xff\x01\xff"
    with pytest.raises(ValueError):
        N.rle_decode(b"\xff\x02")


def test_varint_round_trip(spark):
    values = [0, 1, 127, 128, 255, 256, 65535, 2**31 - 1, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("h", C.varint_hex(F.col("v")))
    rows = df.select("v", "h", C.varint_length(F.col("v")).alias("n"), C.varint_decode(F.col("h")).alias("back")).collect()
    assert [r["back"] for r in rows] == values
    assert [len(r["h"]) // 2 for r in rows] == [r["n"] for r in rows]
    short = spark.createDataFrame([("80",), ("FF",), ("",)], "h string").select(C.varint_decode(F.col("h")))
    assert [r[0] for r in short.collect()] == [None, None, None]


def test_trailer_and_internal_key(spark):
    df = spark.createDataFrame([("k", 7, 1), ("", 2**40, 0)], "k string, s long, t int").withColumn("p", C.pack_trailer(F.col("s"), F.col("t")))
    seq, kind = C.unpack_trailer(F.col("p"))
    ikey = C.internal_key(F.col("k"), F.col("p"))
    rows = df.select("k", "s", "t", seq.alias("s2"), kind.alias("t2"), C.user_key(ikey).cast("string").alias("k2")).collect()
    assert all(r["s"] == r["s2"] and r["t"] == r["t2"] and r["k"] == r["k2"] for r in rows)


def test_native_codecs_in_columns(spark):
    df = spark.createDataFrame([(bytearray(b"Z" * 300),), (None,), (bytearray(b""),)], "b binary")
    rows = df.select("b", N.rle_uncompress(N.rle_compress("b")).alias("back"), N.crc32c_of("b").alias("c")).collect()
    assert [r["back"] for r in rows] == [r["b"] for r in rows]
    assert rows[2]["c"] == 0


def test_status_text(spark):
    assert spark.range(1).select(C.status_text(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))).first()[0] == "a: b"
