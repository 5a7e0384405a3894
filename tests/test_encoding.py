import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.functions import encoding as E
from lamina.functions import fnv

INTS = {
    -9223372036854775808: "0000000000000000", -4294967296: "7fffffff00000000", -2: "7ffffffffffffffe", -1: "7fffffffffffffff", 0: "8000000000000000",
    1: "8000000000000001", 2: "8000000000000002", 4294967296: "8000000100000000", 81985529216486895: "8123456789abcdef", 9223372036854775807: "ffffffffffffffff",
}
DOUBLES = [
    (-math.inf, "000fffffffffffff"), (-1.7976931348623157e308, "0010000000000000"), (-1.0, "400fffffffffffff"), (-5e-324, "7ffffffffffffffe"), (-0.0, "7fffffffffffffff"),
    (0.0, "8000000000000000"), (5e-324, "8000000000000001"), (1.0, "bff0000000000000"), (1.7976931348623157e308, "ffefffffffffffff"), (math.inf, "fff0000000000000"), (math.nan, "fff8000000000000"),
]


def test_int64(spark):
    df = spark.createDataFrame([(k,) for k in INTS] + [(None,)], "k long").withColumn("c", E.encode_int64("k"))
    rows = df.select("k", F.lower(F.hex("c")).alias("h"), E.decode_int64("c").alias("back")).collect()
    assert {r.k: r.h for r in rows if r.k is not None} == INTS
    assert all(r.k == r.back for r in rows)


def test_float64(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(DOUBLES)] + [(99, None)], "i int, v double").withColumn("c", E.encode_float64("v"))
    rows = {r.i: r for r in df.select("i", F.lower(F.hex("c")).alias("h"), E.decode_float64("c").alias("back")).collect()}
    for i, (v, code) in enumerate(DOUBLES):
        assert rows[i].h == code
        assert math.isnan(v) and math.isnan(rows[i].back) or repr(v) == repr(rows[i].back)
    assert rows[99].h is None


def test_little_endian(spark):
    df = spark.createDataFrame([(bytearray((-5).to_bytes(8, "little", signed=True)), bytearray((-7).to_bytes(4, "little", signed=True)))], "a binary, b binary")
    assert df.select(E.read_int("a", 8).alias("a"), E.read_int("b", 4).alias("b")).first() == (-5, -7)


@given(st.binary(max_size=6), st.binary(max_size=8))
def test_increment_bounds_prefix(prefix, other):
    top = E.increment(prefix)
    inside = other >= prefix and (top is None or other < top)
    assert inside == other.startswith(prefix) or top is None and not prefix


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    data = E.uvarint(n)
    assert E.read_uvarint(data) == (n, len(data))
    with pytest.raises(ValueError):
        E.read_uvarint(data[:-1])


def test_entry_marks_null(spark):
    df = spark.createDataFrame([(None, ""), ("", None), ("1:a", ";"), ("1", ":a;")], "a string, b string")
    assert df.select(E.entry("a", "b")).distinct().count() == 4


def test_fnv(spark):
    def plain(k):
        h = 0x811C9DC5
        for b in k.to_bytes(4, "little"):
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        return h

    rows = spark.range(0, 5000, 7).select("id", fnv.key_hash("id").alias("h"), fnv.is_boundary("id", 3).alias("b")).collect()
    assert all(r.h == plain(r.id) and r.b == (plain(r.id) % 8 == 0) for r in rows)


def test_addresses(spark):
    import hashlib

    row = spark.createDataFrame([("x",)], "s string").select(*(E.address("s", a).alias(a) for a in ("sha256", "sha512", "blake2b"))).first()
    assert row.sha256 == hashlib.sha256(b"x").hexdigest()[:40]
    assert row.sha512 == hashlib.sha512(b"x").hexdigest()[:40]
    assert row.blake2b == hashlib.blake2b(b"x", digest_size=20).hexdigest()
