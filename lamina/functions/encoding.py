"""Order-preserving key encodings, byte helpers and content hashes.

Integers and hashes are built-in expressions.  Doubles need the bits of the value, which
no built-in gives, so they go through one Arrow batch function.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW64 = -(2**63)
ADDRESS_HEX = 40  # 20 bytes


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_int64(x: Column | str) -> Column:
    """Sign-flipped big-endian: unsigned byte order is numeric order."""
    return F.unhex(F.lpad(F.hex(_c(x).cast("long").bitwiseXOR(F.lit(LOW64))), 16, "0"))


def decode_int64(x: Column | str) -> Column:
    """The number whose ``encode_int64`` is x (8 bytes).  The two halves are read apart, as a
    16-digit hexadecimal number may pass the signed range."""
    digits = F.hex(_c(x))
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(LOW64))


@F.arrow_udf(T.BinaryType())
def encode_float64(x: pa.Array) -> pa.Array:
    """Order-preserving 8 bytes of a double: -0.0 before 0.0, one NaN last; null stays null."""
    v = x.to_numpy(zero_copy_only=False).astype(np.float64)
    bits = v.view(np.uint64).copy()
    bits[np.isnan(v)] = np.uint64(0x7FF8000000000000)
    top = np.uint64(1 << 63)
    raw = np.where(bits & top, ~bits, bits | top).astype(">u8")
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(x), [None, pa.py_buffer(raw)])
    return pc.if_else(x.is_null(), pa.scalar(None, pa.binary()), fixed.cast(pa.binary()))


@F.arrow_udf(T.DoubleType())
def decode_float64(x: pa.Array) -> pa.Array:
    """The double whose ``encode_float64`` is x (8 bytes)."""
    whole = pc.fill_null(x, bytes(8)).cast(pa.binary(8))
    code = np.frombuffer(whole.buffers()[1], ">u8", len(x), 8 * whole.offset).astype(np.uint64)
    top = np.uint64(1 << 63)
    return pc.if_else(x.is_null(), None, pa.array(np.where(code & top, code ^ top, ~code).view(np.float64)))


def read_int(x: Column | str, width: int) -> Column:
    """A little-endian signed integer of 4 or 8 bytes."""
    pairs = [F.substring(F.hex(_c(x)), 2 * i + 1, 2) for i in range(width - 1, -1, -1)]
    digits = F.concat(*pairs)
    high = F.conv(F.substring(digits, 1, 2 * width - 8), 16, 10).cast("long") if width == 8 else F.lit(0).cast("long")
    low = F.conv(F.substring(digits, 2 * width - 7, 8), 16, 10).cast("long")
    if width == 8:
        return F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def read_string(x: Column | str) -> Column:
    return F.decode(_c(x), "UTF-8")


def increment(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with ``prefix``; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def uvarint(n: int) -> bytes:
    """Seven bits a byte, the low ones first; the top bit says that more follow."""
    if n < 0:
        raise ValueError("unsigned")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next position); a value past 64 bits or a cut end is an error."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("broken varint")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            if n >> 64:
                raise ValueError("broken varint")
            return n, at


def is_prefix(prefix: Column | str, of: Column | str) -> Column:
    return F.startswith(_c(of), _c(prefix))


def field(value: Column | str) -> Column:
    """One field of a canonical entry: a letter for the kind of its type, its length and
    itself.  Null is marked apart from empty.  Integers of all widths are one kind, and so
    are 0.0 and -0.0; bytes are written in hexadecimal."""
    value = _c(value)
    kind = F.typeof(value)
    whole, real = kind.isin("tinyint", "smallint", "int", "bigint"), kind.isin("float", "double")
    letter = F.when(whole, "i").when(real, "r").when(kind == "binary", "x").when(kind == "boolean", "t").otherwise(F.substring(kind, 1, 1))
    plain = value.cast("string")
    text = F.when(kind == "binary", F.hex(plain)).when(real & plain.isin("-0.0"), F.lit("0.0")).otherwise(plain)
    return F.when(value.isNull(), F.lit("-;")).otherwise(F.concat(letter, F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def entry(*columns: Column | str) -> Column:
    return F.concat(*(field(c) for c in columns))


def address(content: Column | str, algorithm: str = "sha256") -> Column:
    """The first 20 bytes, in hexadecimal, of a content's digest."""
    content = _c(content)
    if algorithm in ("sha256", "sha512"):
        return F.substring(F.sha2(content.cast("binary"), int(algorithm[3:])), 1, ADDRESS_HEX)
    if algorithm == "blake2b":
        return _blake2b(content.cast("binary"))
    raise ValueError(f"unknown hash {algorithm!r}: one of sha256, sha512, blake2b")


@F.arrow_udf(T.StringType())
def _blake2b(x: pa.Array) -> pa.Array:
    return pa.array([None if b is None else hashlib.blake2b(b, digest_size=20).hexdigest() for b in x.to_pylist()], pa.string())
