"""FNV-1a in built-in expressions, and boundary tests on hashes."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF  # fixed values of 32-bit FNV-1a


def _step(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * F.lit(PRIME)).bitwiseAND(F.lit(MASK))


def key_hash(key: Column | str, width: int = 4, seed: bytes = b"") -> Column:
    """32-bit FNV-1a of a key's low ``width`` bytes, the lowest first, after ``seed``."""
    start = reduce(lambda h, b: ((h ^ b) * PRIME) & MASK, seed, OFFSET)
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    return reduce(lambda h, i: _step(h, F.shiftright(key, 8 * i).bitwiseAND(F.lit(255))), range(width), F.lit(start).cast("long"))


def is_boundary(key: Column | str, bits: int, width: int = 4) -> Column:
    """A chunk closes after a key whose hash ends in ``bits`` zero bits."""
    return key_hash(key, width).bitwiseAND(F.lit((1 << bits) - 1)) == 0


def address_boundary(address: Column | str, bits: int) -> Column:
    """The same test on an address: its first 32 bits."""
    address = F.col(address) if isinstance(address, str) else address
    return F.conv(F.substring(address, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << bits) - 1)) == 0


def direct_mask(digest: Column, bits: int) -> Column:
    """Boundary by the first 8 bytes of a key's digest."""
    return address_boundary(F.hex(digest) if not isinstance(digest, str) else digest, bits)


def lane_xor_mask(digest_hex: Column | str, bits: int, lanes: int = 5) -> Column:
    """Boundary by the XOR of a digest's 32-bit lanes, so every byte has a say."""
    digest = F.col(digest_hex) if isinstance(digest_hex, str) else digest_hex
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(lanes)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts).bitwiseAND(F.lit((1 << bits) - 1)) == 0


def word_table(seed: bytes = b"", bits: int = 32) -> list[int]:
    """A word for each byte, from a rule: the digest of seed and the byte's decimal digits."""
    return [int.from_bytes(hashlib.sha256(seed + str(i).encode()).digest()[: bits // 8], "big") for i in range(256)]


def gear_hash(data: Column, seed: bytes = b"gear") -> Column:
    """A 32-bit gear hash over bytes: shift, then add the byte's word of ``word_table``."""
    words = F.array(*(F.lit(w).cast("long") for w in word_table(seed)))
    digits = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, b: (h * 2 + F.get(words, b)).bitwiseAND(F.lit(MASK)))
