"""Portable hashes: FNV-1a of 64 bits as a column, CRC-32C for manifests."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 64 bits: offset basis and prime (2**40 + 435).
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211

_LOW = 0xFFFFFFFF


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 without overflow errors."""
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def fnv1a_column(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes as a signed 64-bit integer."""
    code = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(F.octet_length(text) > 0, bytes_).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        small = _add(x.bitwiseAND(_LOW) * 435, F.shiftleft(F.shiftrightunsigned(x, 32) * 435, 32))
        return _add(F.shiftleft(x, 40), small)

    return F.aggregate(bytes_, F.lit(_signed(FNV_BASIS)), step)


def unsigned_mod(h: Column, n: int) -> Column:
    """An unsigned 64-bit integer (held in a signed column) modulo n."""
    return ((F.shiftrightunsigned(h, 32) % n) * ((1 << 32) % n) + h.bitwiseAND(_LOW) % n) % n


@cache
def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C (Castagnoli); give the last result to go on."""
    crc ^= 0xFFFFFFFF
    for byte in data:
        crc = (crc >> 8) ^ _table()[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF
