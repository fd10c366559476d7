"""Hash functions that place string and UUID keys, as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32, _TWO_31 = 1 << 32, 1 << 31


def to_signed_32(value: Column) -> Column:
    """A non-negative number below 2**32 as the signed 32-bit number with the same bits."""
    return F.when(value >= F.lit(_TWO_31), value - F.lit(_TWO_32)).otherwise(value)


def utf16(text: Column) -> Column:
    """Big-endian UTF-16 code units; their byte order is the order of strings."""
    return F.encode(text, "UTF-16BE")


def string_hash(text: Column) -> Column:
    """The 31-polynomial hash over UTF-16 code units, signed 32 bits, as bigint. Characters beyond the BMP count as two units."""
    digits = F.hex(utf16(text))
    units = F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda a, u: F.pmod(a * 31 + u, F.lit(_TWO_32)), to_signed_32)


def _uuid_words(uuid: Column) -> list[Column]:
    digits = F.regexp_replace(uuid, "-", "")
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def uuid_hash(uuid: Column) -> Column:
    """The xor of a UUID's four 32-bit words, signed, as bigint."""
    a, b, c, d = _uuid_words(uuid)
    return to_signed_32(a.bitwiseXOR(b).bitwiseXOR(c).bitwiseXOR(d))


def uuid_halves(uuid: Column) -> list[Column]:
    """The two halves of a UUID as signed 64-bit numbers; UUIDs sort by these."""
    digits = F.regexp_replace(uuid, "-", "")
    return [F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(2)]


def hash_group(hashed: Column) -> Column:
    """The grouping number of a hashed id: 31 + hash, wrapped to 32 bits, moved to non-negative numbers."""
    return to_signed_32(F.pmod(hashed + 31, F.lit(_TWO_32))) + F.lit(_TWO_31)


def java_string_hash(text: str) -> int:
    """string_hash of one Python string."""
    data, h = text.encode("utf-16-be", "surrogatepass"), 0
    for i in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[i : i + 2], "big")) % _TWO_32
    return h - _TWO_32 if h >= _TWO_31 else h


def java_uuid_hash(uuid) -> int:
    words = [uuid.int >> (32 * i) & (_TWO_32 - 1) for i in range(4)]
    h = words[0] ^ words[1] ^ words[2] ^ words[3]
    return h - _TWO_32 if h >= _TWO_31 else h


def wrapped_group(hashed: int) -> int:
    h = (hashed + 31) % _TWO_32
    return (h - _TWO_32 if h >= _TWO_31 else h) + _TWO_31
