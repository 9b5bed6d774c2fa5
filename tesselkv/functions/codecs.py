"""Byte layouts of keys, values and pointers, as column expressions.

Key: user key, then the version as 8 bytes, big-endian.  Value: user_meta, meta,
expires_at as a varint (7 bits a byte, low ones first, the high bit set on all but
the last), then the value.  Pointer: fid, len and offset, 4 bytes each, big-endian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselkv.schema import be64, from_be64

_MOST = 10  # bytes of a varint


def _byte(number: Column) -> Column:
    return F.lpad(F.hex(number), 2, "0")


def varint(number: Column) -> Column:
    """A number from 0 on as a varint."""
    n = number.cast("bigint")
    digits = []
    for i in range(_MOST - 1):
        low = F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127))
        more = F.shiftrightunsigned(n, 7 * (i + 1)) != 0
        needed = F.lit(True) if i == 0 else F.shiftrightunsigned(n, 7 * i) != 0
        digits.append(F.when(needed, _byte(low + F.when(more, 128).otherwise(0))).otherwise(F.lit("")))
    return F.unhex(F.concat(*digits))


def encode_key(key: str, version: str) -> Column:
    return F.concat(F.col(key), be64(F.col(version)))


def decode_key(packed: str) -> Column:
    n = F.octet_length(packed)
    return F.struct(F.substring(F.col(packed), F.lit(1), n - 8).alias("user_key"), from_be64(F.substring(F.col(packed), n - 7, F.lit(8))).alias("version"))


def encode_value(user_meta: Column, meta: Column, expires_at: Column, value: Column) -> Column:
    return F.concat(F.unhex(_byte(user_meta)), F.unhex(_byte(meta)), varint(expires_at), value)


def decode_value(packed: str) -> Column:
    data = F.col(packed)
    at = lambda i: F.conv(F.hex(F.substring(data, F.lit(i), F.lit(1))), 16, 10).cast("bigint")
    size, number, open_ = F.lit(0), F.lit(0).cast("bigint"), F.lit(True)
    for i in range(_MOST - 1):
        b = at(i + 3)
        number = number + F.when(open_, F.shiftleft(b.bitwiseAND(F.lit(127)), 7 * i)).otherwise(F.lit(0))
        size = size + F.when(open_, 1).otherwise(0)
        open_ = open_ & (b >= 128)
    rest = F.substring(data, size + 3, F.octet_length(packed))
    return F.struct(at(1).cast("int").alias("user_meta"), at(2).cast("int").alias("meta"), number.alias("expires_at"), rest.alias("value"))


def encode_pointer(vptr: str) -> Column:
    parts = [F.unhex(F.lpad(F.hex(F.col(f"{vptr}.{c}").cast("bigint")), 8, "0")) for c in ("fid", "len", "offset")]
    return F.concat(*parts)


def decode_pointer(packed: str) -> Column:
    part = lambda i: F.conv(F.hex(F.substring(F.col(packed), 4 * i + 1, 4)), 16, 10).cast("bigint")
    return F.struct(part(0).alias("fid"), part(1).alias("len"), part(2).alias("offset"))
