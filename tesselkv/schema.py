"""The versioned record and its column expressions.

A record is (user_key, version) -> (value, expires_at, user_meta, meta); ``vptr``
points into the value log where the value is kept apart.  Order is by key, newest
version first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of ``meta``.
DELETE, VALUE_POINTER, DISCARD_EARLIER, MERGE, TXN, FIN_TXN = 1, 2, 4, 8, 64, 128
RESERVED_PREFIX = b"!sys!"
MAX_KEY_BYTES = 65_000
MAX_VERSION = (1 << 63) - 1

VPTR = T.StructType([T.StructField("fid", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("offset", T.IntegerType())])

KV = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("expires_at", T.LongType(), False),
        T.StructField("user_meta", T.ShortType(), False),
        T.StructField("meta", T.ShortType(), False),
        T.StructField("vptr", VPTR),
    ]
)

KV_COLUMNS = KV.fieldNames()


def has(bit: int, meta: str = "meta") -> Column:
    """Whether ``bit`` is set; null flags are no flags."""
    return F.coalesce(F.col(meta), F.lit(0)).bitwiseAND(F.lit(bit)) != 0


def deleted(meta: str = "meta") -> Column:
    return has(DELETE, meta)


def expired(now: int, expires_at: str = "expires_at") -> Column:
    """0 and null mean never; the second of expiry is already expired."""
    at = F.coalesce(F.col(expires_at), F.lit(0))
    return (at != 0) & (at <= F.lit(now))


def gone(now: int) -> Column:
    return deleted() | expired(now)


def blank() -> Column:
    """An empty value without a flag stands for no record.  A null value is not empty."""
    return (F.octet_length("value") == 0) & (F.coalesce(F.col("meta"), F.lit(0)) == 0)


def after_prefix(prefix: bytes) -> bytes | None:
    """The least key above all keys with ``prefix``; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def key_bytes(key: bytes) -> Column:
    return F.lit(bytearray(key)).cast("binary")


def in_prefix(prefix: bytes, key: str = "user_key") -> Column:
    """Keys with ``prefix``, as a range: a range reaches the Parquet scan, startswith does not."""
    end = after_prefix(prefix)
    low = F.col(key) >= key_bytes(prefix)
    return low if end is None else low & (F.col(key) < key_bytes(end))


def in_range(start: bytes | None = None, end: bytes | None = None, key: str = "user_key") -> Column:
    """``start`` <= key < ``end``; None leaves a side open."""
    inside = F.col(key).isNotNull()
    if start is not None:
        inside = inside & (F.col(key) >= key_bytes(start))
    return inside & (F.col(key) < key_bytes(end)) if end is not None else inside


def be64(number: Column) -> Column:
    """A number as 8 bytes that sort as it does (numbers from 0 on)."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 16, "0"))


def from_be64(data: Column) -> Column:
    """8 bytes as a number; from 2**63 on negative, as the same 64 bits are."""
    return F.conv(F.hex(data), 16, -10).cast("bigint")


def namespace(offset: int, key: str = "user_key") -> Column:
    """The 8 bytes at ``offset`` as a number; null for a key of ``offset + 8`` bytes or less."""
    part = F.substring(F.col(key), offset + 1, 8)
    return F.when(F.octet_length(key) > offset + 8, from_be64(part))


def entry_size(threshold: int) -> Column:
    """Bytes an entry counts for in a batch: a separated value counts as its pointer."""
    k, v = F.octet_length("user_key"), F.coalesce(F.octet_length("value"), F.lit(0))
    return F.when(v < threshold, k + v + 2).otherwise(k + 12 + 2).cast("bigint")


def write_error(max_value: int, banned: list[int] | None = None, namespace_offset: int | None = None) -> Column:
    """The name of the error a write of this row meets, or null."""
    key = F.col("user_key")
    error = F.when(key.isNull() | (F.octet_length(key) == 0), "EmptyKey")
    error = error.when(in_prefix(RESERVED_PREFIX), "InvalidKey").when(F.octet_length(key) > MAX_KEY_BYTES, "InvalidKey")
    error = error.when(F.octet_length("value") > max_value, "ValueLogSize")
    if banned and namespace_offset is not None:
        error = error.when(namespace(namespace_offset).isin(banned), "BannedKey")
    return error
