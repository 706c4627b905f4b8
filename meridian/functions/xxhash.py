"""XXH64 with seed 0, as a Catalyst expression and as plain Python for driver-side metadata.

Spark SQL's own xxhash64() has seed 42; the expression behind it takes any seed, so the seed-0 hash stays inside
generated code. One 8-byte input must be BIGINT, since an INT hashes four bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_M = (1 << 64) - 1
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _round(acc: int, lane: int) -> int:
    return _rotl((acc + lane * P2) & _M, 31) * P1 & _M


def xxh64(data: bytes, seed: int = 0) -> int:
    """The unsigned 64-bit hash of some bytes."""
    n, at = len(data), 0
    if n >= 32:
        accs = [(seed + P1 + P2) & _M, (seed + P2) & _M, seed & _M, (seed - P1) & _M]
        while at + 32 <= n:
            for i in range(4):
                accs[i] = _round(accs[i], int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little"))
            at += 32
        h = sum(_rotl(a, r) for a, r in zip(accs, (1, 7, 12, 18), strict=True)) & _M
        for a in accs:
            h = ((h ^ _round(0, a)) * P1 + P4) & _M
    else:
        h = (seed + P5) & _M
    h = (h + n) & _M
    while at + 8 <= n:
        h = (_rotl(h ^ _round(0, int.from_bytes(data[at : at + 8], "little")), 27) * P1 + P4) & _M
        at += 8
    if at + 4 <= n:
        h = (_rotl(h ^ (int.from_bytes(data[at : at + 4], "little") * P1 & _M), 23) * P2 + P3) & _M
        at += 4
    for b in data[at:]:
        h = _rotl(h ^ (b * P5 & _M), 11) * P1 & _M
    h = (h ^ (h >> 33)) * P2 & _M
    h = (h ^ (h >> 29)) * P3 & _M
    return h ^ (h >> 32)


def xxh64_column(c: Column) -> Column:
    """XXH64 with seed 0 of a BIGINT or BINARY column, as a signed BIGINT."""
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm
    util = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.PythonUtils.toSeq([util.expression(c._jc)]), 0)
    return Column(util.column(hashed))


def unsigned_mod(h: Column, n: int) -> Column:
    """h mod n of a BIGINT that stands for an unsigned number."""
    high = (1 << 64) % n
    return F.pmod(F.pmod(h, F.lit(n).cast("long")) + F.when(h < 0, F.lit(high)).otherwise(F.lit(0)), F.lit(n).cast("long")).cast("int")
