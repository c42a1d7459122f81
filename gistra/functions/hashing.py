"""One canonical hash for every summary.

``h60`` has 60 bits, so it is never negative as a long, and every SQL engine
with MD5 can compute it, which lets results be checked elsewhere. ``fast60`` is
its quick counterpart for jobs that need no such check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60
SPAN = 1 << BITS


def h60(col: Column, seed: int = 0) -> Column:
    text = F.concat(F.lit(f"{seed}:"), col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def fast60(col: Column, seed: int = 0) -> Column:
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(seed)), 64 - BITS)


def hashed(col: Column, seed: int = 0, fast: bool = False) -> Column:
    return fast60(col, seed) if fast else h60(col, seed)


def positions(col: Column, k: int, m: int, fast: bool = False) -> Column:
    """k positions in 0..m-1 by double hashing: two hashes whatever k is."""
    h1 = hashed(col, 1, fast) % m
    h2 = hashed(col, 2, fast) % m
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(m)))


def rho(rest: Column, width: int) -> Column:
    """Leading zeros of a ``width``-bit number, plus one."""
    return F.when(rest == 0, F.lit(width + 1)).otherwise(F.lit(width + 1) - F.length(F.bin(rest))).cast("int")


def sign(col: Column, seed: int, fast: bool = False) -> Column:
    """+1 or -1."""
    return (F.lit(1) - F.lit(2) * (hashed(col, seed, fast) % 2)).cast("long")
