"""Byte forms of states that other systems read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistra.functions import params as P
from gistra.operators.state import State

#: Fixed values of the dense register format: precision, bits a register, header size.
PRECISION, WIDTH, HEADER = 14, 6, 16
MAGIC = b"HYLL"


def pack(ranks: dict[int, int]) -> bytes:
    """Dense registers of 6 bits, least significant first, after a 16-byte header whose cached count is marked stale."""
    out = bytearray((1 << PRECISION) * WIDTH // 8)
    for i, r in ranks.items():
        bit = i * WIDTH
        word = min(int(r), 63) << (bit % 8)
        out[bit // 8] |= word & 0xFF
        if word >> 8:
            out[bit // 8 + 1] |= word >> 8
    return MAGIC + bytes([0, 0, 0, 0]) + bytes(7) + b"\x80" + bytes(out)


def unpack(data: bytes) -> dict[int, int]:
    if data[:4] != MAGIC:
        raise ValueError("no register string")
    if data[4] != 0:
        raise ValueError("only the dense form is read")
    body = data[HEADER:]
    if len(body) != (1 << PRECISION) * WIDTH // 8:
        raise ValueError("the register string has a wrong length")
    out = {}
    for i in range(1 << PRECISION):
        bit = i * WIDTH
        word = body[bit // 8] | (body[bit // 8 + 1] << 8 if bit // 8 + 1 < len(body) else 0)
        r = word >> (bit % 8) & 63
        if r:
            out[i] = r
    return out


def to_redis(state: State) -> DataFrame:
    """One byte string per group of a precision-14 state."""
    P.one_of("precision", state.params["precision"], [PRECISION])
    @F.pandas_udf("binary")
    def form(idx: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series([pack(dict(zip(i, r))) for i, r in zip(idx, rank)])

    lists = state.df.groupBy(*state.by).agg(F.collect_list(F.struct("idx", "rank")).alias("e"))  # at most 2^14 a group
    return lists.select(*state.by, form("e.idx", "e.rank").alias("bytes"))


def from_redis(df: DataFrame, by: list[str], column: str = "bytes", fast: bool = False) -> State:
    @F.pandas_udf("array<struct<idx:int,rank:int>>")
    def parsed(data: pd.Series) -> pd.Series:
        return pd.Series([[{"idx": i, "rank": r} for i, r in unpack(bytes(b)).items()] for b in data])

    rows = df.select(*by, F.inline(parsed(column)))
    return State.of(rows, "hll", {"precision": PRECISION, "fast": fast}, by, ["idx"], {"rank": "max"})
