"""Set reconciliation with invertible tables of xor cells."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistra.functions import params as P
from gistra.functions.hashing import h60
from gistra.operators.state import State


@dataclass(frozen=True)
class SetDifference:
    """What only the left set has, and what only the right one has."""

    to_insert: tuple[int, ...]
    to_remove: tuple[int, ...]

    @property
    def total(self) -> int:
        return len(self.to_insert) + len(self.to_remove)


class Iblt:
    """Each element, as a 60-bit word, is xored into three cells with a checksum."""

    def __init__(self, expected_diff: int) -> None:
        P.within("expected_diff", expected_diff, 1, 10_000_000)
        self.cells = max(9, -(-2 * expected_diff // 3) * 3)
        self.third = self.cells // 3

    @staticmethod
    def word(columns: Sequence[str | Column]) -> Column:
        """The word of a row: a hash of its columns."""
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        return h60(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols)), 6)

    def build(self, df: DataFrame, word: str, sign: int = 1, by: Sequence[str] = ()) -> State:
        x = F.col("word")
        at = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: j * self.third + F.pmod(h60(F.concat(x.cast("string"), F.lit("/"), j.cast("string")), 7), F.lit(self.third)))
        rows = df.select(*by, F.col(word).alias("word")).select(*by, "word", h60(x, 8).alias("check"), F.explode(at).alias("cell"))
        rows = rows.select(*by, "cell", F.lit(sign).cast("long").alias("cnt"), "word", "check")
        return State.of(rows, "iblt", {"cells": self.cells}, by, ["cell"], {"cnt": "sum", "word": "xor", "check": "xor"})

    @staticmethod
    def subtract(a: State, b: State) -> State:
        return a.merge(b.like(b.df.withColumn("cnt", -F.col("cnt"))))

    @staticmethod
    def _peel(cells: dict[int, list[int]], third: int) -> tuple[list[int], list[int]] | None:
        """The words with count 1 and those with count -1; None where cells are left."""
        h = lambda text, seed: int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)
        pure = [c for c, v in cells.items() if abs(v[0]) == 1]
        found: tuple[list[int], list[int]] = ([], [])
        while pure:
            c = pure.pop()
            n, word, check = cells[c]
            if abs(n) != 1 or h(word, 8) != check:
                continue
            found[n < 0].append(word)
            for j in range(3):
                at = j * third + h(f"{word}/{j}", 7) % third
                v = cells.setdefault(at, [0, 0, 0])
                v[0], v[1], v[2] = v[0] - n, v[1] ^ word, v[2] ^ check
                if abs(v[0]) == 1:
                    pure.append(at)
        return None if any(any(v) for v in cells.values()) else found

    def decode(self, state: State) -> SetDifference:
        """Peels cells that hold one element. The table's size is a parameter, so the driver's share is bounded by it."""
        found = self._peel({r["cell"]: [r["cnt"], r["word"], r["check"]] for r in state.df.collect()}, self.third)
        if found is None:
            raise ValueError("the difference is larger than the table can decode")
        return SetDifference(tuple(sorted(found[0])), tuple(sorted(found[1])))

    def difference(self, a: DataFrame, b: DataFrame, word: str, at: str) -> DataFrame:
        """(side, word) of all words that one side only has, however many; passes are written under ``at``.

        Words are dealt to shards by hash, each shard has a table of this size, and shards are decoded
        on the executors. The first pass deals by the zero bits at the hash's end, so that shards halve
        and the small ones decode: they are the whole answer, or tell how many shards the next pass needs.
        """
        spark = a.sparkSession
        third, shape = self.third, "shard long, side string, word long"

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            shard = int(pdf["shard"].iloc[0])
            found = self._peel(dict(zip(pdf["cell"].tolist(), map(list, zip(pdf["cnt"].tolist(), pdf["word"].tolist(), pdf["check"].tolist())))), third)
            if found is None:
                return pd.DataFrame([(shard, "open", None)], columns=["shard", "side", "word"]).astype({"word": "Int64"})
            rows = [(shard, "insert", w) for w in found[0]] + [(shard, "remove", w) for w in found[1]]
            return pd.DataFrame(rows, columns=["shard", "side", "word"]).astype({"shard": "int64", "side": "object", "word": "Int64"})

        h = h60(F.col("word"), 9)
        shard, shards = F.length(F.regexp_extract(F.bin(h), "0*$", 0)).cast("long"), 0
        for k in range(24):
            x, y = (d.select(F.col(word).alias("word")).distinct().withColumn("shard", shard) for d in (a, b))
            state = self.subtract(self.build(x, "word", by=["shard"]), self.build(y, "word", by=["shard"]))
            state.df.filter("cnt <> 0 or word <> 0 or check <> 0").groupBy("shard").applyInPandas(solve, shape).write.parquet(f"{at}/{k}")
            got = spark.read.schema(shape).parquet(f"{at}/{k}")
            left = got.filter("side = 'open'").agg(F.max("shard").alias("last"), F.count("*").alias("n")).first()
            if not left.n:
                return got.select("side", "word")
            if shards:
                shards *= 4
            else:  # beyond the last open shard lie all words of so many zero bits
                words = max(self.cells, got.filter(F.col("shard") > left.last).count() << left.last + 1)
                shards = -(-4 * words // self.cells)
            shard = h % shards
        raise ValueError("the difference does not decode")

    def stats(self) -> dict[str, int]:
        return {"num_cells": self.cells, "hashes": 3, "cell_bytes": 24}


def exact_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, keys): anti-joins both ways; nulls are equal to nulls."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).select(F.lit("insert").alias("side"), *keys).unionByName(right.exceptAll(left).select(F.lit("remove").alias("side"), *keys))
