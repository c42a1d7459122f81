"""States of summaries: plain tables that merge by re-aggregation.

A state has one row per occupied register, cell, bin or entry (and per group).
Building is a projection and a ``groupBy``; merging is a union and the same
``groupBy``; finishing is a projection over few rows. Spark's partial
aggregation, spill and recovery therefore apply to every summary alike, and a
state can be stored, read back and merged with a later one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.functions.params import IncompatibleStates

#: How a measure column combines.
COMBINE: dict[str, Callable[[str], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "or": F.bit_or, "xor": F.bit_xor}


@dataclass(frozen=True)
class State:
    """``keys`` identify a row within a group; ``measures`` maps a column to its combiner."""

    df: DataFrame
    kind: str
    params: dict[str, object]
    by: Sequence[str] = ()
    keys: Sequence[str] = ()
    measures: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, kind: str, params: dict, by: Sequence[str], keys: Sequence[str], measures: dict[str, str]) -> State:
        """The state of contribution rows."""
        return cls(_combined(rows, [*by, *keys], measures), kind, dict(params), tuple(by), tuple(keys), dict(measures))

    def like(self, df: DataFrame) -> State:
        return State(df, self.kind, self.params, self.by, self.keys, self.measures)

    def merge(self, *others: State) -> State:
        """The state of all their inputs together."""
        out = self.df
        for o in others:
            if (o.kind, o.params, tuple(o.by)) != (self.kind, self.params, tuple(self.by)):
                raise IncompatibleStates(f"{self.kind} {self.params} by {list(self.by)} and {o.kind} {o.params} by {list(o.by)}")
            out = out.unionByName(o.df)
        return self.like(_combined(out, [*self.by, *self.keys], self.measures))

    def rollup(self, by: Sequence[str]) -> State:
        """The state for coarser groups."""
        rows = self.df.select(*by, *self.keys, *self.measures)
        return State.of(rows, self.kind, self.params, by, self.keys, self.measures)

    def save(self, path: str, mode: str = "overwrite") -> None:
        spec = json.dumps({"kind": self.kind, "params": self.params, "by": list(self.by), "keys": list(self.keys), "measures": self.measures})
        self.df.withColumn("__spec", F.lit(spec)).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        df = spark.read.parquet(path)
        specs = [r[0] for r in df.select("__spec").distinct().limit(2).collect()]
        if len(specs) != 1:
            raise IncompatibleStates(f"{path} holds {'no state' if not specs else 'states of different parameters'}")
        s = json.loads(specs[0])
        return cls(df.drop("__spec"), s["kind"], s["params"], tuple(s["by"]), tuple(s["keys"]), s["measures"])

    def size(self) -> DataFrame:
        """Rows of state per group."""
        return self.df.groupBy(*self.by).agg(F.count("*").alias("rows"))


def _combined(rows: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    if not measures:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*(COMBINE[how](c).alias(c) for c, how in measures.items()))
