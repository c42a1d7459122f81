"""Samples that merge: the rows of least hashed priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import SPAN, hashed


def _least(df: DataFrame, order: Sequence[str], by: Sequence[str], k: int) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


class Reservoir:
    """k rows, each row as likely as any other; the same rows whatever the order or the partitions."""

    def __init__(self, k: int, seed: int = 0, fast: bool = False) -> None:
        P.capacity(k)
        self.k, self.seed, self.fast = k, seed, fast

    def sample(self, df: DataFrame, key: str | Column, by: Sequence[str] = ()) -> DataFrame:
        col = F.col(key) if isinstance(key, str) else key
        return _least(df.withColumn("priority", hashed(col, self.seed, self.fast)), ["priority"], by, self.k)

    def merge(self, a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return _least(a.unionByName(b), ["priority"], by, self.k)

    def inclusion(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        n = F.count("*")
        return df.groupBy(*by).agg(n.alias("n"), F.least(n, F.lit(self.k)).alias("sampled"), (F.least(n, F.lit(self.k)) / n).alias("probability"))


class VarOpt:
    """Priority sampling: the k rows of least hash over weight; a row stands for max(weight, tau)."""

    def __init__(self, k: int, seed: int = 0, fast: bool = False) -> None:
        P.capacity(k)
        self.k, self.seed, self.fast = k, seed, fast

    def candidates(self, df: DataFrame, key: str | Column, weight: str, by: Sequence[str] = ()) -> DataFrame:
        """k + 1 rows a group: what merges."""
        col = F.col(key) if isinstance(key, str) else key
        rows = df.filter(F.col(weight).isNotNull() & (F.col(weight) > 0) & (F.col(weight) < float("inf")))
        rows = rows.withColumn("priority", (hashed(col, self.seed, self.fast) + 1) / float(SPAN) / F.col(weight).cast("double"))
        return _least(rows, ["priority"], by, self.k + 1)

    def merge(self, a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return _least(a.unionByName(b), ["priority"], by, self.k + 1)

    def sample(self, candidates: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
        """The k rows with their adjusted weight; tau is 0 where all rows fit."""
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        rows = candidates.withColumn("__n", F.row_number().over(w.orderBy("priority")))
        tau = F.coalesce(F.max(F.when(F.col("__n") == self.k + 1, 1 / F.col("priority"))).over(w), F.lit(0.0))
        return rows.withColumn("tau", tau).filter(F.col("__n") <= self.k).withColumn("adjusted_weight", F.greatest(F.col(weight).cast("double"), F.col("tau"))).drop("__n", "priority")

    @staticmethod
    def total(sample: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return sample.groupBy(*by).agg(F.count("*").alias("sampled"), F.sum("adjusted_weight").alias("estimated_total"), F.max("tau").alias("threshold"))


def stratified(df: DataFrame, stratum: str, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """A hash share of each stratum; the same rows on every run."""
    keep = F.lit(False)
    for s, f in fractions.items():
        P.within("fraction", f, 0.0, 1.0)
        keep = keep | ((F.col(stratum) == s) & (hashed(F.col(key), seed) < int(f * SPAN)))
    return df.filter(keep)
