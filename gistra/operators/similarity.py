"""Set and text similarity: MinHash and SimHash signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import hashed
from gistra.operators.state import COMBINE, State

SPREAD = 60


def _wide(rows: DataFrame, kind: str, params: dict, by: Sequence[str], slots: dict[str, Column], how: str) -> State:
    """A state of many columns, each computed within its aggregate.

    Computed in a projection below, all of them are arguments of the aggregation's
    code, which then can't be split and is too long to be compiled.
    """
    df = rows.groupBy(*by).agg(*(COMBINE[how](x).alias(c) for c, x in slots.items()))
    return State(df, kind, params, tuple(by), (), dict.fromkeys(slots, how))


class MinHash:
    """The least hash of a set under each of num_perm permutations: (a + i b) mod 2^31."""

    MOD = 1 << 31

    def __init__(self, num_perm: int = 64, fast: bool = False) -> None:
        P.within("num_perm", num_perm, 16, 4096)
        self.num_perm, self.fast = num_perm, fast

    def build(self, df: DataFrame, item: str | Column, by: Sequence[str]) -> State:
        """One row per set; a column per permutation, so nothing is exploded."""
        col = F.col(item) if isinstance(item, str) else item
        items = df.select(*by, col.alias("__item")).filter("__item is not null")  # minima ignore repeats: one shuffle, of partial minima
        h = items.select(*by, (hashed(F.col("__item"), 1, self.fast) % self.MOD).alias("a"), (hashed(F.col("__item"), 2, self.fast) % self.MOD).alias("b"))
        least = {f"m{i}": ((F.col("a") + i * F.col("b")).bitwiseXOR((i * 0x9E3779B1) % self.MOD)) % self.MOD for i in range(self.num_perm)}
        return _wide(h, "minhash", {"num_perm": self.num_perm, "fast": self.fast}, by, least, "min")

    def signatures(self, state: State) -> DataFrame:
        return state.df.select(*state.by, F.array(*(f"m{i}" for i in range(self.num_perm))).alias("signature"))

    def jaccard(self, left: State, right: State, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """pairs(a, b) of set names with the share of equal minima."""
        (name,) = left.by
        x = self.signatures(left).select(F.col(name).alias(a), F.col("signature").alias("__x"))
        y = self.signatures(right).select(F.col(name).alias(b), F.col("signature").alias("__y"))
        equal = F.size(F.filter(F.zip_with("__x", "__y", lambda p, q: p == q), lambda e: e))
        return pairs.join(x, a).join(y, b).withColumn("jaccard", equal / self.num_perm).drop("__x", "__y")

    def similar(self, state: State, threshold: float, bands: int = 16) -> DataFrame:
        """Pairs of sets that agree in all minima of a band, verified against the threshold.

        Sets with equal signatures are one node, named by the least of them: each
        other is paired with it (1), and nodes of a band are all compared.
        """
        (name,) = state.by
        rows = self.num_perm // bands
        # one plan for nodes and copies, so that the signatures, the costly part, are computed once
        sets = self.signatures(state).withColumn("__a", F.min(name).over(Window.partitionBy("signature")))
        nodes = sets.filter(F.col(name) == F.col("__a")).groupBy("signature").agg(F.min(name).alias(name))
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
        at = nodes.select(name, "signature", F.explode(keys).alias("key"))
        x = at.select("key", F.col(name).alias("a"), F.col("signature").alias("__x"))
        y = at.select("key", F.col(name).alias("b"), F.col("signature").alias("__y"))
        equal = F.size(F.filter(F.zip_with("__x", "__y", lambda p, q: p == q), lambda e: e))
        # compared where they meet, so only pairs at the threshold leave the join
        near = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (equal / self.num_perm >= threshold))
        near = near.select("a", "b", (equal / self.num_perm).alias("jaccard")).distinct()
        copies = sets.filter(F.col("__a") < F.col(name)).select(F.col("__a").alias("a"), F.col(name).alias("b"), F.lit(1.0).alias("jaccard"))
        return near.union(copies.filter(F.col("jaccard") >= threshold))


class SimHash:
    """Signed sums over the hash bits of weighted features; the signs are the fingerprint."""

    def __init__(self, bits: int = SPREAD, fast: bool = False) -> None:
        P.within("bits", bits, 8, SPREAD)
        self.bits, self.fast = bits, fast

    def build(self, df: DataFrame, feature: str | Column, by: Sequence[str], weight: str | Column | None = None) -> State:
        col = F.col(feature) if isinstance(feature, str) else feature
        w = (F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight).cast("long")
        # sums need no count of features first: one shuffle, of partial sums
        rows = df.select(*by, col.alias("f"), w.alias("w")).filter("f is not null")
        h = rows.select(*by, "w", hashed(F.col("f"), 0, self.fast).alias("h"))
        signed = {f"b{i}": F.when(F.shiftright("h", i).bitwiseAND(1) == 1, F.col("w")).otherwise(-F.col("w")) for i in range(self.bits)}
        return _wide(h, "simhash", {"bits": self.bits, "fast": self.fast}, by, signed, "sum")

    def fingerprints(self, state: State) -> DataFrame:
        bits = [F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(self.bits)]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return state.df.select(*state.by, total.alias("fingerprint"))

    @staticmethod
    def hamming(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)).cast("int")

    def similarity(self, a: Column, b: Column) -> Column:
        return (self.bits - self.hamming(a, b)) / float(self.bits)

    def near(self, prints: DataFrame, name: str, distance: int = 3) -> DataFrame:
        """Pairs of distinct fingerprints within ``distance``: two of distance + 2 blocks at least are equal."""
        blocks = distance + 2
        width = -(-self.bits // blocks)
        block = lambda i: F.shiftright("fingerprint", i * width).bitwiseAND((1 << width) - 1)
        sets = prints.groupBy("fingerprint").agg(F.min(name).alias(name), F.count("*").alias("copies"))
        two = [(i, j) for i in range(blocks) for j in range(i)]
        keys = F.array(*(F.struct(F.lit(n).alias("i"), (block(i) * (1 << width) + block(j)).alias("v")) for n, (i, j) in enumerate(two)))
        # dealt by number: by size, Spark would join small rows with many partners in one task
        parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = sets.select(name, "fingerprint", F.explode(keys).alias("k")).repartition(parts, "k")
        x = at.select(F.col(name).alias("a"), F.col("fingerprint").alias("fa"), "k")
        y = at.select(F.col(name).alias("b"), F.col("fingerprint").alias("fb"), "k")
        met = x.join(y, "k").filter((F.col("fa") < F.col("fb")) & (self.hamming(F.col("fa"), F.col("fb")) <= distance))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), self.hamming(F.col("fa"), F.col("fb")).alias("distance")).distinct()
