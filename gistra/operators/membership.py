"""Membership filters, as tables of set bits, counters or fingerprints.

A filter is built from distinct items, merges by re-aggregation, and is probed
by an equality join. None has false negatives; the approximate ones have false
positives at about the rate asked for.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistra.functions import params as P
from gistra.functions.hashing import h60, hashed, positions
from gistra.operators.state import State

BLOCK_BITS = 512
COUNTER_MAX = 15
#: Bits of a filter that probes look up in one packed array (8 MB).
PACKED_BITS = 1 << 26


def _items(df: DataFrame, item: str | Column, name: str = "__item") -> DataFrame:
    col = F.col(item) if isinstance(item, str) else item
    return df.select(col.alias(name)).filter(F.col(name).isNotNull())


def bloom_shape(n: int, fpr: float) -> tuple[int, int]:
    """(bits, hashes) for n items at a false-positive rate."""
    P.capacity(n)
    P.probability("fpr", fpr)
    m = math.ceil(-n * math.log(fpr) / math.log(2) ** 2)
    return m, max(1, math.ceil(m / n * math.log(2)))


class Bloom:
    """k positions in m bits by double hashing."""

    def __init__(self, n: int, fpr: float = 0.01, m: int | None = None, k: int | None = None, fast: bool = False) -> None:
        self.m, self.k = (m, k) if m and k else bloom_shape(n, fpr)
        P.bloom(n, self.m, self.k)
        self.n, self.fpr, self.fast = n, fpr, fast

    def build(self, df: DataFrame, item: str | Column) -> State:
        at = _items(df, item).distinct().select(F.explode(positions(F.col("__item"), self.k, self.m, self.fast)).alias("pos"))
        return State.of(at, "bloom", {"m": self.m, "k": self.k, "fast": self.fast}, (), ["pos"], {})

    def _hashes(self, item: Column) -> Column:
        """What the positions of an item follow from."""
        return F.struct((hashed(item, 1, self.fast) % self.m).alias("h1"), (hashed(item, 2, self.fast) % self.m).alias("h2"))

    def _place(self, h: str, i: int) -> Column:
        """Position ``i`` of the k that ``build`` sets."""
        return F.pmod(F.col(f"{h}.h1") + i * F.col(f"{h}.h2"), F.lit(self.m))

    def packed(self, state: State) -> DataFrame:
        """One row: the bits as an array of 64-bit words."""
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
        words = state.df.groupBy(F.expr("pos div 64").alias("__w")).agg(F.bit_or(bit).alias("__b"))
        dense = state.df.sparkSession.range(-(-self.m // 64)).join(words, F.col("id") == F.col("__w"), "left").select("id", F.coalesce("__b", F.lit(0)).alias("b"))
        return dense.agg(F.sort_array(F.collect_list(F.struct("id", "b"))).alias("w")).select(F.col("w.b").alias("words"))

    def contains(self, state: State, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        """Filters of at most ``PACKED_BITS`` are looked up in one packed array, without a shuffle of the probes; larger ones are joined."""
        if self.m > PACKED_BITS:
            return self._joined(state, probes, item, out)
        words, hit = self.packed(state).scalar(), F.lit(True)
        # a generator of one row, so that no filter is pushed below it and the hashes are computed once
        rows = probes.select("*", F.explode(F.array(self._hashes(probes[item]))).alias("__h"))
        for i in range(self.k):
            p = self._place("__h", i)
            word = F.get(words, F.call_function("div", p, F.lit(64)).cast("int"))
            hit = hit & (F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return rows.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__h")

    def _joined(self, state: State, probes: DataFrame, item: str, out: str) -> DataFrame:
        # repeated positions of an item count once
        rows = probes.select(F.col(item).alias("__item")).distinct().select("__item", F.array_distinct(positions(F.col("__item"), self.k, self.m, self.fast)).alias("__p"))
        hit = rows.select("__item", F.size("__p").alias("__need"), F.explode("__p").alias("pos")).join(state.df, "pos").groupBy("__item", "__need").count().filter("count = __need").select("__item")
        return probes.join(hit.withColumn("__hit", F.lit(True)), probes[item] == F.col("__item"), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__item", "__hit")

    def filter(self, state: State, probes: DataFrame, item: str) -> DataFrame:
        """The rows that may be members: a semi-join reducer."""
        return self.contains(state, probes, item, "__maybe").filter("__maybe").drop("__maybe")

    def stats(self, state: State) -> DataFrame:
        bits = F.count("*")
        return state.df.agg(bits.alias("bits")).select(
            "bits", F.lit(self.m).alias("m"), F.lit(self.k).alias("k"),
            F.pow(F.col("bits") / self.m, F.lit(self.k)).alias("false_positive_rate"),
            F.when(F.col("bits") >= self.m, float("inf")).otherwise(-self.m * F.log(1 - F.col("bits") / self.m) / self.k).alias("items"),  # a full filter tells no number
            F.lit((self.m + 7) // 8).alias("bytes"),
        )


class BlockedBloom(Bloom):
    """All k bits of an item in one block of 512."""

    def __init__(self, n: int, fpr: float = 0.01, fast: bool = False) -> None:
        super().__init__(n, fpr, fast=fast)
        self.blocks = max(1, -(-self.m // BLOCK_BITS))
        self.m = self.blocks * BLOCK_BITS

    def _at(self, item: Column) -> Column:
        block = hashed(item, 0, self.fast) % self.blocks
        return F.transform(F.array_distinct(positions(item, self.k, BLOCK_BITS, self.fast)), lambda b: block * BLOCK_BITS + b)

    def build(self, df: DataFrame, item: str | Column) -> State:
        at = _items(df, item).distinct().select(F.explode(self._at(F.col("__item"))).alias("pos"))
        return State.of(at, "blocked_bloom", {"m": self.m, "k": self.k, "fast": self.fast}, (), ["pos"], {})

    def _hashes(self, item: Column) -> Column:
        h1, h2 = hashed(item, 1, self.fast) % BLOCK_BITS, hashed(item, 2, self.fast) % BLOCK_BITS
        return F.struct((hashed(item, 0, self.fast) % self.blocks * BLOCK_BITS).alias("h0"), h1.alias("h1"), h2.alias("h2"))

    def _place(self, h: str, i: int) -> Column:
        return F.col(f"{h}.h0") + F.pmod(F.col(f"{h}.h1") + i * F.col(f"{h}.h2"), F.lit(BLOCK_BITS))

    def _joined(self, state: State, probes: DataFrame, item: str, out: str) -> DataFrame:
        """All bits of an item lie in one block, so a probe is one row: the block's words are joined once."""
        words = state.df.groupBy(F.expr(f"pos div {BLOCK_BITS}").alias("__block")).agg(F.collect_set(F.col("pos") % BLOCK_BITS).alias("__bits"))  # at most 512 a block
        block = (hashed(F.col(item), 0, self.fast) % self.blocks).alias("__block")
        want = F.array_distinct(positions(F.col(item), self.k, BLOCK_BITS, self.fast)).alias("__want")
        rows = probes.select("*", block, want).join(words, "__block", "left")
        return rows.withColumn(out, F.coalesce(F.size(F.array_except("__want", "__bits")) == 0, F.lit(False))).drop("__block", "__want", "__bits")


class CountingBloom(Bloom):
    """Counters instead of bits, so items can be taken out again."""

    def build(self, df: DataFrame, item: str | Column, delta: str | None = None) -> State:
        """``delta``: +1 an insertion, -1 a removal; all are insertions without it."""
        col = F.col(item) if isinstance(item, str) else item
        n = df.select(col.alias("__item"), (F.col(delta) if delta else F.lit(1)).cast("long").alias("d")).filter("__item is not null")
        n = n.groupBy("__item").agg(F.sum("d").alias("cnt")).filter("cnt <> 0")  # hash each distinct item once
        at = n.select("cnt", F.explode(positions(F.col("__item"), self.k, self.m, self.fast)).alias("pos"))
        return State.of(at, "counting_bloom", {"m": self.m, "k": self.k, "fast": self.fast}, (), ["pos"], {"cnt": "sum"})

    @staticmethod
    def counters(state: State) -> DataFrame:
        """Saturated counters and whether any overflowed."""
        return state.df.select("pos", F.least(F.greatest("cnt", F.lit(0)), F.lit(COUNTER_MAX)).alias("counter"), (F.col("cnt") > COUNTER_MAX).alias("overflow"))

    def count_estimate(self, state: State, probes: DataFrame, item: str, out: str = "at_most") -> DataFrame:
        """The least counter of an item's positions: never below its count while no counter overflows."""
        rows = probes.select(F.col(item).alias("__item")).distinct()
        rows = rows.select("__item", F.explode(F.array_distinct(positions(F.col("__item"), self.k, self.m, self.fast))).alias("pos"))
        least = rows.join(self.counters(state).select("pos", "counter"), "pos", "left").groupBy("__item").agg(F.min(F.coalesce("counter", F.lit(0))).alias("__v"))
        return probes.join(least, probes[item] == F.col("__item"), "left").withColumn(out, F.coalesce("__v", F.lit(0))).drop("__item", "__v")

    def contains(self, state: State, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        return self.count_estimate(state, probes, item, "__c").withColumn(out, F.col("__c") > 0).drop("__c")


class FingerprintFilter:
    """A multiset of (bucket pair, fingerprint): what cuckoo and vacuum filters hold.

    An item's two buckets are named by the lesser one, so moving entries between
    them, a matter of memory layout, changes nothing. Taking out one copy is a
    signed count.
    """

    def __init__(self, capacity: int, fp_bits: int = 16, load: float = 0.95, fast: bool = False, kind: str = "cuckoo") -> None:
        P.capacity(capacity)
        P.within("fp_bits", fp_bits, 4, 32)
        self.buckets = 1 << max(0, (math.ceil(capacity / 4 / load) - 1).bit_length())
        self.capacity, self.fp_bits, self.fast, self.kind = capacity, fp_bits, fast, kind

    @classmethod
    def vacuum(cls, capacity: int, fpr: float = 0.01, load: float = 0.95, fast: bool = False) -> FingerprintFilter:
        P.probability("fpr", fpr)
        return cls(capacity, min(18, max(4, math.ceil(-math.log2(fpr)) + 3)), load, fast, "vacuum")  # 8 slots are probed, one bit is fixed

    def _entry(self, item: Column) -> tuple[Column, Column]:
        h = hashed(item, 0, self.fast)
        fp = F.shiftright(h, 60 - self.fp_bits).bitwiseOR(F.lit(1))
        first = h % self.buckets
        second = first.bitwiseXOR(hashed(fp, 3, self.fast) % self.buckets)
        return F.least(first, second).alias("bucket"), fp.alias("fp")

    def build(self, df: DataFrame, item: str | Column, delta: str | None = None) -> State:
        col = F.col(item) if isinstance(item, str) else item
        d = (F.col(delta) if delta else F.lit(1)).cast("long")
        n = df.select(col.alias("__item"), d.alias("d")).filter("__item is not null").groupBy("__item").agg(F.sum("d").alias("cnt"))
        rows = n.select(*self._entry(F.col("__item")), "cnt")
        return State.of(rows, self.kind, {"buckets": self.buckets, "fp_bits": self.fp_bits, "fast": self.fast}, (), ["bucket", "fp"], {"cnt": "sum"})

    def contains(self, state: State, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        bucket, fp = self._entry(F.col(item))
        held = state.df.filter("cnt > 0").select("bucket", "fp", F.lit(True).alias("__hit"))
        return probes.select("*", bucket, fp).join(held, ["bucket", "fp"], "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("bucket", "fp", "__hit")

    def stats(self, state: State) -> DataFrame:
        return state.df.filter("cnt > 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("items")).select(
            "items", F.lit(self.buckets * 4).alias("slots"), (F.col("items") / (self.buckets * 4)).alias("load_factor"), F.lit(self.buckets * 4 * self.fp_bits // 8).alias("bytes")
        )


class StableBloom:
    """A Bloom filter that forgets: counters set to a maximum and worn down as items arrive.

    Each arrival wears down ``p`` of ``m`` counters; a counter last set at arrival
    t has lost p (now - t) / m on average. The state keeps the last arrival of each
    position, so it merges by maximum and needs no order of processing.
    """

    def __init__(self, n: int, fpr: float = 0.01, bits: int = 3, fast: bool = False) -> None:
        P.within("bits", bits, 1, 8)
        m, self.k = bloom_shape(n, fpr)
        self.m, self.top, self.fast = max(64, 2 * m), (1 << bits) - 1, fast
        self.p = max(1, math.ceil(self.m * self.k / (n * self.top)))

    def build(self, df: DataFrame, item: str | Column, arrival: str) -> State:
        """``arrival``: the number of the item in the stream, a long."""
        col = F.col(item) if isinstance(item, str) else item
        last = df.select(col.alias("__item"), F.col(arrival).cast("long").alias("t")).filter("__item is not null").groupBy("__item").agg(F.max("t").alias("last"))
        at = last.select("last", F.explode(positions(F.col("__item"), self.k, self.m, self.fast)).alias("pos"))
        return State.of(at, "stable_bloom", {"m": self.m, "k": self.k, "top": self.top, "p": self.p, "fast": self.fast}, (), ["pos"], {"last": "max"})

    def counters(self, state: State, now: int | Column) -> DataFrame:
        now = F.lit(now) if isinstance(now, int) else now
        return state.df.select("pos", F.greatest(F.lit(0), self.top - F.floor(self.p * (now - F.col("last")) / self.m)).cast("int").alias("counter")).filter("counter > 0")

    def count(self, state: State, now: int, probes: DataFrame, item: str, out: str = "counter") -> DataFrame:
        rows = probes.select(F.col(item).alias("__item")).distinct()
        rows = rows.select("__item", F.explode(F.array_distinct(positions(F.col("__item"), self.k, self.m, self.fast))).alias("pos"))
        least = rows.join(self.counters(state, now).withColumnRenamed("counter", "__c"), "pos", "left").groupBy("__item").agg(F.min(F.coalesce("__c", F.lit(0))).alias("__v"))
        return probes.join(least, probes[item] == F.col("__item"), "left").withColumn(out, F.coalesce("__v", F.lit(0))).drop("__item", "__v")

    def contains(self, state: State, now: int, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        return self.count(state, now, probes, item, "__n").withColumn(out, F.col("__n") > 0).drop("__n")

    def fill_ratio(self, state: State, now: int) -> DataFrame:
        return self.counters(state, now).agg((F.count("*") / self.m).alias("fill_ratio"))


class BinaryFuse:
    """A static filter: three positions of an array whose xor is the item's fingerprint.

    Items are dealt into shards of bounded size; each shard is solved on its own.
    ``n`` is a guess: ``build`` counts the items, and deals more of them to more shards.
    """

    SHARD = 20_000

    def __init__(self, n: int, bits: int = 8) -> None:
        P.within("bits", bits, 8, 16)
        P.capacity(n)
        self.bits, self.shards = bits, max(1, -(-n // self.SHARD))

    @staticmethod
    def _h(key: int, seed: int) -> int:
        return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)

    def build(self, df: DataFrame, item: str) -> DataFrame:
        """(shard, seed, segment, cells): one row a shard."""
        bits, h = self.bits, self._h

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = pdf["key"].tolist()
            segment = max(4, math.ceil(1.23 * len(keys) / 3) + 32)
            for seed in range(100, 10_100):
                three = []
                for x in keys:
                    v = h(x, seed)
                    three.append(((v & 0xFFFFF) % segment, segment + (v >> 20 & 0xFFFFF) % segment, 2 * segment + (v >> 40) % segment))
                at: list[int] = [0] * (3 * segment)
                acc = [0] * (3 * segment)
                for k, p in enumerate(three):
                    for q in p:
                        at[q] += 1
                        acc[q] ^= k
                free = [q for q, n in enumerate(at) if n == 1]
                order = []
                while free:
                    q = free.pop()
                    if at[q] != 1:
                        continue
                    k = acc[q]
                    order.append((k, q))
                    for x in three[k]:
                        at[x] -= 1
                        acc[x] ^= k
                        if at[x] == 1:
                            free.append(x)
                if len(order) == len(keys):
                    break
            else:
                raise RuntimeError("no seed solves the shard")
            cells = np.zeros(3 * segment, np.int64)
            for k, q in reversed(order):
                cells[q] = 0
                a, b, c = three[k]
                cells[q] = (h(keys[k], 9) & ((1 << bits) - 1)) ^ cells[a] ^ cells[b] ^ cells[c]
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(keys)], "seed": [seed], "segment": [segment], "cells": [cells.tolist()]})

        keys = df.select(F.col(item).cast("long").alias("key")).filter("key is not null").distinct()
        self.shards = max(self.shards, -(-keys.count() // self.SHARD))
        keys = keys.withColumn("shard", (h60(F.col("key"), 8) % self.shards).cast("int"))
        return keys.groupBy("shard").applyInPandas(solve, "shard int, n long, seed int, segment int, cells array<long>")

    def contains(self, filters: DataFrame, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        key = F.col(item).cast("long")
        v = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")
        s = F.col("segment")
        chunk = lambda j: F.shiftright(F.col("__v"), 20 * j).bitwiseAND(0xFFFFF) % s + j * s + 1
        cell = lambda j: F.element_at("cells", chunk(j).cast("int"))
        rows = probes.withColumn("shard", (h60(key, 8) % self.shards).cast("int")).join(filters, "shard", "left").withColumn("__v", v)
        found = cell(0).bitwiseXOR(cell(1)).bitwiseXOR(cell(2)) == h60(key, 9).bitwiseAND((1 << self.bits) - 1)
        return rows.withColumn(out, F.coalesce(found, F.lit(False))).drop("shard", "n", "seed", "segment", "cells", "__v")

    def stats(self, filters: DataFrame) -> DataFrame:
        return filters.agg(F.sum("n").alias("items"), (F.sum(F.size("cells")) * self.bits / F.sum("n")).alias("bits_per_entry")).withColumn("estimated_fpr", F.lit(2.0**-self.bits))


class Ribbon:
    """Two phases: insertions until ``finalize``, queries only after it. Two probes per item."""

    def __init__(self, n: int, fpr: float = 0.01, fast: bool = False) -> None:
        P.probability("fpr", fpr)
        self.bloom = Bloom(n, fpr, m=math.ceil(n * (-math.log2(fpr) + 2)), k=2, fast=fast)
        self.pending: list[DataFrame] = []
        self.state: State | None = None

    def insert(self, df: DataFrame, item: str | Column) -> Ribbon:
        if self.state is not None:
            raise RuntimeError("insert after finalize")
        self.pending.append(_items(df, item))
        return self

    def finalize(self) -> Ribbon:
        if not self.pending:
            raise RuntimeError("nothing inserted")
        rows = self.pending[0]
        for more in self.pending[1:]:
            rows = rows.union(more)
        self.state = self.bloom.build(rows, "__item")
        return self

    def contains(self, probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        if self.state is None:
            raise RuntimeError("query before finalize")
        return self.bloom.contains(self.state, probes, item, out)

    def stats(self) -> DataFrame:
        if self.state is None:
            raise RuntimeError("query before finalize")
        return self.bloom.stats(self.state)


class LearnedBloom:
    """A fixed scorer lets likely members through; a backup filter holds the rest.

    The bias is minus the median score of the keys, so the scorer passes at most
    part of them; every key it rejects is in the backup, so none is lost.
    """

    CUT = 0.70

    def __init__(self, n: int, fpr: float = 0.01, fast: bool = False) -> None:
        if n < 10:
            raise P.InvalidParameter("n", n, "at least 10")
        self.backup = Bloom(n, fpr, fast=fast)
        self.fast = fast

    def raw(self, item: Column) -> Column:
        """0.1 times the sum of 32 hash bits, the length and a mean of the first bytes."""
        text = item.cast("string")
        bits = F.bit_count(hashed(text, 4, self.fast).bitwiseAND(0xFFFFFFFF))
        return 0.1 * (bits + F.length(text) / 1000.0 + F.ascii(text) / 255.0)

    def train(self, keys: DataFrame, item: str) -> tuple[float, State]:
        """(bias, backup state)."""
        rows = _items(keys, item, "key").distinct().withColumn("raw", self.raw(F.col("key")))
        bias = -float(rows.agg(F.percentile("raw", F.lit(0.5))).first()[0])
        low = rows.filter(1 / (1 + F.exp(-(F.col("raw") + bias))) < self.CUT)
        return bias, self.backup.build(low, "key")

    def contains(self, model: tuple[float, State], probes: DataFrame, item: str, out: str = "maybe") -> DataFrame:
        bias, state = model
        passed = 1 / (1 + F.exp(-(self.raw(F.col(item)) + bias))) >= self.CUT
        return self.backup.contains(state, probes, item, "__b").withColumn(out, F.coalesce(passed, F.lit(False)) | F.col("__b")).drop("__b")


def prefilter(fact: DataFrame, dim: DataFrame, key: str, fpr: float = 0.01, fast: bool = True) -> DataFrame:
    """fact without most of the rows that have no partner in dim; join afterwards."""
    n = max(1, dim.select(key).distinct().count())
    b = Bloom(n, fpr, fast=fast)
    return b.filter(b.build(dim, key), fact, key)
