"""Range-emptiness: is there a key between low and high?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P


def _exists(keys: DataFrame, probes: DataFrame, low: str, high: str, out: str, width: int) -> DataFrame:
    """Exact semi-join on ranges.

    Keys are dealt to buckets of ``width``. A probe looks into the buckets of its
    two ends with an equality join; the buckets strictly between hold a key at all
    or not, which a table of bucket ordinals answers: the ordinal of the last
    non-empty bucket before the high end less that of the last one up to the low
    end. So a probe costs two rows however wide it is.
    """
    k = keys.select(F.col("key").cast("long").alias("key")).filter("key is not null")
    b = F.floor(F.col("key") / width).cast("long")
    zones = k.groupBy(b.alias("bucket")).agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most width keys
    ends = probes.select(low, high).filter(F.col(low) <= F.col(high)).distinct()
    lo, hi = F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long")
    at = ends.select(low, high, F.explode(F.array_distinct(F.array(lo, hi))).alias("bucket"))
    near = at.join(zones, "bucket").filter(F.exists("keys", lambda x: (x >= F.col(low)) & (x <= F.col(high)))).select(low, high)
    # inner buckets: number of non-empty buckets up to a bucket, by merging probes' ends into the bucket list
    marks = zones.select("bucket", F.lit(1).alias("full")).unionByName(ends.select(F.explode(F.array(lo, hi - 1)).alias("bucket")).distinct().withColumn("full", F.lit(0)))
    part = F.floor(F.col("bucket") / 4096).cast("long")
    marks = marks.groupBy("bucket").agg(F.max("full").alias("full")).withColumn("part", part)
    inside = F.sum("full").over(Window.partitionBy("part").orderBy("bucket"))
    totals = marks.groupBy("part").agg(F.sum("full").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each 4096 buckets
    rank = marks.withColumn("inside", inside).join(before, "part").select("bucket", (F.col("inside") + F.col("before")).alias("ordinal"))
    wide = ends.withColumn("__lo", lo).withColumn("__hi", hi).filter(F.col("__hi") - F.col("__lo") > 1)
    a = rank.select(F.col("bucket").alias("__lo"), F.col("ordinal").alias("__a"))
    z = rank.select((F.col("bucket") + 1).alias("__hi"), F.col("ordinal").alias("__z"))
    between = wide.join(a, "__lo").join(z, "__hi").filter("__z > __a").select(low, high)
    hit = near.union(between).distinct().withColumn("__hit", F.lit(True))
    return probes.join(hit, [low, high], "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def _zone(key: Column, cuts: Sequence[int], first: int = 0) -> Column:
    """The number of cut points below a key, by halving."""
    if not cuts:
        return F.lit(first)
    at = len(cuts) // 2
    return F.when(key > cuts[at], _zone(key, cuts[at + 1 :], first + at + 1)).otherwise(_zone(key, cuts[:at], first))


class Grafite:
    """Exact answers from distinct keys; ``expected_fpr`` is what an approximate one of ``bits`` would have."""

    def __init__(self, bits: int = 8, width: int = 1024) -> None:
        P.within("bits", bits, 2, 16)
        P.within("width", width, 1, 1 << 20)
        self.bits, self.width = bits, width

    def build(self, df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()

    def may_contain_range(self, keys: DataFrame, probes: DataFrame, low: str, high: str, out: str = "hit") -> DataFrame:
        return _exists(keys, probes, low, high, out, self.width)

    def may_contain(self, keys: DataFrame, probes: DataFrame, key: str, out: str = "hit") -> DataFrame:
        got = keys.select(F.col("key").alias("__key"), F.lit(True).alias("__hit"))
        return probes.join(got, F.col(key) == F.col("__key"), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit", "__key")

    def expected_fpr(self, width: Column | int) -> Column:
        return (F.lit(width) if isinstance(width, int) else width) / float(1 << (self.bits - 2))

    def stats(self, keys: DataFrame) -> DataFrame:
        return keys.agg(F.count("*").alias("key_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key")).withColumn("bits_per_key", F.lit(self.bits))


class Grf:
    """Zone map of gap-separated segments; a probe meets a segment before it meets keys."""

    #: Keys of a zone, about.
    BLOCK = 100_000

    def __init__(self, bits: int = 6, width: int = 1024) -> None:
        P.within("bits", bits, 2, 16)
        self.bits, self.width = bits, width

    def segments(self, df: DataFrame, key: str) -> DataFrame:
        """(segment, low, high, keys): broken where a gap is over twice the mean gap.

        Keys are dealt to zones at cut points from their quantiles. Segments are cut
        within zones, then those that meet at a zone's edge without such a gap are joined,
        so the zones leave no trace.
        """
        keys = df.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
        s = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
        if not s.n:
            return keys.select(F.lit(0).cast("long").alias("segment"), F.col("key").alias("low"), F.col("key").alias("high"), F.lit(0).cast("long").alias("keys"))
        wide = 2 * ((s.hi - s.lo) / max(1, s.n - 1))
        parts = -(-s.n // self.BLOCK)
        cuts = sorted(set(map(int, keys.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts)))) if parts > 1 else []
        w = Window.partitionBy("zone").orderBy("key")
        rows = keys.withColumn("zone", _zone(F.col("key"), cuts)).withColumn("gap", F.col("key") - F.lag("key").over(w))
        rows = rows.withColumn("part", F.sum(F.when(F.col("gap") > wide, 1).otherwise(0)).over(w))
        cut = rows.groupBy("zone", "part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("keys"))
        zones = rows.groupBy("zone").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("part").alias("parts"))
        o = Window.orderBy("zone")  # a row for each zone
        new = F.coalesce((F.col("low") - F.lag("high").over(o) > wide).cast("long"), F.lit(0))
        zones = zones.select("zone", "parts", new.alias("new"))
        first = F.sum(F.col("parts") + F.col("new")).over(o) - F.col("parts")
        numbered = cut.join(zones.select("zone", first.alias("first")), "zone").withColumn("segment", F.col("first") + F.col("part"))
        return numbered.groupBy("segment").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("keys").alias("keys"))

    def may_contain_range(self, df: DataFrame, key: str, probes: DataFrame, low: str, high: str, out: str = "hit") -> DataFrame:
        return _exists(df.select(F.col(key).alias("key")).distinct(), probes, low, high, out, self.width)

    def expected_fpr(self, width: int, mean_segment: float) -> float:
        factor = 0.7 if width < mean_segment else 0.85 if width < 10 * mean_segment else 1.0
        return factor * width / float(1 << self.bits)

    @staticmethod
    def stats(segments: DataFrame) -> DataFrame:
        return segments.agg(F.count("*").alias("segment_count"), F.sum("keys").alias("key_count"), F.min("low").alias("min_key"), F.max("high").alias("max_key"), F.max("keys").alias("largest_segment"))


class Memento:
    """Keys with values, bounded in number; counts how often the covered range grew."""

    def __init__(self, capacity: int, fpr: float = 0.01, width: int = 1024) -> None:
        P.capacity(capacity)
        P.probability("fpr", fpr)
        self.capacity, self.fpr, self.width = capacity, fpr, width

    def build(self, df: DataFrame, key: str, value: str | None = None) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("key"), *([F.col(value).alias("value")] if value else [])).filter("key is not null")
        n = rows.count()
        if n > self.capacity:
            raise P.InvalidParameter("rows", n, f"at most the capacity {self.capacity}")
        return rows

    def may_contain_range(self, rows: DataFrame, probes: DataFrame, low: str, high: str, out: str = "hit") -> DataFrame:
        return _exists(rows.select("key"), probes, low, high, out, self.width)

    def stats(self, rows: DataFrame, order: str = "key") -> DataFrame:
        return rows.agg(F.count("*").alias("len"), F.min("key").alias("low"), F.max("key").alias("high"), (F.count("*") / self.capacity).alias("load"))

    @staticmethod
    def expansions(df: DataFrame, key: str, order: str, block: int = 100_000) -> DataFrame:
        """How often a key lay outside the range of all keys before it, in the order of ``order``, then of the key.

        Rows are dealt into ranges of ``order`` by cut points from its quantiles.
        Each range starts with the least and greatest key of the ranges before it,
        so only rows of one range are ever put in order together.
        """
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at")).filter("key is not null and at is not null")
        parts = rows.count() // block + 1
        cuts = sorted(set(rows.approxQuantile("at", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
        zone = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c < F.col("at"))) if cuts else F.lit(0)
        rows = rows.withColumn("zone", zone)
        zones = rows.groupBy("zone").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        w = Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        before = zones.select("zone", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
        inside = Window.partitionBy("zone").orderBy("at", "key").rowsBetween(Window.unboundedPreceding, -1)
        seen = rows.select("zone", "key", F.min("key").over(inside).alias("__lo"), F.max("key").over(inside).alias("__hi")).join(before, "zone")
        grew = (F.col("key") < F.least("__lo", "lo")) | (F.col("key") > F.greatest("__hi", "hi"))  # the first key of all has nothing before it
        return seen.agg(F.count_if(grew).alias("expansions"))
