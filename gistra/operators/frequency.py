"""Frequency summaries: cells, signed cells, heavy hitters, turnstile counts.

Items are counted exactly per group first (map-side combined), so each distinct
item is hashed once; cells are sums of those counts. Where the streaming
originals depend on the order of arrival, the order-free counterpart with the
same guarantee is used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import hashed
from gistra.operators.state import State


def _pow2(x: float) -> int:
    return 1 << max(0, math.ceil(x) - 1).bit_length()


def item_counts(df: DataFrame, item: str | Column, by: Sequence[str] = (), count: str | Column | None = None) -> DataFrame:
    """(by, item, cnt): exact signed counts."""
    col = F.col(item) if isinstance(item, str) else item
    n = F.lit(1) if count is None else F.col(count) if isinstance(count, str) else count
    return df.select(*by, col.alias("item"), n.cast("long").alias("n")).filter("item is not null").groupBy(*by, "item").agg(F.sum("n").alias("cnt"))


def _over(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


class CountMin:
    """depth rows of width cells; an estimate is the least cell of an item, never below its count."""

    kind = "count_min"

    def __init__(self, epsilon: float = 0.01, delta: float = 0.01, width: int | None = None, depth: int | None = None, fast: bool = False) -> None:
        P.probability("epsilon", epsilon)
        P.probability("delta", delta)
        self.width, self.depth = width or self._width(epsilon), depth or max(1, math.ceil(math.log(1 / delta)))
        P.dimensions(self.width, self.depth)
        self.epsilon, self.delta, self.fast = epsilon, delta, fast

    @staticmethod
    def _width(epsilon: float) -> int:
        return _pow2(2 / epsilon)

    def cells(self, item: Column) -> Column:
        """array<row, col> by double hashing."""
        h1, h2 = hashed(item, 1, self.fast) % self.width, hashed(item, 2, self.fast) % self.width
        return F.transform(F.sequence(F.lit(0), F.lit(self.depth - 1)), lambda r: F.struct(r.alias("row"), ((h1 + r * h2) % self.width).alias("col")))

    def _params(self) -> dict[str, object]:
        return {"width": self.width, "depth": self.depth, "fast": self.fast}

    def build(self, df: DataFrame, item: str | Column, by: Sequence[str] = (), count: str | Column | None = None) -> State:
        at = item_counts(df, item, by, count).select(*by, "cnt", F.explode(self.cells(F.col("item"))).alias("c"))
        return State.of(at.select(*by, "c.row", "c.col", "cnt"), self.kind, self._params(), by, ["row", "col"], {"cnt": "sum"})

    def estimate(self, state: State, probes: DataFrame, item: str, out: str = "estimate") -> DataFrame:
        """probes (with the state's groups) and the estimate of their items."""
        by = list(state.by)
        rows = probes.select(*by, F.col(item).alias("__item")).distinct().select(*by, "__item", F.explode(self.cells(F.col("__item"))).alias("c")).select(*by, "__item", "c.row", "c.col")
        cell = F.greatest(F.coalesce("cnt", F.lit(0)), F.lit(0))
        least = rows.join(state.df, [*by, "row", "col"], "left").groupBy(*by, "__item").agg(F.min(cell).alias(out))
        return probes.join(least.withColumnRenamed("__item", item), [*by, item], "left")


class ConservativeCountMin(CountMin):
    """Cells of width e / epsilon; counts are aggregated per item before they reach a cell.

    With whole items instead of single arrivals, the conservative rule (raise a
    cell only to what the item needs) has its order-free form in taking, per
    cell, no more than the sum; states merge by sum so they never underestimate.
    """

    kind = "conservative_count_min"

    @staticmethod
    def _width(epsilon: float) -> int:
        return max(2, math.ceil(math.e / epsilon))


class CountSketch(CountMin):
    """Signed cells; the median over rows estimates a count without bias."""

    kind = "count_sketch"

    def __init__(self, epsilon: float = 0.1, delta: float = 0.01, width: int | None = None, depth: int | None = None, fast: bool = False) -> None:
        super().__init__(epsilon, delta, width, max(3, depth or math.ceil(math.log(1 / delta))), fast)

    @staticmethod
    def _width(epsilon: float) -> int:
        return _pow2(3 / epsilon**2)

    def cells(self, item: Column) -> Column:
        """array<row, col, sign>; the bits of a third hash are the signs of the rows."""
        h1, h2, h3 = (hashed(item, s, self.fast) for s in (1, 2, 3))
        h1, h2 = h1 % self.width, h2 % self.width
        sign = lambda r: F.lit(1) - 2 * F.call_function("shiftright", h3, r).bitwiseAND(1)
        return F.transform(F.sequence(F.lit(0), F.lit(self.depth - 1)), lambda r: F.struct(r.alias("row"), ((h1 + r * h2) % self.width).alias("col"), sign(r).alias("sign")))

    def build(self, df: DataFrame, item: str | Column, by: Sequence[str] = (), count: str | Column | None = None) -> State:
        at = item_counts(df, item, by, count).select(*by, "cnt", F.explode(self.cells(F.col("item"))).alias("c"))
        return State.of(at.select(*by, "c.row", "c.col", (F.col("cnt") * F.col("c.sign")).alias("cnt")), self.kind, self._params(), by, ["row", "col"], {"cnt": "sum"})

    def estimate(self, state: State, probes: DataFrame, item: str, out: str = "estimate") -> DataFrame:
        by = list(state.by)
        rows = probes.select(*by, F.col(item).alias("__item")).distinct().select(*by, "__item", F.explode(self.cells(F.col("__item"))).alias("c")).select(*by, "__item", "c.*")
        found = rows.join(state.df, [*by, "row", "col"], "left").groupBy(*by, "__item").agg(_median(F.coalesce("cnt", F.lit(0)) * F.col("sign")).alias(out))
        return probes.join(found.withColumnRenamed("__item", item), [*by, item], "left")

    @staticmethod
    def inner_product(a: State, b: State) -> DataFrame:
        """Join size of the two inputs; of a state with itself, the second moment."""
        by = list(a.by)
        dots = a.df.join(b.df.withColumnRenamed("cnt", "other"), [*by, "row", "col"]).groupBy(*by, "row").agg(F.sum(F.col("cnt") * F.col("other")).alias("dot"))
        return dots.groupBy(*by).agg(_median(F.col("dot")).alias("inner_product"))

    @staticmethod
    def l2(state: State) -> DataFrame:
        by = list(state.by)
        rows = state.df.groupBy(*by, "row").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("f2"))
        return rows.groupBy(*by).agg(F.sqrt(F.sort_array(F.collect_list("f2"))[F.expr("cast(count(1) as int) div 2")].cast("double")).alias("l2"))


def _median(values: Column) -> Column:
    """Middle of the collected values (one for each row of a summary); of an even number, the integer mean of the two middle ones."""
    ordered = F.sort_array(F.collect_list(values))
    half = F.floor(F.size(ordered) / 2).cast("int")
    upper, lower = F.get(ordered, half), F.get(ordered, half - 1)
    return F.when(F.size(ordered) % 2 == 1, upper).otherwise(F.call_function("div", upper + lower, F.lit(2)))


class Turnstile(CountMin):
    """Insertions and deletions; cells are signed sums, so deletions count."""

    kind = "turnstile"

    @staticmethod
    def l2(state: State) -> DataFrame:
        return CountSketch.l2(state)


# heavy hitters


def space_saving(df: DataFrame, item: str | Column, by: Sequence[str] = (), capacity: int = 100, count: str | Column | None = None) -> State:
    """The ``capacity`` items of greatest count, with ``err`` 0, and the stream length.

    Exact counts come first, so lower = upper = count for what is kept; ``floor``
    is the greatest count that was left out, the error bound of everything else.
    """
    if capacity < 2:
        raise P.InvalidParameter("capacity", capacity, "at least 2")
    rows = item_counts(df, item, by, count).withColumn("err", F.lit(0).cast("long"))
    return _keep(State(rows, "space_saving", {"capacity": capacity}, tuple(by), ("item",), {"cnt": "sum", "err": "sum"}), capacity)


def _beside(rows: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of their group."""
    return rows.join(per_group, list(by), "left") if by else rows.join(F.broadcast(per_group))  # one row


def _keep(state: State, capacity: int) -> State:
    """The items of greatest count. The rank is limited before rows are shuffled, totals are partial sums."""
    w = _over(state.by)
    df = state.df
    ranked = df.withColumn("__n", F.row_number().over(w.orderBy(F.desc("cnt"), "item"))).filter(F.col("__n") <= capacity + 1)
    over = F.coalesce(F.max(F.when(F.col("__n") == capacity + 1, F.col("cnt"))).over(w), F.lit(0))
    if "floor" in df.columns:
        out = ranked.withColumn("floor", F.greatest("floor", over).cast("long"))
    else:
        out = _beside(ranked.withColumn("floor", over.cast("long")), df.groupBy(*state.by).agg(F.sum("cnt").alias("total")), state.by)
    return State(out.filter(F.col("__n") <= capacity).drop("__n"), state.kind, state.params, state.by, state.keys, state.measures)


def space_saving_merge(a: State, b: State) -> State:
    """Counts add; an item missing on one side may have had up to that side's floor there."""
    if (a.kind, a.params, a.by) != (b.kind, b.params, b.by):
        raise P.IncompatibleStates("summaries of different parameters")
    by = list(a.by)
    x = a.df.select(*by, "item", F.struct("cnt", "err").alias("x"))
    y = b.df.select(*by, "item", F.struct("cnt", "err").alias("y"))
    fa = a.df.groupBy(*by).agg(F.first("floor").alias("fa"), F.first("total").alias("ta"))
    fb = b.df.groupBy(*by).agg(F.first("floor").alias("fb"), F.first("total").alias("tb"))
    both = x.join(y, [*by, "item"], "full_outer")
    both = _beside(_beside(both, fa, by), fb, by)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    cnt = F.when(F.col("x").isNull(), z("fa")).otherwise(F.col("x.cnt")) + F.when(F.col("y").isNull(), z("fb")).otherwise(F.col("y.cnt"))
    err = F.when(F.col("x").isNull(), z("fa")).otherwise(F.col("x.err")) + F.when(F.col("y").isNull(), z("fb")).otherwise(F.col("y.err"))
    rows = both.select(*by, "item", cnt.alias("cnt"), F.least(err, cnt).alias("err"), (z("fa") + z("fb")).alias("floor"), (z("ta") + z("tb")).alias("total"))
    return _keep(State(rows, a.kind, a.params, a.by, a.keys, a.measures), int(a.params["capacity"]))


def heavy_hitters(state: State, phi: float) -> DataFrame:
    """Items whose upper count is at least phi of the stream, greatest first."""
    P.probability("phi", phi)
    return bounds(state).filter(F.col("upper") >= F.ceil(phi * F.col("total"))).orderBy(*state.by, F.desc("upper"), "item")


def top_k(state: State, k: int) -> DataFrame:
    P.capacity(k)
    w = _over(state.by).orderBy(F.desc("upper"), "item")
    return bounds(state).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bounds(state: State) -> DataFrame:
    return state.df.select(*state.by, "item", (F.col("cnt") - F.col("err")).alias("lower"), F.col("cnt").alias("upper"), "floor", "total")


def frequent_items(df: DataFrame, item: str | Column, by: Sequence[str] = (), max_size: int = 64, count: str | Column | None = None) -> State:
    """At most max_size items; all items of the counts that do not fit are purged together."""
    if max_size < 2:
        raise P.InvalidParameter("max_size", max_size, "at least 2")
    rows = item_counts(df, item, by, count)
    return _purge(State(rows.withColumn("offset", F.lit(0).cast("long")), "frequent_items", {"max_size": max_size}, tuple(by), ("item",), {"cnt": "sum", "offset": "max"}))


def _purge(state: State) -> State:
    """Without the items of the counts that do not fit. How many items have a count is summed up first, so ranks need the distinct counts only."""
    n = int(state.params["max_size"])
    have = state.df.groupBy(*state.by, "cnt").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(_over(state.by).orderBy(F.desc("cnt")))
    gone = have.withColumn("__m", upto).groupBy(*state.by).agg(F.max(F.when(F.col("__m") > n, F.col("cnt"))).alias("__gone"))
    off = state.df.groupBy(*state.by).agg(F.max("offset").alias("__off"))
    rows = _beside(_beside(state.df, gone, state.by), off, state.by)
    kept = rows.filter(F.col("__gone").isNull() | (F.col("cnt") > F.col("__gone"))).withColumn("offset", F.col("__off") + F.coalesce("__gone", F.lit(0)))
    return state.like(kept.drop("__gone", "__off"))


def frequent_items_merge(a: State, b: State) -> State:
    """Counts and offsets add."""
    by = list(a.by)
    if (a.kind, a.params, a.by) != (b.kind, b.params, b.by):
        raise P.IncompatibleStates("summaries of different parameters")
    rows = a.df.unionByName(b.df).groupBy(*by, "item").agg(F.sum("cnt").alias("cnt"))
    off = a.df.groupBy(*by).agg(F.max("offset").alias("offset")).unionByName(b.df.groupBy(*by).agg(F.max("offset").alias("offset"))).groupBy(*by).agg(F.sum("offset").alias("offset"))
    return _purge(a.like(_beside(rows, off, by).select(*by, "item", "cnt", "offset")))


def frequent(state: State, threshold: int | None = None, no_false_positives: bool = True) -> DataFrame:
    """Items over the threshold (the offset if none): by lower bound, or by upper so that none is missed."""
    t = F.col("offset") if threshold is None else F.lit(threshold)
    rows = state.df.select(*state.by, "item", F.col("cnt").alias("lower"), (F.col("cnt") + F.col("offset")).alias("upper"), "offset")
    return rows.filter((F.col("lower") if no_false_positives else F.col("upper")) > t).drop("offset")


class HeavyKeeper(CountMin):
    """Cells of width e / epsilon with the k items of greatest estimate, by name."""

    kind = "heavy_keeper"
    DECAY = 1.08

    def __init__(self, k: int, epsilon: float = 0.01, delta: float = 0.01, fast: bool = False) -> None:
        P.capacity(k)
        super().__init__(epsilon, delta, width=max(16, math.ceil(math.e / epsilon)), fast=fast)
        self.k = k

    def top(self, df: DataFrame, item: str | Column, state: State | None = None) -> DataFrame:
        """The k items of greatest estimate among the k of greatest count in each hash part of the items."""
        n = item_counts(df, item)
        state = state or self.build(df, item)
        candidates = n.orderBy(F.desc("cnt"), "item").limit(self.k)
        return self.estimate(state, candidates.select("item"), "item").orderBy(F.desc("estimate"), "item").limit(self.k)

    def decay(self, state: State) -> State:
        return state.like(state.df.withColumn("cnt", F.floor(F.col("cnt") / self.DECAY).cast("long")).filter("cnt > 0"))

    def stats(self, state: State) -> DataFrame:
        return state.df.agg(F.count("*").alias("cells_used"), F.sum(F.when(F.col("row") == 0, F.col("cnt"))).alias("total")).select("*", F.lit(self.width).alias("width"), F.lit(self.depth).alias("depth"), F.lit(self.k).alias("k"))


class Elastic:
    """A heavy part, the greatest item of each bucket, and a light part of cells for the rest."""

    def __init__(self, buckets: int, depth: int = 4, fast: bool = False) -> None:
        P.within("depth", depth, 1, 8)
        self.buckets = _pow2(buckets)
        self.light = CountMin(width=max(16, self.buckets), depth=depth, fast=fast)
        self.fast = fast

    def build(self, df: DataFrame, item: str | Column, count: str | Column | None = None) -> tuple[DataFrame, State]:
        """(bucket, item, cnt) of the heavy part, and the light state."""
        n = item_counts(df, item, (), count).withColumn("bucket", hashed(F.col("item"), 0, self.fast) % self.buckets)
        heavy = n.groupBy("bucket").agg(F.max(F.struct(F.col("cnt"), F.col("item"))).alias("m")).select("bucket", "m.item", "m.cnt")
        rest = n.join(heavy.select("bucket", "item"), ["bucket", "item"], "left_anti")
        return heavy, self.light.build(rest, "item", (), "cnt")

    def estimate(self, model: tuple[DataFrame, State], probes: DataFrame, item: str, out: str = "estimate") -> DataFrame:
        heavy, light = model
        low = self.light.estimate(light, probes.select(item).distinct(), item, "__light")
        high = heavy.select(F.col("item").alias(item), F.col("cnt").alias("__heavy"))
        return probes.join(low, item, "left").join(high, item, "left").withColumn(out, F.coalesce("__heavy", "__light", F.lit(0))).drop("__heavy", "__light")

    def heavy_hitters(self, model: tuple[DataFrame, State], threshold: int) -> DataFrame:
        return model[0].filter(F.col("cnt") >= threshold).select("item", "cnt").orderBy(F.desc("cnt"), "item")

    def merge(self, a: tuple[DataFrame, State], b: tuple[DataFrame, State]) -> tuple[DataFrame, State]:
        """Equal items add; the lesser of two different ones moves to the light part."""
        n = a[0].unionByName(b[0]).groupBy("bucket", "item").agg(F.sum("cnt").alias("cnt"))
        heavy = n.groupBy("bucket").agg(F.max(F.struct(F.col("cnt"), F.col("item"))).alias("m")).select("bucket", "m.item", "m.cnt")
        moved = self.light.build(n.join(heavy.select("bucket", "item"), ["bucket", "item"], "left_anti"), "item", (), "cnt")
        return heavy, a[1].merge(b[1], moved)


class Salsa(CountMin):
    """Cells with a confidence for each estimate, from how many updates the summary has seen."""

    kind = "salsa"

    def estimate(self, state: State, probes: DataFrame, item: str, out: str = "estimate") -> DataFrame:
        by = list(state.by)
        got = super().estimate(state, probes, item, out)
        total = state.df.filter("row = 0").groupBy(*by).agg(F.least(F.lit(100), F.expr("cast(sum(cnt) as bigint) div 10")).alias("confidence"))
        return got.join(total, by, "left") if by else got.join(F.broadcast(total))  # one row

    @staticmethod
    def stats(state: State) -> DataFrame:
        return state.df.groupBy(*state.by).agg(F.max("cnt").alias("max_observed"), F.sum(F.when(F.col("row") == 0, F.col("cnt"))).alias("total_updates"))


class Nitro:
    """A base summary fed with a hash sample of the items; estimates are scaled back."""

    SCALE = 10_000

    def __init__(self, base: CountMin, rate: float) -> None:
        P.within("rate", rate, 1e-4, 1.0)
        self.base, self.rate = base, rate

    def _in(self, key: Column) -> Column:
        return hashed(key, 5, self.base.fast) % self.SCALE < int(self.rate * self.SCALE)

    def build(self, df: DataFrame, item: str, row: str) -> State:
        """``row`` names the row, so that each arrival is sampled on its own."""
        return self.base.build(df.filter(self._in(F.col(row))), item)

    def query(self, state: State, probes: DataFrame, item: str, out: str = "estimate") -> DataFrame:
        return self.base.estimate(state, probes, item, out).withColumn(out, F.round(F.col(out) / self.rate).cast("long"))

    def stats(self, df: DataFrame, row: str) -> DataFrame:
        return df.agg(F.count_if(self._in(F.col(row))).alias("sampled"), F.count_if(~self._in(F.col(row))).alias("unsampled"))
