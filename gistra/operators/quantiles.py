"""Quantile summaries. Null, NaN and infinite values are left out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.operators.state import State


def _values(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    col = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(*by, col.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def _w(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _qs(df: DataFrame, qs: Sequence[float]) -> DataFrame:
    for q in qs:
        P.within("q", q, 0.0, 1.0)
    return df.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))


class DDSketch:
    """Bins of relative width: a quantile is off by at most alpha times itself."""

    def __init__(self, alpha: float = 0.01) -> None:
        P.probability("alpha", alpha)
        self.alpha, self.gamma = alpha, (1 + alpha) / (1 - alpha)

    def build(self, df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> State:
        """Bins (sign, bin) with counts and extremes."""
        v = F.col("v")
        at = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) / math.log(self.gamma))).cast("int")
        rows = _values(df, value, by).select(*by, F.signum(v).cast("int").alias("sign"), at.alias("bin"), F.lit(1).cast("long").alias("cnt"), v.alias("low"), v.alias("high"))
        return State.of(rows, "ddsketch", {"alpha": self.alpha}, by, ["sign", "bin"], {"cnt": "sum", "low": "min", "high": "max"})

    def quantiles(self, state: State, qs: Sequence[float]) -> DataFrame:
        """(by, q, quantile): the bin that holds rank ceil(q n); ranks from 1."""
        by = list(state.by)
        order = F.when(F.col("sign") < 0, -F.col("bin")).otherwise(F.col("bin"))
        w = _w(by).orderBy("sign", order)
        run = state.df.withColumn("upto", F.sum("cnt").over(w)).withColumn("n", F.sum("cnt").over(_w(by)))
        value = F.col("sign") * 2 * F.pow(F.lit(self.gamma), F.col("bin")) / (self.gamma + 1)
        rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
        hit = _qs(run.withColumn("value", value), qs).filter((F.col("upto") >= rank) & (F.col("upto") - F.col("cnt") < rank))
        return hit.select(*by, "q", F.col("value").alias("quantile"))

    @staticmethod
    def summary(state: State) -> DataFrame:
        return state.df.groupBy(*state.by).agg(F.sum("cnt").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"))


class Kll:
    """Spark's KLL sketch over doubles."""

    def __init__(self, k: int = 200) -> None:
        P.within("k", k, 8, 65535)
        self.k = k

    def build(self, df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
        return _values(df, value, by).groupBy(*by).agg(F.expr(f"kll_sketch_agg_double(v, {self.k})").alias("kll"))

    @staticmethod
    def _asked(states: DataFrame, function: str, values: Sequence[float], by: Sequence[str], names: tuple[str, str]) -> DataFrame:
        """A row for each value; Spark takes them as one constant array."""
        listed = F.array(*(F.lit(float(v)) for v in values))
        got = F.call_function(function, F.col("kll"), listed)
        return states.select(*by, F.explode(F.arrays_zip(listed.alias(names[0]), got.alias(names[1]))).alias("z")).select(*by, *(F.col(f"z.{n}") for n in names))

    @classmethod
    def quantiles(cls, states: DataFrame, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
        for q in qs:
            P.within("q", q, 0.0, 1.0)
        return cls._asked(states, "kll_sketch_get_quantile_double", qs, by, ("q", "quantile"))

    @classmethod
    def ranks(cls, states: DataFrame, values: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
        return cls._asked(states, "kll_sketch_get_rank_double", values, by, ("value", "rank"))

    @staticmethod
    def merge(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return states.groupBy(*by).agg(F.expr("kll_merge_agg_double(kll)").alias("kll"))

    @staticmethod
    def count(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return states.select(*by, F.expr("kll_sketch_get_n_double(kll)").alias("n"))

    @property
    def rank_error(self) -> float:
        return 1.65 / self.k


#: Width of a zone of values, as a ratio.
ZONE = 1.004


def _running(n: DataFrame, by: Sequence[str], w: str) -> DataFrame:
    """Adds the weight up to each value ``v`` of its group, ``upto``, and the group's weight, ``n``.

    Values are dealt to zones of relative width, which are in order, and zones are summed up
    first; so a task orders the values of one zone, not those of a group.
    """
    size = F.least(F.abs("v"), F.lit(1.7e308))
    zone = F.when(F.col("v") == 0, 0).otherwise(F.signum("v") * (F.ceil(F.log(size) / math.log(ZONE)) + 400_000)).cast("long")
    rows = n.withColumn("__zone", zone)
    names = [f"__by{i}" for i in range(len(by))]
    sums = rows.groupBy(*(F.col(c).alias(name) for c, name in zip(by, names)), F.col("__zone").alias("__z")).agg(F.sum(w).alias("__in"))
    whole = _w(names)  # a row for each zone
    sums = sums.withColumn("__before", F.sum("__in").over(whole.orderBy("__z")) - F.col("__in")).withColumn("n", F.sum("__in").over(whole)).drop("__in")
    met = F.col("__zone") == F.col("__z")
    for c, name in zip(by, names):
        met = met & F.col(c).eqNullSafe(F.col(name))
    inside = F.sum(w).over(Window.partitionBy(*by, "__zone").orderBy("v"))
    return rows.withColumn("__inside", inside).join(sums, met).withColumn("upto", F.col("__before") + F.col("__inside")).drop("__zone", "__z", "__before", "__inside", *names)


def value_ranks(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, c, n, upto): distinct values, how often they occur, the group's values, and those up to this one."""
    return _running(_values(df, value, by).groupBy(*by, "v").agg(F.count("*").alias("c")), by, "c")


def exact_cdf(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, share of values up to it): cumulative counts of distinct values."""
    return value_ranks(df, value, by).select(*by, F.col("v").alias("value"), (F.col("upto") / F.col("n")).alias("cdf"))


def exact_quantiles(df: DataFrame, value: str | Column, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The least value whose cumulative share reaches q."""
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    run = _qs(value_ranks(df, value, by), qs)
    return run.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(*by, "q", F.col("v").alias("quantile"))


class Req:
    """Exact at one end of the ranks, summarized elsewhere.

    The ``k`` greatest (or least) values are kept as they are; bins of relative
    width hold the rest, so the error shrinks to nothing towards that end.
    """

    def __init__(self, k: int = 64, high_ranks: bool = True, alpha: float = 0.01) -> None:
        P.within("k", k, 4, 1024)
        self.k, self.high, self.body = k, high_ranks, DDSketch(alpha)

    def build(self, df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> tuple[DataFrame, State]:
        """(the k extreme values, bins of all values)."""
        rows = _values(df, value, by)
        order = F.desc("v") if self.high else F.asc("v")
        tail = rows.withColumn("rank", F.row_number().over(_w(by).orderBy(order))).filter(F.col("rank") <= self.k)
        return tail, self.body.build(rows, "v", by)

    def merge(self, a: tuple[DataFrame, State], b: tuple[DataFrame, State]) -> tuple[DataFrame, State]:
        by = list(a[1].by)
        order = F.desc("v") if self.high else F.asc("v")
        both = a[0].unionByName(b[0]).drop("rank")
        return both.withColumn("rank", F.row_number().over(_w(by).orderBy(order))).filter(F.col("rank") <= self.k), a[1].merge(b[1])

    def quantiles(self, model: tuple[DataFrame, State], qs: Sequence[float]) -> DataFrame:
        tail, body = model
        by = list(body.by)
        rough = self.body.quantiles(body, qs)
        n = DDSketch.summary(body).select(*by, "n")
        at = rough.join(n, by) if by else rough.join(F.broadcast(n))  # one row
        rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
        at = at.withColumn("rank", (F.col("n") - rank + 1 if self.high else rank).cast("int"))
        return at.join(tail, [*by, "rank"], "left").select(*by, "q", F.coalesce("v", "quantile").alias("quantile"))


class TDigest:
    """Centroids that are small at the ends: clusters of equal steps of the arcsine scale.

    Values are first counted, so weights may be given; each value falls in the
    cluster of the middle of its rank range, k(q) = compression / (2 pi) asin(2q - 1).
    """

    def __init__(self, compression: float = 100.0) -> None:
        P.within("compression", compression, 10, 100_000)
        self.compression = compression

    def _cluster(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """rows(v, w, low, high) -> centroids."""
        q = (F.col("upto") - F.col("w") / 2) / F.col("n")
        step = F.floor(self.compression / (2 * math.pi) * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1)))).cast("int")
        c = _running(rows, by, "w").withColumn("cluster", step)
        return c.groupBy(*by, "cluster").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))

    def build(self, df: DataFrame, value: str | Column, by: Sequence[str] = (), weight: str | None = None, shards: int = 1) -> State:
        """``shards``: values of a group are first digested in so many parts, so that one task need not rank them all."""
        rows = _values(df, value, by) if weight is None else df.select(*by, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter("v is not null and w > 0 and not isnan(v)")
        rows = rows.groupBy(*by, "v").agg((F.count("*").cast("double") if weight is None else F.sum("w")).alias("w")).withColumn("low", F.col("v")).withColumn("high", F.col("v"))
        if shards > 1:
            parts = self._cluster(rows.withColumn("__shard", F.pmod(F.xxhash64("v"), F.lit(shards))), [*by, "__shard"])
            rows = parts.select(*by, F.col("mean").alias("v"), F.col("weight").alias("w"), "low", "high")
        return State(self._cluster(rows, by), "tdigest", {"compression": self.compression}, tuple(by), ("cluster",), {})

    def merge(self, a: State, b: State) -> State:
        if a.params != b.params:
            raise P.IncompatibleStates("digests of different compression")
        rows = a.df.unionByName(b.df).select(*a.by, F.col("mean").alias("v"), F.col("weight").alias("w"), "low", "high")
        rows = rows.groupBy(*a.by, "v").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))
        return a.like(self._cluster(rows, a.by))

    def _knots(self, state: State) -> DataFrame:
        """Centroids with the rank of their middle, and the next centroid."""
        w = _w(state.by)
        o = w.orderBy("mean", "cluster")
        run = state.df.withColumn("mid", F.sum("weight").over(o) - F.col("weight") / 2).withColumn("n", F.sum("weight").over(w))
        run = run.withColumn("least", F.min("low").over(w)).withColumn("most", F.max("high").over(w))
        return run.select(
            *state.by, "mean", "mid", "n", "least", "most",
            F.lag("mid").over(o).alias("mid0"), F.lag("mean").over(o).alias("mean0"), F.lead("mid").over(o).alias("mid1"), F.lead("mean").over(o).alias("mean1"),
        )

    def quantiles(self, state: State, qs: Sequence[float]) -> DataFrame:
        """Linear between the middles of centroids, to the extremes at the ends."""
        at = F.col("q") * F.col("n")
        rows = _qs(self._knots(state), qs).withColumn("at", at)
        first, last = F.col("mid0").isNull(), F.col("mid1").isNull()
        holds = ((F.col("at") >= F.col("mid")) & (last | (F.col("at") < F.col("mid1")))) | (first & (F.col("at") < F.col("mid")))
        below = F.when(F.col("mid") > 0, F.col("least") + (F.col("mean") - F.col("least")) * F.col("at") / F.col("mid")).otherwise(F.col("least"))
        above = F.when(F.col("n") > F.col("mid"), F.col("mean") + (F.col("most") - F.col("mean")) * (F.col("at") - F.col("mid")) / (F.col("n") - F.col("mid"))).otherwise(F.col("most"))
        between = F.col("mean") + (F.col("mean1") - F.col("mean")) * (F.col("at") - F.col("mid")) / (F.col("mid1") - F.col("mid"))
        value = F.when(first & (F.col("at") < F.col("mid")), below).when(last, above).otherwise(between)
        return rows.filter(holds).select(*state.by, "q", value.alias("quantile"))

    def cdf(self, state: State, values: Sequence[float]) -> DataFrame:
        rows = self._knots(state).withColumn("value", F.explode(F.array(*map(F.lit, map(float, values)))))
        v, first, last = F.col("value"), F.col("mid0").isNull(), F.col("mid1").isNull()
        holds = ((v >= F.col("mean")) & (last | (v < F.col("mean1")))) | (first & (v < F.col("mean")))
        below = F.when(v < F.col("least"), 0.0).when(F.col("mean") > F.col("least"), F.col("mid") * (v - F.col("least")) / (F.col("mean") - F.col("least"))).otherwise(F.col("mid"))
        above = F.when(v >= F.col("most"), F.col("n")).otherwise(F.col("mid") + (F.col("n") - F.col("mid")) * (v - F.col("mean")) / (F.col("most") - F.col("mean")))
        between = F.col("mid") + (F.col("mid1") - F.col("mid")) * (v - F.col("mean")) / (F.col("mean1") - F.col("mean"))
        rank = F.when(first & (v < F.col("mean")), below).when(last, above).otherwise(between)
        return rows.filter(holds).select(*state.by, "value", (rank / F.col("n")).alias("cdf"))

    def trimmed_mean(self, state: State, low: float, high: float) -> DataFrame:
        """Mean of the mass between two quantiles: each centroid counts with what of it lies between."""
        P.within("low", low, 0, 1)
        P.within("high", high, low, 1)
        w = _w(state.by)
        run = state.df.withColumn("upto", F.sum("weight").over(w.orderBy("mean", "cluster"))).withColumn("n", F.sum("weight").over(w))
        part = F.greatest(F.lit(0.0), F.least("upto", high * F.col("n")) - F.greatest(F.col("upto") - F.col("weight"), low * F.col("n")))
        return run.withColumn("part", part).groupBy(*state.by).agg((F.sum(F.col("mean") * F.col("part")) / F.sum("part")).alias("trimmed_mean"))

    @staticmethod
    def summary(state: State) -> DataFrame:
        return state.df.groupBy(*state.by).agg(F.count("*").alias("centroids"), F.sum("weight").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"))


class Spline:
    """Evenly spaced order statistics joined by a monotone cubic."""

    def __init__(self, max_samples: int = 100) -> None:
        P.within("max_samples", max_samples, 10, 1_000_000)
        self.size = max_samples

    def build(self, df: DataFrame, value: str | Column, by: Sequence[str] = (), weight: str | None = None) -> State:
        """Knots (rank share x, value y): the values at max_samples evenly spaced ranks."""
        v = F.col(value) if isinstance(value, str) else value
        rows = df.select(*by, v.cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).filter("v is not null and not isnan(v) and w > 0")
        n = rows.groupBy(*by, "v").agg(F.sum("w").alias("w"))
        return State(self._sample(n, by), "spline", {"max_samples": self.size}, tuple(by), ("v",), {"w": "sum"})

    def _sample(self, n: DataFrame, by: Sequence[str]) -> DataFrame:
        w = _w(by)
        run = _running(n, by, "w")
        x0, x1 = (F.col("upto") - F.col("w")) / F.col("n"), F.col("upto") / F.col("n")
        # a value is kept if an evenly spaced rank falls on it, or it is an extreme
        step = self.size - 1
        hit = (F.floor(x1 * step) > F.floor(x0 * step)) | (F.col("upto") == F.col("w")) | (F.col("upto") == F.col("n"))
        kept = run.filter(hit)
        return kept.withColumn("w", F.col("upto") - F.coalesce(F.lag("upto").over(w.orderBy("v")), F.lit(0.0))).select(*by, "v", "w")

    def merge(self, a: State, b: State) -> State:
        if a.params != b.params:
            raise P.IncompatibleStates("splines of different size")
        return a.like(self._sample(a.merge(b).df, a.by))

    def query(self, state: State, qs: Sequence[float]) -> DataFrame:
        """Monotone cubic Hermite interpolation at q."""
        w = _w(state.by)
        o = w.orderBy("v")
        run = state.df.withColumn("upto", F.sum("w").over(o)).withColumn("n", F.sum("w").over(w)).withColumn("first", F.row_number().over(o) == 1)
        # the least value stands at 0, the greatest at 1
        run = run.withColumn("x", F.when(F.col("first"), 0.0).otherwise(F.col("upto") / F.col("n")))
        run = run.withColumn("x1", F.lead("x").over(o)).withColumn("y1", F.lead("v").over(o))
        run = run.withColumn("d", (F.col("y1") - F.col("v")) / (F.col("x1") - F.col("x")))
        run = run.withColumn("d0", F.lag("d").over(o))
        slope = F.when(F.col("d0").isNull(), F.col("d")).when(F.col("d").isNull(), F.col("d0")).when(F.col("d") * F.col("d0") <= 0, 0.0).otherwise(2 / (1 / F.col("d") + 1 / F.col("d0")))
        run = run.withColumn("m", slope).withColumn("m1", F.lead("m").over(o))
        t, h = F.col("t"), F.col("x1") - F.col("x")
        rows = _qs(run, qs).filter(((F.col("q") >= F.col("x")) & (F.col("q") < F.col("x1"))) | (F.col("x1").isNull() & (F.col("q") >= F.col("x"))))
        rows = rows.withColumn("t", F.when(F.col("x1").isNull(), 0.0).otherwise((F.col("q") - F.col("x")) / h))
        value = (2 * t * t * t - 3 * t * t + 1) * F.col("v") + (t * t * t - 2 * t * t + t) * h * F.col("m") + (-2 * t * t * t + 3 * t * t) * F.col("y1") + (t * t * t - t * t) * h * F.col("m1")
        return rows.select(*state.by, "q", F.when(F.col("x1").isNull(), F.col("v")).otherwise(value).alias("quantile"))

    @staticmethod
    def summary(state: State) -> DataFrame:
        return state.df.groupBy(*state.by).agg(F.count("*").alias("samples"), F.sum("w").alias("total_weight"), F.min("v").alias("min"), F.max("v").alias("max"))
