"""Distinct counting and set algebra."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import BITS, SPAN, hashed, rho
from gistra.operators.state import State


def _alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


# registers: HyperLogLog and its variants


def registers(df: DataFrame, item: str | Column, by: Sequence[str] = (), precision: int = 12, kind: str = "hll", fast: bool = False) -> State:
    """Per group and register the greatest rank.

    Items are not made distinct first: partial aggregation leaves at most one row
    a register and task to shuffle, however many distinct items there are.
    """
    if kind == "cpc":
        P.log_size(precision)
    else:
        P.precision(precision)
    col = F.col(item) if isinstance(item, str) else item
    width = BITS - precision
    items = df.select(*by, col.alias("__item")).filter("__item is not null")
    h = hashed(F.col("__item"), 0, fast)
    rows = items.withColumn("__h", h).select(*by, F.shiftright("__h", width).cast("int").alias("idx"), rho(F.col("__h").bitwiseAND((1 << width) - 1), width).alias("rank"))
    return State.of(rows, kind, {"precision": precision, "fast": fast}, by, ["idx"], {"rank": "max"})


def _sums(state: State) -> tuple[DataFrame, int]:
    m = 1 << int(state.params["precision"])
    z = F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    return state.df.groupBy(*state.by).agg(F.count("*").alias("used"), z.alias("z")).withColumn("zeros", m - F.col("used")).withColumn("z", F.col("z") + F.col("zeros")), m


def _linear(m: int) -> Column:
    return m * F.log(m / F.col("zeros"))


def hll_estimate(state: State, threshold: float = 2.5) -> DataFrame:
    """Harmonic mean, linear counting below ``threshold`` registers' worth."""
    df, m = _sums(state)
    raw = _alpha(m) * m * m / F.col("z")
    return df.select(*state.by, F.when((raw <= threshold * m) & (F.col("zeros") > 0), _linear(m)).otherwise(raw).alias("estimate"))


def ull_estimate(state: State) -> DataFrame:
    """Linear counting up to five times the registers."""
    df, m = _sums(state)
    raw = _alpha(m) * m * m / F.col("z")
    return df.select(*state.by, F.when((raw < 5.0 * m) & (F.col("zeros") > 0), _linear(m)).otherwise(raw).alias("estimate"))


def cpc_estimate(state: State) -> DataFrame:
    """Coupon counting while few slots are taken, then the harmonic mean. With the flavour of the state."""
    df, m = _sums(state)
    used, zeros = F.col("used"), F.col("zeros")
    alpha = 0.7213 / (1 + 1.079 / m) if m >= 128 else 0.673
    raw = alpha * m * m / F.col("z")
    est = (
        F.when(used < m / 10, _linear(m)).when(zeros > m / 2, _linear(m))
        .when((raw < 2.5 * m) & (zeros > 0), _linear(m)).otherwise(raw)
    )
    flavour = F.when(used > 0.75 * m, "sliding").when(used > 0.5 * m, "pinned").when(used > 3 * m / 32, "hybrid").when(used > 0, "sparse").otherwise("empty")
    return df.select(*state.by, est.alias("estimate"), flavour.alias("flavor"))


def standard_error(precision: int) -> float:
    P.precision(precision)
    return 1.04 / math.sqrt(1 << precision)


def to_binary(state: State) -> DataFrame:
    """One row per group: precision byte, then a byte per register."""
    p = int(state.params["precision"])
    every = F.sequence(F.lit(0), F.lit((1 << p) - 1))
    hexes = F.array_join(F.transform(every, lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0))), 2, "0")), "")
    packed = state.df.groupBy(*state.by).agg(F.map_from_entries(F.collect_list(F.struct("idx", "rank"))).alias("__m"))
    return packed.select(*state.by, F.unhex(F.concat(F.lit(f"{p:02X}"), hexes)).alias("bytes"))


def from_binary(df: DataFrame, by: Sequence[str] = (), column: str = "bytes", kind: str = "hll", fast: bool = False) -> State:
    """The inverse of ``to_binary``; all rows must have one precision."""
    heads = [r[0] for r in df.select(F.conv(F.hex(F.substring(column, 1, 1)), 16, 10).cast("int")).distinct().limit(2).collect()]
    if len(heads) != 1:
        raise P.IncompatibleStates("states of different precision")
    p = heads[0]
    P.precision(p)
    at = F.col("pos")
    rows = df.select(*by, F.col(column), F.posexplode(F.sequence(F.lit(0), F.lit((1 << p) - 1))).alias("pos", "idx"))
    rank = F.conv(F.hex(F.substring(F.col(column), at + 2, F.lit(1))), 16, 10).cast("int")
    rows = rows.select(*by, F.col("idx").cast("int").alias("idx"), rank.alias("rank")).filter("rank > 0")
    return State.of(rows, kind, {"precision": p, "fast": fast}, by, ["idx"], {"rank": "max"})


# Theta: the least hashes


def theta(df: DataFrame, item: str | Column, by: Sequence[str] = (), lg_k: int = 10, fast: bool = False) -> State:
    """Per group the k least distinct hashes below the (k+1)-th.

    ``bound`` is that hash, or the whole span while a group has at most k.
    """
    P.log_size(lg_k)
    col = F.col(item) if isinstance(item, str) else item
    rows = df.select(*by, hashed(col, 0, fast).alias("h")).filter("h is not null").distinct()
    return _trim(State(rows.withColumn("bound", F.lit(SPAN)), "theta", {"lg_k": lg_k, "fast": fast}, tuple(by), ("h",), {"bound": "min"}), 1 << lg_k)


def _trim(state: State, k: int | None = None) -> State:
    """All hashes below the least bound; with k, no more than k."""
    w = Window.partitionBy(*state.by) if state.by else Window.partitionBy(F.lit(0))
    df = state.df
    if k is not None:
        df = df.withColumn("__n", F.row_number().over(w.orderBy("h"))).filter(F.col("__n") <= k + 1)
        df = df.withColumn("bound", F.least("bound", F.coalesce(F.min(F.when(F.col("__n") == k + 1, F.col("h"))).over(w), F.lit(SPAN)))).drop("__n")
    df = df.withColumn("bound", F.min("bound").over(w)).filter(F.col("h") < F.col("bound"))
    return state.like(df)


def theta_union(a: State, b: State) -> State:
    return _trim(a.merge(b))


def theta_merge(a: State, b: State) -> State:
    """Union, trimmed to k again."""
    return _trim(a.merge(b), 1 << int(a.params["lg_k"]))


def _two(a: State, b: State, how: str) -> State:
    if (a.kind, a.params, a.by) != (b.kind, b.params, b.by):
        raise P.IncompatibleStates("theta states of different parameters")
    bounds = a.df.unionByName(b.df).groupBy(*a.by).agg(F.min("bound").alias("bound"))
    left = a.df.drop("bound").join(b.df.drop("bound"), [*a.by, "h"], how)
    both = left.join(bounds, list(a.by)) if a.by else left.join(F.broadcast(bounds))  # one row
    return a.like(both.filter(F.col("h") < F.col("bound")).select(*a.by, "h", "bound"))


def theta_intersect(a: State, b: State) -> State:
    return _two(a, b, "left_semi")


def theta_difference(a: State, b: State) -> State:
    return _two(a, b, "left_anti")


def theta_estimate(state: State) -> DataFrame:
    """Retained hashes over the share of the span they cover."""
    n, bound = F.count("*"), F.min("bound")
    est = F.when(bound == SPAN, n.cast("double")).otherwise(n * float(SPAN) / bound)
    return state.df.groupBy(*state.by).agg(est.alias("estimate"), n.alias("retained"), (bound / float(SPAN)).alias("theta"))


# weighted distinct counting


def weighted(df: DataFrame, item: str | Column, weight: str | Column, by: Sequence[str] = (), max_samples: int = 256, fast: bool = False) -> tuple[State, DataFrame]:
    """(weight of each distinct item, priority sample of at most max_samples of them).

    Weights that are not positive and finite are left out.
    """
    if max_samples < 32:
        raise P.InvalidParameter("max_samples", max_samples, "at least 32")
    col = F.col(item) if isinstance(item, str) else item
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    rows = df.select(*by, hashed(col, 0, fast).alias("h"), w.alias("w")).filter("h is not null and w > 0 and w < double('infinity')")
    state = State.of(rows, "qsketch", {"max_samples": max_samples, "fast": fast}, by, ["h"], {"w": "sum"})
    return state, weighted_sample(state)


def weighted_sample(state: State) -> DataFrame:
    """The max_samples items of least (hash + 1) / weight, with the adjusted weight max(w, tau)."""
    k = int(state.params["max_samples"])
    over = Window.partitionBy(*state.by) if state.by else Window.partitionBy(F.lit(0))
    ranked = state.df.withColumn("priority", (F.col("h") + 1) / float(SPAN) / F.col("w")).withColumn("__n", F.row_number().over(over.orderBy("priority", "h"))).filter(F.col("__n") <= k + 1)
    tau = F.max(F.when(F.col("__n") == k + 1, 1 / F.col("priority"))).over(over)
    return ranked.withColumn("tau", F.coalesce(tau, F.lit(0.0))).filter(F.col("__n") <= k).select(*state.by, "h", "w", F.greatest("w", "tau").alias("adjusted"))


def weighted_estimates(state: State) -> DataFrame:
    """distinct, total weight, and its estimate and 95 % half-width from the sample alone."""
    exact = state.df.groupBy(*state.by).agg(F.count("*").alias("distinct"), F.sum("w").alias("total_weight"))
    sample = weighted_sample(state).groupBy(*state.by).agg(
        F.sum("adjusted").alias("weighted_estimate"),
        (1.96 * F.sqrt(F.sum(F.when(F.col("w") < F.col("adjusted"), F.col("adjusted") * (F.col("adjusted") - F.col("w"))).otherwise(0.0)))).alias("half_width"),
    )
    return exact.join(sample, list(state.by)) if state.by else exact.join(F.broadcast(sample))  # one row
