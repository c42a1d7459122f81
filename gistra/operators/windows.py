"""Counts and distinct counts over sliding windows of event time.

Time is a long in whatever unit the caller uses. States keep time granules, so
they merge by aggregation and accept rows in any order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import BITS, hashed, rho
from gistra.operators.cardinality import _alpha
from gistra.operators.state import State


class ExponentialHistogram:
    """Counts per granule of epsilon times the window; a window's count is off by at most the granule its edge cuts."""

    def __init__(self, window: int, epsilon: float = 0.1) -> None:
        P.within("window", window, 1, 1 << 62)
        P.probability("epsilon", epsilon)
        self.window, self.epsilon, self.granule = window, epsilon, max(1, math.floor(window * epsilon))

    def build(self, df: DataFrame, ts: str | Column, by: Sequence[str] = (), count: str | None = None) -> State:
        t = (F.col(ts) if isinstance(ts, str) else ts).cast("long")
        n = (F.col(count) if count else F.lit(1)).cast("long")
        rows = df.select(*by, F.floor(t / self.granule).cast("long").alias("granule"), n.alias("cnt"), t.alias("first"), t.alias("last")).filter("granule is not null")
        return State.of(rows, "exponential_histogram", {"window": self.window, "epsilon": self.epsilon}, by, ["granule"], {"cnt": "sum", "first": "min", "last": "max"})

    def count_range(self, state: State, start: int, end: int) -> DataFrame:
        """(estimate, lower, upper) of the count in [start, end]: granules inside count fully, cut ones by half."""
        inside = (F.col("first") >= start) & (F.col("last") <= end)
        touches = (F.col("last") >= start) & (F.col("first") <= end)
        lower = F.coalesce(F.sum(F.when(inside, F.col("cnt"))), F.lit(0))
        upper = F.coalesce(F.sum(F.when(touches, F.col("cnt"))), F.lit(0))
        return state.df.groupBy(*state.by).agg(lower.alias("lower"), upper.alias("upper")).withColumn("estimate", (F.col("lower") + F.col("upper")) / 2)

    def count(self, state: State, now: int) -> DataFrame:
        return self.count_range(state, now - self.window, now)

    def expire(self, state: State, now: int) -> State:
        return state.like(state.df.filter(F.col("last") >= now - self.window))


def sliding_counts(df: DataFrame, ts: str | Column, window: int, by: Sequence[str] = (), parts: int = 1) -> DataFrame:
    """Each row with the exact number of rows in the ``window`` up to it.

    Rows are dealt to stretches of ``parts`` windows and those of the last window before
    a stretch go to it as well, so no task holds all rows. A row counts from its time on and
    leaves after the window: a running sum, whose cost a row doesn't depend on how full the window is.
    """
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("long")
    span = window * max(1, parts)
    at, end = F.col("__t"), F.col("__t") + window + 1
    home, last = F.floor(at / span), F.floor((at + window) / span)
    step = lambda part, at, n, own=False: F.struct(part.alias("part"), at.alias("at"), F.lit(n).alias("n"), F.lit(own).alias("own"))
    here, there = [step(home, at, 1, True), step(home, end, -1)], [step(last, at, 1), step(last, end, -1)]
    rows = df.withColumn("__t", t).filter("__t is not null")
    rows = rows.withColumn("__s", F.explode(F.when(home == last, F.array(*here)).otherwise(F.array(here[0], *there))))
    w = Window.partitionBy(*by, "__s.part").orderBy("__s.at").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_window", F.sum("__s.n").over(w)).filter("__s.own").drop("__t", "__s")


class SlidingHll:
    """Registers with the latest time of each rank, so any window within the kept time can be asked for."""

    def __init__(self, precision: int = 12, max_window: int = 3600, fast: bool = False) -> None:
        P.precision(precision, 4, 16)
        P.within("max_window", max_window, 1, 1 << 62)
        self.p, self.max_window, self.fast = precision, max_window, fast

    def build(self, df: DataFrame, item: str | Column, ts: str | Column, by: Sequence[str] = ()) -> State:
        col = F.col(item) if isinstance(item, str) else item
        t = (F.col(ts) if isinstance(ts, str) else ts).cast("long")
        rows = df.select(*by, col.alias("__item"), t.alias("ts")).filter("__item is not null and ts is not null")
        width = BITS - self.p
        h = hashed(F.col("__item"), 0, self.fast)
        rows = rows.withColumn("__h", h).select(*by, F.shiftright("__h", width).cast("int").alias("idx"), rho(F.col("__h").bitwiseAND((1 << width) - 1), width).alias("rank"), "ts")
        return State.of(rows, "sliding_hll", {"precision": self.p, "max_window": self.max_window, "fast": self.fast}, by, ["idx", "rank"], {"ts": "max"})

    def estimate(self, state: State, now: int, window: int | None = None) -> DataFrame:
        """Distinct items whose latest time is in [now - window, now], for ``now`` not before the latest row."""
        window = self.max_window if window is None else window
        P.within("window", window, 0, self.max_window)
        m = 1 << self.p
        live = state.df.filter((F.col("ts") >= now - window) & (F.col("ts") <= now)).groupBy(*state.by, "idx").agg(F.max("rank").alias("rank"))
        s = live.groupBy(*state.by).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"))
        raw = _alpha(m) * m * m / (F.col("z") + m - F.col("used"))
        est = F.when((raw <= 2.5 * m) & (F.col("used") < m), m * F.log(m / (m - F.col("used")))).otherwise(raw)
        return s.select(*state.by, est.alias("estimate"))

    def decay(self, state: State, now: int) -> State:
        return state.like(state.df.filter(F.col("ts") >= now - self.max_window))

    @property
    def standard_error(self) -> float:
        return 1.04 / math.sqrt(1 << self.p)
