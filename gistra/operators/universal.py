"""Universal monitoring: one state for norms, entropy, heavy hitters and change."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gistra.functions import params as P
from gistra.functions.hashing import hashed
from gistra.operators.frequency import CountSketch, item_counts
from gistra.operators.state import State


class UnivMon:
    """Layers of sampled substreams, halving from one to the next; each keeps its greatest items and signed cells."""

    def __init__(self, max_stream_size: int, epsilon: float = 0.1, delta: float = 0.05, fast: bool = False) -> None:
        P.capacity(max_stream_size)
        self.layers = max(3, math.ceil(math.log2(max_stream_size)))
        self.sketch = CountSketch(epsilon, delta, fast=fast)
        self.fast, self.max_stream_size = fast, max_stream_size

    def keep(self, layer: Column) -> Column:
        return F.greatest(F.lit(10), F.floor(1000 / (layer + 1)))

    def layered(self, df: DataFrame, item: str | Column, value: str | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
        """(by, layer, item, cnt): layer i has the items whose hash ends in i zero bits."""
        n = item_counts(df, item, by, value)
        h = hashed(F.col("item"), 4, self.fast)
        zeros = F.least(F.length(F.regexp_extract(F.bin(h), "0*$", 0)), F.lit(self.layers - 1))
        return n.withColumn("layer", F.explode(F.sequence(F.lit(0), zeros)))

    def build(self, df: DataFrame, item: str | Column, value: str | Column | None = None, by: Sequence[str] = ()) -> tuple[State, State]:
        """(cells by layer, greatest items by layer)."""
        cells, items = self.parts(df, item, value, by)
        return cells, self._trim(items)

    def parts(self, df: DataFrame, item: str | Column, value: str | Column | None = None, by: Sequence[str] = ()) -> tuple[State, State]:
        """(cells by layer, all items by layer): what merges without loss, since an item left out of one part may be great in all."""
        rows = self.layered(df, item, value, by)
        cells = self.sketch.build(rows, "item", [*by, "layer"], "cnt")
        return cells, State(rows, "univmon_items", {"layers": self.layers}, tuple(by), ("layer", "item"), {"cnt": "sum"})

    def _trim(self, heavy: State) -> State:
        w = Window.partitionBy(*heavy.by, "layer").orderBy(F.desc("cnt"), "item")
        return heavy.like(heavy.df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= self.keep(F.col("layer"))).select(*heavy.by, "layer", "item", "cnt"))

    def merge(self, a: tuple[State, State], b: tuple[State, State]) -> tuple[State, State]:
        """The model of two ``parts`` together. Models that ``build`` has trimmed merge too, but their items' counts are then lower bounds."""
        return a[0].merge(b[0]), self._trim(a[1].merge(b[1]))

    @staticmethod
    def l1(df: DataFrame, item: str | Column, value: str | Column | None = None, by: Sequence[str] = ()) -> DataFrame:
        return item_counts(df, item, by, value).groupBy(*by).agg(F.sum("cnt").alias("l1"))

    def l2(self, model: tuple[State, State]) -> DataFrame:
        """From the cells of layer 0."""
        by = [c for c in model[0].by if c != "layer"]
        zero = State(model[0].df.filter("layer = 0").drop("layer"), "count_sketch", model[0].params, tuple(by), ("row", "col"), {"cnt": "sum"})
        return CountSketch.l2(zero)

    def g_sum(self, model: tuple[State, State], g: Column) -> DataFrame:
        """The recursive estimator of the sum of g(cnt) over items: from the top layer down,
        twice the layer above plus what this layer's items not sampled there add."""
        by = list(model[1].by)
        h = hashed(F.col("item"), 4, self.fast)
        up = F.length(F.regexp_extract(F.bin(h), "0*$", 0)) > F.col("layer")
        rows = model[1].df.withColumn("g", g).withColumn("up", up & (F.col("layer") < self.layers - 1))
        per = rows.groupBy(*by, "layer").agg(F.sum(F.when(F.col("up"), -F.col("g")).otherwise(F.when(F.col("layer") == self.layers - 1, F.col("g")).otherwise(F.col("g")))).alias("s"))
        return per.groupBy(*by).agg(F.sum(F.col("s") * F.pow(F.lit(2.0), F.col("layer"))).alias("estimate"))

    def entropy(self, model: tuple[State, State], totals: DataFrame) -> DataFrame:
        """log2(L1) - sum(cnt log2 cnt) / L1, the sum by the recursive estimator."""
        by = list(model[1].by)
        s = self.g_sum(model, F.col("cnt") * F.log2(F.col("cnt").cast("double")))
        both = s.join(totals, by) if by else s.join(F.broadcast(totals))  # one row
        return both.select(*by, (F.log2(F.col("l1").cast("double")) - F.col("estimate") / F.col("l1")).alias("entropy"))

    @staticmethod
    def heavy_hitters(model: tuple[State, State], totals: DataFrame, threshold: float) -> DataFrame:
        P.within("threshold", threshold, 1e-12, 1.0)
        by = list(model[1].by)
        rows = model[1].df.groupBy(*by, "item").agg(F.max("cnt").alias("cnt"))
        both = rows.join(totals, by) if by else rows.join(F.broadcast(totals))  # one row
        return both.filter(F.col("cnt") >= threshold * F.col("l1")).select(*by, "item", "cnt")

    @staticmethod
    def change(a: State, b: State) -> DataFrame:
        """L2 distance of two states' layer-0 cells: the median over rows."""
        if a.params != b.params:
            raise P.IncompatibleStates("states of different shape")
        x = a.df.filter("layer = 0").select("row", "col", F.col("cnt").alias("x"))
        y = b.df.filter("layer = 0").select("row", "col", F.col("cnt").alias("y"))
        d = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
        rows = x.join(y, ["row", "col"], "full_outer").groupBy("row").agg(F.sum(d * d).alias("f2"))
        return rows.agg(F.sqrt(F.sort_array(F.collect_list("f2"))[F.expr("cast(count(1) as int) div 2")].cast("double")).alias("change"))


def exact_entropy(df: DataFrame, item: str | Column, by: Sequence[str] = (), value: str | Column | None = None) -> DataFrame:
    n = item_counts(df, item, by, value).filter("cnt > 0")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    p = F.col("cnt") / F.sum("cnt").over(w)
    return n.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
