"""Summaries of streams: watermarks, event-time windows, stored states."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.operators.cardinality import registers
from gistra.operators.state import State


def timed(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The frame with ``ts`` as an event time that tolerates ``lateness``."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling_counts(df: DataFrame, ts: str, size: str, lateness: str = "10 minutes", by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed(df, ts, lateness).groupBy(at.alias("w"), *by).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cnt")


def session_counts(df: DataFrame, ts: str, gap: str, by: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    return timed(df, ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cnt")


def distinct_in_time(df: DataFrame, keys: Sequence[str], ts: str, lateness: str = "10 minutes") -> DataFrame:
    return timed(df, ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def windowed_sketch(df: DataFrame, item: str, ts: str, size: str, lateness: str = "10 minutes", lg_k: int = 12) -> DataFrame:
    """Distinct items per window by Spark's own mergeable sketch."""
    agg = F.hll_sketch_agg(item, F.lit(lg_k))
    return timed(df, ts, lateness).groupBy(F.window(ts, size).alias("w")).agg(agg.alias("sketch")).select(F.col("w.start").alias("start"), F.hll_sketch_estimate("sketch").alias("estimate"), "sketch")


class StoredState:
    """A state on shared storage that micro-batches are merged into.

    Every version is written to a folder of its own, named in the last line of
    the log under ``path`` by batch id, so a repeated batch changes nothing and a
    failed one leaves the version before it.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], State]) -> None:
        self.spark, self.path, self.build = spark, path, build

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch long, folder string").json(f"{self.path}/log")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> State | None:
        log = self._versions()
        last = None if log is None else log.orderBy(F.desc("batch")).limit(1).collect()
        return State.load(self.spark, last[0].folder) if last else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        log = self._versions()
        if log is not None and log.filter(F.col("batch") >= batch_id).limit(1).count():
            return
        state = self.build(batch)
        before = self.current()
        if before is not None:
            state = before.merge(state)
        folder = f"{self.path}/v{batch_id}-{uuid.uuid4().hex}"
        state.save(folder)
        self.spark.createDataFrame([(batch_id, folder)], "batch long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/log")


def stored_registers(spark: SparkSession, path: str, item: str, precision: int = 12) -> StoredState:
    return StoredState(spark, path, lambda df: registers(df, item, precision=precision))
