"""Bounded-state sliding counts per key: buckets of doubling size, kept by the stream's state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gistra.functions import params as P


def add(buckets: list[tuple[int, int, int]], ts: int, k: int) -> list[tuple[int, int, int]]:
    """Buckets (newest time, size, oldest time), newest first; at most k + 1 of a size, then the two oldest merge."""
    out = sorted([(ts, 1, ts), *buckets], key=lambda b: (b[1], -b[0]))
    size = 1
    while True:
        same = [b for b in out if b[1] == size]
        if len(same) <= k + 1:
            return sorted(out, key=lambda b: (-b[0], b[1]))
        same.sort(reverse=True)
        a, b = same[-2], same[-1]
        out.remove(a)
        out.remove(b)
        out.append((a[0], 2 * size, min(a[2], b[2])))
        size *= 2


def count(buckets: list[tuple[int, int, int]], start: int) -> tuple[float, int, int]:
    """(estimate, lower, upper) of arrivals at or after ``start``: half of a bucket that lies across it may be older.

    In order of time only one bucket does; the bounds hold in any order.
    """
    live = [b for b in buckets if b[0] >= start]
    total = sum(b[1] for b in live)
    across = sum(b[1] - 1 for b in live if b[2] < start)  # the newest of each is in the window
    return total - across / 2, total - across, total


class SlidingCounter(StatefulProcessor):
    def __init__(self, window: int, epsilon: float) -> None:
        P.probability("epsilon", epsilon)
        self.window, self.k, self.room = window, -(-1 // epsilon), 1 << 18

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("buckets", "ts long, size long, first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buckets = [(r[0], r[1], r[2]) for r in self.state.get()]
        latest = max((b[0] for b in buckets), default=0)
        # rows come in chunks of no order: what is in the window of the latest is counted by time, then added in order
        ts, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in rows:
            t, c = np.unique(pdf["ts"].to_numpy(np.int64), return_counts=True)
            latest = max(latest, int(t[-1])) if len(t) else latest
            ts, n = np.concatenate([ts, t]), np.concatenate([n, c])
            if len(ts) > self.room:
                ts, n = self._by_time(ts, n, latest)
                self.room = max(self.room, 2 * len(ts))
        for t, c in zip(*map(np.ndarray.tolist, self._by_time(ts, n, latest))):
            for _ in range(c):
                buckets = add(buckets, t, int(self.k))
        buckets = [b for b in buckets if b[0] >= latest - self.window]
        self.state.put(buckets)
        est, low, high = count(buckets, latest - self.window)
        yield pd.DataFrame({"key": [str(key[0])], "now": [latest], "estimate": [float(est)], "lower": [low], "upper": [high]})

    def _by_time(self, ts: np.ndarray, n: np.ndarray, latest: int) -> tuple[np.ndarray, np.ndarray]:
        live = ts >= latest - self.window
        times, at = np.unique(ts[live], return_inverse=True)
        total = np.zeros(len(times), np.int64)
        np.add.at(total, at, n[live])
        return times, total

    def close(self) -> None:
        pass


def sliding_counter(df: DataFrame, key: str, ts: str, window: int, epsilon: float = 0.1) -> DataFrame:
    """A row per key and micro-batch: arrivals in the window up to the key's latest time. ``ts`` is a long."""
    rows = df.selectExpr(f"cast({key} as string) as key", f"cast({ts} as long) as ts").filter("ts is not null")
    return rows.groupBy("key").transformWithStateInPandas(SlidingCounter(window, epsilon), "key string, now long, estimate double, lower long, upper long", "Update", "None")
