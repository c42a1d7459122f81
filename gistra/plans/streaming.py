"""Named queries that run as streams, until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistra.operators import cardinality as C
from gistra.plans.cardinality import est_sql, regs_sql
from gistra.plans.common import folder as _folder
from gistra.plans.common import r4, table
from gistra.streaming import dgim, windows


def _events(s, d) -> DataFrame:
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _run(s, stream: DataFrame, mode: str = "append") -> DataFrame:
    at = _folder(s)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(s, d):
    out = _run(s, windows.tumbling_counts(_events(s, d), "ts", "1 day", "10 minutes", ["event_type"]))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "cnt")


def sessions(s, d):
    out = _run(s, windows.session_counts(_events(s, d), "ts", "6 hours", ["user_id"], "1 hour"))
    return out.agg(F.sum("cnt").alias("closed_rows"), F.count("*").alias("closed"))


def distinct_in_time(s, d):
    return _run(s, windows.distinct_in_time(_events(s, d).select("event_id", "ts"), ["event_id"], "ts")).select("event_id")


def stored(s, d):
    """Registers merged batch by batch into a stored state."""
    at = _folder(s)
    sink = windows.stored_registers(s, f"{at}/state", "user_id", 10)
    q = _events(s, d).writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return C.hll_estimate(sink.current()).select(r4("estimate"))


def sliding(s, d):
    """Bounded-state counts of the last day per event type: the truth lies within the bounds."""
    stream = _events(s, d).select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got: list[tuple] = []
    q = (
        dgim.sliding_counter(stream, "event_type", "t", 86_400, 0.1).writeStream.outputMode("update")
        .foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))  # a row per key and batch
        .option("checkpointLocation", f"{_folder(s)}/log").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = {k: (k, now, low, high) for k, now, _, low, high in sorted(got, key=lambda r: r[1])}
    bounds = s.createDataFrame(list(last.values()), "event_type string, now long, lower long, upper long")
    t = table(s, d, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    truth = t.join(F.broadcast(bounds), "event_type").filter("t >= now - 86400").groupBy("event_type", "lower", "upper").count()
    return truth.select("event_type", ((F.col("lower") <= F.col("count")) & (F.col("count") <= F.col("upper"))).alias("within_bound"))


QUERIES = [
    ("t12_stream_tumbling", tumbling, "with c as (select date_trunc('day', ts) as w, event_type, count(*) as cnt from events group by all) select epoch(w)::BIGINT as start, event_type, cnt from c where w + interval 1 day <= (select max(ts) - interval 10 minute from events)"),
    ("t12_stream_sessions", sessions, None),
    ("t12_stream_distinct", distinct_in_time, "select event_id from events"),
    ("t11_stored_state", stored, est_sql(regs_sql("events", "", "user_id", 10), "", 10)),
    ("t05_stream_sliding_count", sliding, "select distinct event_type, true as within_bound from events"),
]
