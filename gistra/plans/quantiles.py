"""Named queries of the quantile summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gistra.operators import quantiles as Q
from gistra.plans.common import r4, r6, table

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
_DD = Q.DDSketch(0.01)


def _price(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_extendedprice").alias("v"))


def _exact(s, d):
    return Q.exact_quantiles(_price(s, d), "v", QS, ["l_returnflag"]).withColumnRenamed("quantile", "exact")


def dd_bins(s, d):
    return _DD.build(_price(s, d), "v", ["l_returnflag"]).df.select("l_returnflag", "sign", "bin", "cnt")


def dd_quantiles(s, d):
    return _DD.quantiles(_DD.build(_price(s, d), "v", ["l_returnflag"]), QS).select("l_returnflag", "q", r4("quantile"))


def dd_summary(s, d):
    return _DD.summary(_DD.build(table(s, d, "customer"), "c_acctbal", ["c_mktsegment"])).select("c_mktsegment", "n", r4("min"), r4("max"))


def dd_signed(s, d):
    """Negative, zero and positive values."""
    return _DD.build(table(s, d, "customer"), "c_acctbal", ["c_mktsegment"]).df.select("c_mktsegment", "sign", "bin", "cnt")


def dd_merge(s, d):
    t = _price(s, d)
    a, b = (_DD.build(t.filter(c), "v", ["l_returnflag"]) for c in ("l_orderkey % 2 = 0", "l_orderkey % 2 = 1"))
    return a.merge(b).df.select("l_returnflag", "sign", "bin", "cnt")


def exact(s, d):
    return _exact(s, d).select("l_returnflag", "q", r4("exact"))


def _ranked(s, d, got, slack):
    """Share of quantiles whose rank is within ``slack`` of what was asked."""
    t = Q.exact_cdf(_price(s, d), "v", ["l_returnflag"])
    j = t.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag", "q").agg(
        F.coalesce(F.max(F.when(F.col("value") < F.col("quantile"), F.col("cdf"))), F.lit(0.0)).alias("low"),
        F.coalesce(F.max(F.when(F.col("value") <= F.col("quantile"), F.col("cdf"))), F.lit(0.0)).alias("high"),
    )
    return j.select("l_returnflag", "q", ((F.col("q") >= F.col("low") - slack) & (F.col("q") <= F.col("high") + slack)).alias("within_bound"))


def kll_quantiles(s, d):
    k = Q.Kll(200)
    return _ranked(s, d, k.quantiles(k.build(_price(s, d), "v", ["l_returnflag"]), QS, ["l_returnflag"]), 3 * k.rank_error)


def kll_rank(s, d):
    k = Q.Kll(400)
    got = k.ranks(k.build(_price(s, d), "v"), [10_000.0, 40_000.0, 80_000.0])
    truth = _price(s, d).agg(*(F.avg((F.col("v") <= x).cast("double")).alias(f"r{i}") for i, x in enumerate((10_000.0, 40_000.0, 80_000.0))))
    want = F.when(F.col("value") == 10_000, F.col("r0")).when(F.col("value") == 40_000, F.col("r1")).otherwise(F.col("r2"))
    return got.join(F.broadcast(truth)).select("value", (F.abs(F.col("rank") - want) <= 3 * k.rank_error).alias("within_bound"))  # one row


def kll_merge(s, d):
    k = Q.Kll(200)
    t = _price(s, d)
    parts = k.build(t.filter("l_orderkey % 2 = 0"), "v", ["l_returnflag"]).unionByName(k.build(t.filter("l_orderkey % 2 = 1"), "v", ["l_returnflag"]))
    return k.count(k.merge(parts, ["l_returnflag"]), ["l_returnflag"])


def kll_cdf(s, d):
    return Q.exact_cdf(table(s, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "value", r6("cdf"))


def req_tail(s, d):
    r = Q.Req(64, True)
    return r.build(_price(s, d), "v", ["l_returnflag"])[0].select("l_returnflag", r4("v"), "rank")


def req_quantiles(s, d):
    """Exact in the tail, within alpha elsewhere."""
    r = Q.Req(64, True)
    got = r.quantiles(r.build(_price(s, d), "v", ["l_returnflag"]), QS)
    j = got.join(_exact(s, d), ["l_returnflag", "q"])
    return j.select("l_returnflag", "q", (F.abs(F.col("quantile") - F.col("exact")) <= F.when(F.col("q") == 1, 1e-9).otherwise(0.0101 * F.col("exact"))).alias("within_bound"))


def req_merge(s, d):
    r = Q.Req(64, False)
    t = _price(s, d)
    m = r.merge(r.build(t.filter("l_orderkey % 2 = 0"), "v", ["l_returnflag"]), r.build(t.filter("l_orderkey % 2 = 1"), "v", ["l_returnflag"]))
    return m[0].select("l_returnflag", r4("v"), "rank")


def td_quantiles(s, d):
    t = Q.TDigest(100)
    return _ranked(s, d, t.quantiles(t.build(_price(s, d), "v", ["l_returnflag"], shards=8), QS), 0.01)


def td_cdf(s, d):
    t = Q.TDigest(200)
    got = t.cdf(t.build(_price(s, d), "v"), [5_000.0, 50_000.0, 90_000.0])
    truth = _price(s, d).agg(*(F.avg((F.col("v") <= x).cast("double")).alias(f"r{i}") for i, x in enumerate((5_000.0, 50_000.0, 90_000.0))))
    want = F.when(F.col("value") == 5_000, F.col("r0")).when(F.col("value") == 50_000, F.col("r1")).otherwise(F.col("r2"))
    return got.join(F.broadcast(truth)).select("value", (F.abs(F.col("cdf") - want) <= 0.01).alias("within_bound"))  # one row


def td_trimmed(s, d):
    t = Q.TDigest(400)
    got = t.trimmed_mean(t.build(_price(s, d), "v", ["l_returnflag"]), 0.1, 0.9)
    r = Q.value_ranks(_price(s, d), "v", ["l_returnflag"])
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))
    ends = {}
    for name, q in (("low", 0.1), ("high", 0.9)):  # between the two values about rank q (n - 1)
        rank = q * (F.col("n") - 1)
        ends |= {f"{name}0": at(F.floor(rank)), f"{name}1": at(F.ceil(rank)), f"{name}t": F.max(rank - F.floor(rank))}
    p = r.groupBy("l_returnflag").agg(*(c.alias(name) for name, c in ends.items()))
    p = p.selectExpr("l_returnflag", "low0 + (low1 - low0) * lowt as low", "high0 + (high1 - high0) * hight as high")
    kept = r.join(F.broadcast(p), "l_returnflag").filter("v >= low and v <= high")
    mean = kept.groupBy("l_returnflag").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"))
    return got.join(mean, "l_returnflag").select("l_returnflag", (F.abs(F.col("trimmed_mean") / F.col("m") - 1) <= 0.01).alias("within_bound"))


def td_merge(s, d):
    t = Q.TDigest(100)
    p = _price(s, d)
    m = t.merge(t.build(p.filter("l_orderkey % 2 = 0"), "v", ["l_returnflag"]), t.build(p.filter("l_orderkey % 2 = 1"), "v", ["l_returnflag"]))
    return t.summary(m).select("l_returnflag", F.col("n").cast("long").alias("n"), r4("min"), r4("max"))


def td_centroids(s, d):
    """Digest of a small table, where each cluster is an exact relational result."""
    t = Q.TDigest(50)
    return t.build(table(s, d, "customer"), "c_acctbal", ["c_mktsegment"]).df.select("c_mktsegment", F.col("weight").cast("long").alias("weight"), r4("low"), r4("high"))


def spline_knots(s, d):
    return Q.Spline(50).build(table(s, d, "orders"), "o_orderkey", ["o_orderstatus"]).df.select("o_orderstatus", F.col("v").cast("long").alias("v"))


def spline_query(s, d):
    sp = Q.Spline(200)
    return _ranked(s, d, sp.query(sp.build(_price(s, d), "v", ["l_returnflag"]), QS), 0.01)


def spline_merge(s, d):
    sp = Q.Spline(200)
    p = _price(s, d)
    m = sp.merge(sp.build(p.filter("l_orderkey % 2 = 0"), "v", ["l_returnflag"]), sp.build(p.filter("l_orderkey % 2 = 1"), "v", ["l_returnflag"]))
    return sp.summary(m).select("l_returnflag", F.col("total_weight").cast("long").alias("n"), r4("min"), r4("max"))


_LG = math.log(_DD.gamma)
_bins = lambda rows, v, by: f"select {by}, sign({v})::INT as sign, case when {v} = 0 then 0 else ceil(ln(abs({v})) / {_LG!r}) end::INT as bin, count(*) as cnt from {rows} group by all"
_P = _bins("lineitem", "l_extendedprice", "l_returnflag")
_QL = "(select unnest([" + ", ".join(f"{q!r}::double" for q in QS) + "]) as q)"
_FLAGS = f"(select distinct l_returnflag from lineitem), {_QL}"
_N = "select l_returnflag, count(*) as n, round(min(l_extendedprice), 4) as min, round(max(l_extendedprice), 4) as max from lineitem group by 1"
_OK = f"select l_returnflag, q, true as within_bound from {_FLAGS}"

QUERIES = [
    ("q01_ddsketch_bins", dd_bins, _P),
    ("q01_ddsketch_signed", dd_signed, _bins("customer", "c_acctbal", "c_mktsegment")),
    ("q02_ddsketch_quantiles", dd_quantiles, f"with b as ({_P}), r as (select *, sum(cnt) over (partition by l_returnflag order by sign, bin) as upto, sum(cnt) over (partition by l_returnflag) as n from b) select l_returnflag, q, round(sign * 2 * pow({_DD.gamma!r}, bin) / ({_DD.gamma!r} + 1), 4) as quantile from r, {_QL} where upto >= greatest(1, ceil(q * n)) and upto - cnt < greatest(1, ceil(q * n))"),
    ("q03_ddsketch_summary", dd_summary, "select c_mktsegment, count(*) as n, round(min(c_acctbal), 4) as min, round(max(c_acctbal), 4) as max from customer group by 1"),
    ("q04_ddsketch_merge", dd_merge, _P),
    ("q05_exact_quantiles", exact, f"with c as (select l_returnflag, l_extendedprice as v, count(*) as c from lineitem group by all), r as (select *, sum(c) over (partition by l_returnflag order by v) as upto, sum(c) over (partition by l_returnflag) as n from c) select l_returnflag, q, round(v, 4) as exact from r, {_QL} where upto >= greatest(1, ceil(q * n)) and upto - c < greatest(1, ceil(q * n))"),
    ("q07_kll_quantiles", kll_quantiles, _OK),
    ("q08_kll_rank", kll_rank, "select unnest([10000.0::double, 40000.0, 80000.0]) as value, true as within_bound"),
    ("q08_exact_cdf", kll_cdf, "select distinct l_returnflag, l_quantity as value, round(cume_dist() over (partition by l_returnflag order by l_quantity), 6) as cdf from lineitem"),
    ("q09_kll_merge", kll_merge, "select l_returnflag, count(*) as n from lineitem group by 1"),
    ("q10_req_tail", req_tail, "select l_returnflag, round(l_extendedprice, 4) as v, rank::INT as rank from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice desc) as rank from lineitem) where rank <= 64"),
    ("q10_req_quantiles", req_quantiles, _OK),
    ("q11_req_merge", req_merge, "select l_returnflag, round(l_extendedprice, 4) as v, rank::INT as rank from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice) as rank from lineitem) where rank <= 64"),
    ("q12_tdigest_centroids", td_centroids, f"""with c as (select c_mktsegment, c_acctbal as v, count(*)::double as w from customer group by all),
r as (select *, sum(w) over (partition by c_mktsegment order by v) as upto, sum(w) over (partition by c_mktsegment) as n from c),
k as (select *, floor({50 / (2 * math.pi)!r} * asin(greatest(-1.0, least(1.0, 2 * ((upto - w / 2) / n) - 1)))) as cluster from r)
select c_mktsegment, sum(w)::BIGINT as weight, round(min(v), 4) as low, round(max(v), 4) as high from k group by c_mktsegment, cluster"""),
    ("q13_tdigest_quantiles", td_quantiles, _OK),
    ("q13_tdigest_cdf", td_cdf, "select unnest([5000.0::double, 50000.0, 90000.0]) as value, true as within_bound"),
    ("q14_tdigest_trimmed_mean", td_trimmed, "select distinct l_returnflag, true as within_bound from lineitem"),
    ("q15_tdigest_merge", td_merge, _N),
    ("q16_spline_knots", spline_knots, "with r as (select o_orderstatus, o_orderkey as v, row_number() over (partition by o_orderstatus order by o_orderkey) as upto, count(*) over (partition by o_orderstatus) as n from orders) select o_orderstatus, v from r where floor(upto / n * 49) > floor((upto - 1) / n * 49) or upto = 1 or upto = n"),
    ("q17_spline_query", spline_query, _OK),
    ("q18_spline_merge", spline_merge, _N),
]
