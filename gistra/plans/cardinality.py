"""Named queries of distinct counting and set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistra.operators import cardinality as C
from gistra.plans.common import H, r4, r6, rho_sql, table
from gistra.sources import codecs


def regs_sql(items: str, by: str, x: str, p: int) -> str:
    w = 60 - p
    b = f"{by}, " if by else ""
    return f"select {b}(h >> {w})::INT as idx, max({rho_sql(f'(h & {(1 << w) - 1})', w)})::INT as rank from (select distinct {b}{H(0, x)} as h from {items}) group by all"


def _alpha_m2(p: int) -> float:
    m = 1 << p
    return C._alpha(m) * m * m


def est_sql(regs: str, by: str, p: int, limit: float = 2.5, strict: bool = False) -> str:
    m = 1 << p
    b = f"{by}, " if by else ""
    raw, op = f"{_alpha_m2(p)!r} / (z + {m} - used)", "<" if strict else "<="
    return f"""select {b}round(case when {raw} {op} {limit * m} and used < {m} then {m} * ln({m} / ({m} - used)) else {raw} end, 4) as estimate
from (select {b}count(*)::double as used, sum(pow(2.0, -rank)) as z from ({regs}) {'group by ' + by if by else ''})"""


def _lineitem(s, d):
    return table(s, d, "lineitem")


def hll_registers(s, d):
    return C.registers(_lineitem(s, d), "l_partkey", ["l_returnflag"]).df


def hll_estimate(s, d):
    return C.hll_estimate(C.registers(_lineitem(s, d), "l_partkey", ["l_returnflag"])).select("l_returnflag", r4("estimate"))


def hll_merge(s, d):
    t = _lineitem(s, d)
    a = C.registers(t.filter("l_linenumber <= 2"), "l_orderkey", ["l_linestatus"])
    b = C.registers(t.filter("l_linenumber > 2"), "l_orderkey", ["l_linestatus"])
    return C.hll_estimate(a.merge(b)).select("l_linestatus", r4("estimate"))


def hll_rollup(s, d):
    return C.hll_estimate(C.registers(_lineitem(s, d), "l_suppkey", ["l_returnflag", "l_linestatus"]).rollup([])).select(r4("estimate"))


def hll_codec(s, d):
    state = C.registers(table(s, d, "events"), "user_id", ["event_type"], precision=8)
    return C.from_binary(C.to_binary(state), ["event_type"]).df.select("event_type", "idx", "rank")


def hll_redis(s, d):
    state = C.registers(table(s, d, "orders"), "o_custkey", ["o_orderstatus"], precision=14)
    return codecs.from_redis(codecs.to_redis(state), ["o_orderstatus"]).df.select("o_orderstatus", "idx", "rank")


def hll_constants(s, d):
    rows = s.range(4, 19).select(F.col("id").cast("int").alias("precision"))
    m = F.expr("shiftleft(1, precision)")
    return rows.select("precision", m.cast("long").alias("num_registers"), r6(1.04 / F.sqrt(m.cast("double")), "standard_error"))


def ull_estimate(s, d):
    return C.ull_estimate(C.registers(table(s, d, "events"), "user_id", ["event_type"], precision=10, kind="ull")).select("event_type", r4("estimate"))


def ull_merge(s, d):
    t = table(s, d, "events")
    a, b = (C.registers(t.filter(c), "user_id", precision=10, kind="ull") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return C.ull_estimate(a.merge(b)).select(r4("estimate"))


def cpc_estimate(s, d):
    return C.cpc_estimate(C.registers(table(s, d, "orders"), "o_custkey", ["o_orderpriority"], precision=11, kind="cpc")).select("o_orderpriority", r4("estimate"), "flavor")


def cpc_merge(s, d):
    t = table(s, d, "orders")
    a, b = (C.registers(t.filter(c), "o_custkey", precision=11, kind="cpc") for c in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"))
    return a.merge(b).df


def _theta(s, d, kind, lg_k=7):
    return C.theta(table(s, d, "lineitem").filter((F.col("l_returnflag") == kind) & (F.col("l_linenumber") == 1)), "l_partkey", lg_k=lg_k)


def theta_build(s, d):
    return C.theta(table(s, d, "lineitem"), "l_partkey", ["l_returnflag"], lg_k=6).df.select("l_returnflag", "h", "bound")


def theta_estimate(s, d):
    return C.theta_estimate(C.theta(table(s, d, "lineitem"), "l_partkey", ["l_returnflag"], lg_k=8)).select("l_returnflag", r4("estimate"), "retained", r6("theta"))


def theta_union(s, d):
    return C.theta_union(_theta(s, d, "A"), _theta(s, d, "R")).df.select("h", "bound")


def theta_merge(s, d):
    t = table(s, d, "lineitem")
    a, b = (C.theta(t.filter(c), "l_orderkey", lg_k=8) for c in ("l_linenumber <= 2", "l_linenumber > 2"))
    return C.theta_merge(a, b).df.select("h", "bound")


def theta_intersect(s, d):
    return C.theta_intersect(_theta(s, d, "A"), _theta(s, d, "R")).df.select("h", "bound")


def theta_difference(s, d):
    return C.theta_difference(_theta(s, d, "A"), _theta(s, d, "R")).df.select("h", "bound")


def qsketch(s, d):
    state, _ = C.weighted(table(s, d, "orders"), "o_custkey", F.round("o_totalprice"), ["o_orderstatus"])
    return C.weighted_estimates(state).select("o_orderstatus", "distinct", r4("total_weight"))


def qsketch_sample(s, d):
    _, sample = C.weighted(table(s, d, "orders"), "o_custkey", F.round("o_totalprice"), ["o_orderstatus"], max_samples=64)
    return sample.select("o_orderstatus", "h", r4("w"))


def qsketch_weighted(s, d):
    """The total from the sample alone lies within its bounds widened to 4 sigma."""
    state, _ = C.weighted(table(s, d, "orders"), "o_custkey", F.round("o_totalprice"), ["o_orderstatus"])
    e = C.weighted_estimates(state)
    ok = F.abs(F.col("weighted_estimate") - F.col("total_weight")) <= F.greatest(F.col("half_width") * 4 / 1.96, F.col("total_weight") * 0.5)
    return e.select("o_orderstatus", ok.alias("within_bound"))


def built_in_distinct(s, d):
    # distinct first: beside a distinct count Spark would keep each summary per distinct item
    t = table(s, d, "lineitem").select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(12))).alias("hll"), F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey, 12))").alias("theta"),
        F.approx_count_distinct("l_partkey", 0.02).alias("acd"), F.count("l_partkey").alias("distinct"),
    )
    near = lambda c: F.abs(F.col(c) - F.col("distinct")) <= 0.1 * F.col("distinct")
    return t.select("l_returnflag", "distinct", (near("hll") & near("theta") & near("acd")).alias("within_bound"))


def _theta_sql(rows: str, by: str, x: str, k: int) -> str:
    b = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""(select {b}h, min(bound) over ({part}) as bound from (
  select {b}h, n, coalesce(min(case when n = {k + 1} then h end) over ({part}), {1 << 60}) as bound
  from (select *, row_number() over ({part} order by h) as n from (select distinct {b}{H(0, x)} as h from {rows})) where n <= {k + 1}) where h < bound)"""


_EV = lambda kind: _theta_sql(f"(select * from lineitem where l_returnflag = '{kind}' and l_linenumber = 1)", "", "l_partkey", 128)
_CPC = regs_sql("orders", "o_orderpriority", "o_custkey", 11)
_ORD = "(select o_orderstatus, h, sum(w) as w from (select o_orderstatus, " + H(0, "o_custkey") + " as h, round(o_totalprice) as w from orders) group by all)"

QUERIES = [
    ("c02_hll_registers", hll_registers, regs_sql("lineitem", "l_returnflag", "l_partkey", 12)),
    ("c03_hll_estimate", hll_estimate, est_sql(regs_sql("lineitem", "l_returnflag", "l_partkey", 12), "l_returnflag", 12)),
    ("c04_hll_merge", hll_merge, est_sql(regs_sql("lineitem", "l_linestatus", "l_orderkey", 12), "l_linestatus", 12)),
    ("c04_hll_rollup", hll_rollup, est_sql(regs_sql("lineitem", "", "l_suppkey", 12), "", 12)),
    ("c05_hll_codec", hll_codec, regs_sql("events", "event_type", "user_id", 8)),
    ("c06_hll_redis", hll_redis, regs_sql("orders", "o_orderstatus", "o_custkey", 14)),
    ("c07_hll_constants", hll_constants, "select p::INT as precision, (1::BIGINT << p) as num_registers, round(1.04 / sqrt((1::BIGINT << p)::double), 6) as standard_error from range(4, 19) t(p)"),
    ("c09_ull_cardinality", ull_estimate, est_sql(regs_sql("events", "event_type", "user_id", 10), "event_type", 10, 5.0, True)),
    ("c10_ull_merge", ull_merge, est_sql(regs_sql("events", "", "user_id", 10), "", 10, 5.0, True)),
    ("c12_cpc_estimate", cpc_estimate, f"""select o_orderpriority, round(case when used < 204.8 or 2048 - used > 1024 then 2048 * ln(2048 / (2048 - used))
  when raw < 5120 and used < 2048 then 2048 * ln(2048 / (2048 - used)) else raw end, 4) as estimate,
  case when used > 1536 then 'sliding' when used > 1024 then 'pinned' when used > 192 then 'hybrid' when used > 0 then 'sparse' else 'empty' end as flavor
from (select o_orderpriority, count(*)::double as used, {0.7213 / (1 + 1.079 / 2048) * 2048 * 2048!r} / (sum(pow(2.0, -rank)) + 2048 - count(*)) as raw from ({_CPC}) group by 1)"""),
    ("c14_cpc_merge", cpc_merge, regs_sql("orders", "", "o_custkey", 11)),
    ("c15_theta_build", theta_build, "select l_returnflag, h, bound from " + _theta_sql("lineitem", "l_returnflag", "l_partkey", 64)),
    ("c16_theta_estimate", theta_estimate, f"select l_returnflag, round(case when min(bound) = {1 << 60} then count(*)::double else count(*) * {float(1 << 60)!r} / min(bound) end, 4) as estimate, count(*) as retained, round(min(bound) / {float(1 << 60)!r}, 6) as theta from " + _theta_sql("lineitem", "l_returnflag", "l_partkey", 256) + " group by 1"),
    ("c17_theta_union", theta_union, f"with u as (select * from {_EV('A')} union all select * from {_EV('R')}), t as (select min(bound) as b from u) select distinct h, b as bound from u, t where h < b"),
    ("c18_theta_intersect", theta_intersect, f"with x as (select * from {_EV('A')}), y as (select * from {_EV('R')}), t as (select min(bound) as b from (select bound from x union all select bound from y)) select h, b as bound from x, t where h < b and h in (select h from y)"),
    ("c19_theta_difference", theta_difference, f"with x as (select * from {_EV('A')}), y as (select * from {_EV('R')}), t as (select min(bound) as b from (select bound from x union all select bound from y)) select h, b as bound from x, t where h < b and h not in (select h from y)"),
    ("c20_theta_merge", theta_merge, "select h, bound from " + _theta_sql("lineitem", "", "l_orderkey", 256)),
    ("c22_qsketch_distinct", qsketch, f"select o_orderstatus, count(*) as distinct, round(sum(w), 4) as total_weight from {_ORD} group by 1".replace("as distinct", 'as "distinct"')),
    ("c21_qsketch_sample", qsketch_sample, f"select o_orderstatus, h, round(w, 4) as w from (select *, row_number() over (partition by o_orderstatus order by (h + 1) / {float(1 << 60)!r} / w, h) as n from {_ORD} where w > 0) where n <= 64"),
    ("c23_qsketch_weighted", qsketch_weighted, "select distinct o_orderstatus, true as within_bound from orders"),
    ("c24_built_in_distinct", built_in_distinct, 'select l_returnflag, count(distinct l_partkey) as "distinct", true as within_bound from lineitem group by 1'),
]
