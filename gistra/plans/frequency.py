"""Named queries of the frequency summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistra.operators import frequency as Q
from gistra.plans.common import H, r6, table

_CM = Q.CountMin(0.01, 0.01)
_CC = Q.ConservativeCountMin(0.02, 0.01)
_CS = Q.CountSketch(0.1, 0.01)
_TS = Q.Turnstile(0.01, 0.05)
_HK = Q.HeavyKeeper(10, 0.002, 0.01)
_EL = Q.Elastic(64, 4)
_SA = Q.Salsa(0.01, 0.01)
_NI = Q.Nitro(Q.CountMin(0.01, 0.01), 0.25)


def _events(s, d):
    return table(s, d, "events")


def _signed(s, d):
    n = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return _events(s, d).select("user_id", n.alias("d")).filter("d <> 0")


def _users(s, d):
    return _events(s, d).select("user_id").distinct()


def cms_cells(s, d):
    return _CM.build(_events(s, d), "user_id", ["event_type"]).df


def cms_estimate(s, d):
    state = _CM.build(table(s, d, "lineitem"), "l_partkey")
    return _CM.estimate(state, table(s, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("l_partkey", F.col("estimate").cast("long").alias("estimate"))


def cms_merge(s, d):
    t = _events(s, d)
    return _CM.build(t.filter("event_id % 2 = 0"), "user_id").merge(_CM.build(t.filter("event_id % 2 = 1"), "user_id")).df


def conservative_estimate(s, d):
    state = _CC.build(_events(s, d), "user_id", (), None)
    return _CC.estimate(state, _users(s, d), "user_id").select("user_id", F.col("estimate").cast("long").alias("estimate"))


def conservative_merge(s, d):
    """Merged states never underestimate."""
    t = _events(s, d)
    state = _CC.build(t.filter("event_id % 3 = 0"), "user_id").merge(_CC.build(t.filter("event_id % 3 <> 0"), "user_id"))
    truth = t.groupBy("user_id").count()
    return _CC.estimate(state, truth, "user_id").agg(F.count_if(F.col("estimate") < F.col("count")).alias("under"), F.count("*").alias("users"))


def cs_cells(s, d):
    return _CS.build(_events(s, d), "user_id", ["event_type"]).df.filter("cnt <> 0")


def cs_estimate(s, d):
    state = _CS.build(_signed(s, d), "user_id", (), "d")
    return _CS.estimate(state, _users(s, d), "user_id").select("user_id", F.col("estimate").cast("long").alias("estimate"))


def cs_inner(s, d):
    a = _CS.build(_events(s, d).filter("event_type = 'click'"), "user_id")
    b = _CS.build(_events(s, d).filter("event_type = 'purchase'"), "user_id")
    return _CS.inner_product(a, b).select(F.col("inner_product").cast("long").alias("inner_product"))


def cs_merge(s, d):
    t = _events(s, d)
    return _CS.build(t.filter("event_id < 5000"), "user_id").merge(_CS.build(t.filter("event_id >= 5000"), "user_id")).df.filter("cnt <> 0")


def ss_heavy(s, d):
    return Q.heavy_hitters(Q.space_saving(table(s, d, "lineitem"), "l_suppkey", ["l_returnflag"], 50), 0.01).select("l_returnflag", "item", "lower", "upper", "total")


def ss_top(s, d):
    return Q.top_k(Q.space_saving(_events(s, d), "user_id", capacity=40), 10).select("item", "upper", "rank")


def ss_merge(s, d):
    """After a merge, lower <= count <= upper for all that is kept."""
    t = _events(s, d)
    m = Q.space_saving_merge(Q.space_saving(t.filter("event_id % 2 = 0"), "user_id", capacity=40), Q.space_saving(t.filter("event_id % 2 = 1"), "user_id", capacity=40))
    truth = t.groupBy(F.col("user_id").alias("item")).count()
    j = Q.bounds(m).join(truth, "item")
    return j.agg(F.count("*").alias("kept"), F.count_if((F.col("lower") > F.col("count")) | (F.col("upper") < F.col("count"))).alias("outside"), F.max("total").alias("total"))


def fi_build(s, d):
    return Q.frequent_items(_events(s, d), "user_id", ["event_type"], 64).df.select("event_type", "item", "cnt", "offset")


def fi_modes(s, d):
    state = Q.frequent_items(table(s, d, "lineitem"), "l_suppkey", (), 64)
    a = Q.frequent(state, None, True).select("item", "lower", F.lit("no_false_positives").alias("mode"))
    return a.unionByName(Q.frequent(state, None, False).select("item", "lower", F.lit("no_false_negatives").alias("mode")))


def fi_merge(s, d):
    t = _events(s, d)
    m = Q.frequent_items_merge(Q.frequent_items(t.filter("event_id % 2 = 0"), "user_id", (), 64), Q.frequent_items(t.filter("event_id % 2 = 1"), "user_id", (), 64))
    truth = t.groupBy(F.col("user_id").alias("item")).count()
    return m.df.join(truth, "item").agg((F.count("*") <= 64).alias("fits"), F.count_if((F.col("cnt") > F.col("count")) | (F.col("cnt") + F.col("offset") < F.col("count"))).alias("outside"))


def hk_top(s, d):
    return _HK.top(_events(s, d), "user_id").select(F.col("item").alias("user_id"), F.col("estimate").cast("long").alias("estimate"))


def hk_decay(s, d):
    return _HK.decay(_HK.build(_events(s, d), "user_id")).df


def hk_stats(s, d):
    return _HK.stats(_HK.build(_events(s, d), "user_id")).select("cells_used", "total")


def elastic_heavy(s, d):
    return _EL.heavy_hitters(_EL.build(_events(s, d), "user_id"), 60)


def elastic_estimate(s, d):
    """Heavy items are exact; no estimate is below its count."""
    t = _events(s, d)
    truth = t.groupBy("user_id").count()
    return _EL.estimate(_EL.build(t, "user_id"), truth, "user_id").agg(F.count_if(F.col("estimate") < F.col("count")).alias("under"), F.count("*").alias("users"))


def elastic_merge(s, d):
    t = _events(s, d)
    truth = t.groupBy("user_id").count()
    m = _EL.merge(_EL.build(t.filter("event_id % 2 = 0"), "user_id"), _EL.build(t.filter("event_id % 2 = 1"), "user_id"))
    return _EL.estimate(m, truth, "user_id").agg(F.sum(F.when(F.col("estimate") >= 0, 1)).alias("users"))


def salsa(s, d):
    return _SA.estimate(_SA.build(_events(s, d), "user_id"), _users(s, d), "user_id").select("user_id", F.col("estimate").cast("long").alias("estimate"), F.col("confidence").cast("long").alias("confidence"))


def salsa_stats(s, d):
    return _SA.stats(_SA.build(_events(s, d), "user_id"))


def turnstile(s, d):
    return _TS.estimate(_TS.build(_signed(s, d), "user_id", (), "d"), _users(s, d), "user_id").select("user_id", F.col("estimate").cast("long").alias("estimate"))


def turnstile_l2(s, d):
    return _TS.l2(_TS.build(_signed(s, d), "user_id", (), "d")).select(r6("l2"))


def nitro(s, d):
    t = _events(s, d)
    return _NI.query(_NI.build(t, "user_id", "event_id"), _users(s, d), "user_id").select("user_id", "estimate")


def nitro_stats(s, d):
    return _NI.stats(_events(s, d), "event_id")


def built_in_top(s, d):
    """The greatest count by Spark's own summary, which is exact while it holds all its items: users are dealt to shards of about 250."""
    t = _events(s, d)
    shards = -(-t.agg(F.approx_count_distinct("user_id")).first()[0] // 250) or 1
    tops = t.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard")).agg(F.expr("approx_top_k(user_id, 5, 1000)").alias("t"))
    return tops.agg(F.max(F.get("t", F.lit(0))["count"]).alias("greatest"))


def cells_sql(rows: str, x: str, n: str, by: str, q: Q.CountMin, sign: bool = False) -> str:
    b = f"{by}, " if by else ""
    s = f" * (1 - 2 * (({H(3, 'x')} >> r) & 1))" if sign else ""
    return f"select {b}r::INT as row, ((({H(1, 'x')} % {q.width}) + r * ({H(2, 'x')} % {q.width})) % {q.width}) as col, sum(n{s})::BIGINT as cnt from (select {b}{x} as x, {n} as n from {rows} group by {b}{x}), range({q.depth}) t(r) group by all".replace(" as row,", ' as "row",')


def est_sql(cells: str, users: str, x: str, q: Q.CountMin) -> str:
    return f"""select x as {x}, min(greatest(coalesce(cnt, 0), 0)) as estimate from (select x, r::INT as "row", ((({H(1, 'x')} % {q.width}) + r * ({H(2, 'x')} % {q.width})) % {q.width}) as col from ({users}) u(x), range({q.depth}) t(r)) p left join ({cells}) c using ("row", col) group by x"""


_U = "select distinct user_id from events"
_SG = "(select user_id, case event_type when 'purchase' then 1 else -1 end as d from events where event_type in ('purchase', 'error'))"
_med = lambda v: f"(case when count(*) % 2 = 1 then list_sort(list({v}))[(count(*) // 2 + 1)::INT] else trunc((list_sort(list({v}))[(count(*) // 2)::INT] + list_sort(list({v}))[(count(*) // 2 + 1)::INT]) / 2)::BIGINT end)"
_CSC = lambda w: cells_sql(f"(select * from events where {w})", "user_id", "count(*)", "", _CS, True)
_HKC = cells_sql("events", "user_id", "count(*)", "", _HK)
_FI = lambda rows, x, by: f"(select {by}item, cnt, coalesce(max(case when m > 64 then cnt end) over ({'partition by ' + by[:-2] if by else ''}), 0) as off, m from (select {by}{x} as item, cnt, count(*) over ({'partition by ' + by[:-2] if by else ''} order by cnt desc range between unbounded preceding and current row) as m from (select {by}{x}, count(*) as cnt from {rows} group by all)))"

QUERIES = [
    ("f02_cms_cells", cms_cells, cells_sql("events", "user_id", "count(*)", "event_type", _CM)),
    ("f03_cms_estimate", cms_estimate, est_sql(cells_sql("lineitem", "l_partkey", "count(*)", "", _CM), "select p_partkey from part", "l_partkey", _CM)),
    ("f04_cms_merge", cms_merge, cells_sql("events", "user_id", "count(*)", "", _CM)),
    ("f05_conservative_estimate", conservative_estimate, est_sql(cells_sql("events", "user_id", "count(*)", "", _CC), _U, "user_id", _CC)),
    ("f06_conservative_merge", conservative_merge, "select 0::BIGINT as under, count(distinct user_id) as users from events"),
    ("f07_count_sketch_cells", cs_cells, "select * from (" + cells_sql("events", "user_id", "count(*)", "event_type", _CS, True) + ") where cnt <> 0"),
    ("f08_count_sketch_estimate", cs_estimate, f"""select x as user_id, {_med('s * coalesce(cnt, 0)')} as estimate from (select x, r::INT as "row", ((({H(1, 'x')} % {_CS.width}) + r * ({H(2, 'x')} % {_CS.width})) % {_CS.width}) as col, 1 - 2 * (({H(3, 'x')} >> r) & 1) as s from ({_U}) u(x), range({_CS.depth}) t(r)) p left join ({cells_sql(_SG, 'user_id', 'sum(d)', '', _CS, True)}) c using ("row", col) group by x"""),
    ("f09_inner_product", cs_inner, f"""with a as ({_CSC("event_type = 'click'")}), b as ({_CSC("event_type = 'purchase'")}), d as (select "row", sum(a.cnt * b.cnt)::BIGINT as dot from a join b using ("row", col) group by 1) select {_med('dot')} as inner_product from d"""),
    ("f10_count_sketch_merge", cs_merge, "select * from (" + cells_sql("events", "user_id", "count(*)", "", _CS, True) + ") where cnt <> 0"),
    ("f12_space_saving_heavy", ss_heavy, "select l_returnflag, l_suppkey as item, cnt as lower, cnt as upper, total from (select *, sum(cnt) over (partition by l_returnflag)::BIGINT as total, row_number() over (partition by l_returnflag order by cnt desc, l_suppkey) as n from (select l_returnflag, l_suppkey, count(*) as cnt from lineitem group by all)) where n <= 50 and cnt >= ceil(0.01 * total)"),
    ("f11_space_saving_top", ss_top, 'select user_id as item, cnt as upper, rank::INT as rank from (select user_id, count(*) as cnt, row_number() over (order by count(*) desc, user_id) as rank from events group by 1) where rank <= 10'),
    ("f13_space_saving_merge", ss_merge, "select 40::BIGINT as kept, 0::BIGINT as outside, count(*) as total from events"),
    ("f14_frequent_items", fi_build, f"select event_type, item, cnt, off as \"offset\" from {_FI('events', 'user_id', 'event_type, ')} where m <= 64"),
    ("f15_frequent_modes", fi_modes, f"with t as (select * from {_FI('lineitem', 'l_suppkey', '')} where m <= 64) select item, cnt as lower, 'no_false_positives' as mode from t where cnt > off union all select item, cnt, 'no_false_negatives' from t where cnt + off > off"),
    ("f16_frequent_merge", fi_merge, "select true as fits, 0::BIGINT as outside"),
    ("f18_heavy_keeper_top", hk_top, f"with c as (select user_id from events group by 1 order by count(*) desc, user_id limit 10), e as ({est_sql(_HKC, 'select user_id from c', 'user_id', _HK)}) select user_id, estimate from e"),
    ("f19_heavy_keeper_decay", hk_decay, f'select "row", col, floor(cnt / 1.08)::BIGINT as cnt from ({_HKC}) where floor(cnt / 1.08) > 0'),
    ("f17_heavy_keeper_stats", hk_stats, f'select count(*) as cells_used, sum(case when "row" = 0 then cnt end)::BIGINT as total from ({_HKC})'),
    ("f21_elastic_heavy", elastic_heavy, f"select item, cnt from (select user_id as item, cnt, row_number() over (partition by b order by cnt desc, user_id desc) as n from (select user_id, count(*) as cnt, {H(0, 'user_id')} % {_EL.buckets} as b from events group by user_id)) where n = 1 and cnt >= 60"),
    ("f22_elastic_estimate", elastic_estimate, "select 0::BIGINT as under, count(distinct user_id) as users from events"),
    ("f23_elastic_merge", elastic_merge, "select count(distinct user_id) as users from events"),
    ("f24_salsa", salsa, f"with e as ({est_sql(cells_sql('events', 'user_id', 'count(*)', '', _SA), _U, 'user_id', _SA)}) select user_id, estimate, least(100, (select count(*) // 10 from events))::BIGINT as confidence from e"),
    ("f25_salsa_stats", salsa_stats, f'select max(cnt) as max_observed, sum(case when "row" = 0 then cnt end)::BIGINT as total_updates from ({cells_sql("events", "user_id", "count(*)", "", _SA)})'),
    ("f26_turnstile", turnstile, est_sql(cells_sql(_SG, "user_id", "sum(d)", "", _TS), _U, "user_id", _TS)),
    ("f27_l2_norm", turnstile_l2, f'select round(sqrt(list_sort(list(f2))[(count(*) // 2 + 1)::INT]::double), 6) as l2 from (select "row", sum(cnt * cnt) as f2 from ({cells_sql(_SG, "user_id", "sum(d)", "", _TS)}) group by 1)'),
    ("f29_nitro", nitro, f"with e as ({est_sql(cells_sql('(select * from events where ' + H(5, 'event_id') + ' % 10000 < 2500)', 'user_id', 'count(*)', '', _NI.base), _U, 'user_id', _NI.base)}) select user_id, round(estimate / 0.25)::BIGINT as estimate from e"),
    ("f30_nitro_stats", nitro_stats, f"select count(*) filter ({H(5, 'event_id')} % 10000 < 2500) as sampled, count(*) filter ({H(5, 'event_id')} % 10000 >= 2500) as unsampled from events"),
    ("f31_built_in_top", built_in_top, "select max(n) as greatest from (select count(*) as n from events group by user_id)"),
]
