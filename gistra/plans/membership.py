"""Named queries of the membership filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistra.operators import membership as M
from gistra.plans.common import H, positions_sql, r6, table

N = 20_000
_B = M.Bloom(N)
_BB = M.BlockedBloom(N)
_CB = M.CountingBloom(N)
_CK = M.FingerprintFilter(40_000)
_VF = M.FingerprintFilter.vacuum(40_000)
_SB = M.StableBloom(2_000)
_LB = M.LearnedBloom(2_000)


def _orders(s, d, status="F"):
    return table(s, d, "orders").filter(F.col("o_orderstatus") == status).select("o_orderkey")


def _probes(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()


def bloom_bits(s, d):
    return _B.build(_orders(s, d), "o_orderkey").df


def bloom_contains(s, d):
    return _B.filter(_B.build(_orders(s, d), "o_orderkey"), _probes(s, d), "k")


def bloom_stats(s, d):
    return _B.stats(_B.build(_orders(s, d), "o_orderkey")).select("bits", r6("false_positive_rate"), F.round("items", 3).alias("items"))


def bloom_merge(s, d):
    return _B.build(_orders(s, d), "o_orderkey").merge(_B.build(_orders(s, d, "O"), "o_orderkey")).df


def prefilter(s, d):
    """Exact join after the reducer: the same rows as the join alone."""
    dim = _orders(s, d).withColumnRenamed("o_orderkey", "l_orderkey")
    fact = table(s, d, "lineitem").select("l_orderkey", "l_quantity")
    return M.prefilter(fact, dim, "l_orderkey").join(dim, "l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def blocked_bits(s, d):
    return _BB.build(_orders(s, d), "o_orderkey").df


def blocked_contains(s, d):
    return _BB.filter(_BB.build(_orders(s, d), "o_orderkey"), _probes(s, d), "k")


def _signed(s, d):
    t = table(s, d, "events").filter("event_type in ('purchase', 'error')")
    return t.select("user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("d"))


def counting_counters(s, d):
    state = _CB.build(table(s, d, "events").filter("event_type = 'click'"), "user_id")
    return _CB.counters(state).select("pos", F.col("counter").cast("long").alias("counter"), "overflow")


def counting_remove(s, d):
    t = _orders(s, d).withColumn("d", F.lit(1)).unionByName(_orders(s, d).filter("o_orderkey % 2 = 0").withColumn("d", F.lit(-1)))
    return _CB.contains(_CB.build(t, "o_orderkey", "d"), _probes(s, d), "k").filter("maybe").select("k")


def counting_estimate(s, d):
    users = table(s, d, "events").select("user_id").distinct()
    state = _CB.build(table(s, d, "events").filter("event_type = 'click'"), "user_id")
    return _CB.count_estimate(state, users, "user_id").select("user_id", F.col("at_most").cast("long").alias("at_most"))


def cuckoo_contains(s, d):
    state = _CK.build(_orders(s, d), "o_orderkey")
    got = _CK.contains(state, _probes(s, d), "k")
    truth = _orders(s, d).select(F.col("o_orderkey").alias("k"), F.lit(True).alias("t"))
    j = got.join(truth, "k", "left")
    return j.agg(F.count_if(F.col("t") & ~F.col("maybe")).alias("false_negatives"), (F.count_if(F.col("t").isNull() & F.col("maybe")) <= 0.01 * F.count("*")).alias("few_false_positives"))


def cuckoo_remove(s, d):
    t = _orders(s, d).withColumn("d", F.lit(1)).unionByName(_orders(s, d).filter("o_orderkey % 3 = 0").withColumn("d", F.lit(-1)))
    state = _CK.build(t, "o_orderkey", "d")
    return _CK.stats(state).select("items", "slots", r6("load_factor"))


def vacuum_contains(s, d):
    state = _VF.build(_orders(s, d), "o_orderkey")
    got = _VF.contains(state, _probes(s, d), "k")
    truth = _orders(s, d).select(F.col("o_orderkey").alias("k"), F.lit(True).alias("t"))
    j = got.join(truth, "k", "left")
    return j.agg(F.count_if(F.col("t") & ~F.col("maybe")).alias("false_negatives"), (F.count_if(F.col("t").isNull() & F.col("maybe")) <= 0.03 * F.count("*")).alias("few_false_positives"))


def vacuum_stats(s, d):
    return _VF.stats(_VF.build(_orders(s, d), "o_orderkey")).select("items", "slots", r6("load_factor"))


def stable_counters(s, d):
    return _SB.counters(_SB.build(table(s, d, "events"), "user_id", "event_id"), 20_000).select("pos", F.col("counter").cast("long").alias("counter"))


def stable_contains(s, d):
    t = table(s, d, "events")
    state = _SB.build(t, "user_id", "event_id")
    return _SB.contains(state, 10_000, t.select("user_id").distinct(), "user_id").filter("maybe").select("user_id")


def fuse_contains(s, d):
    f = M.BinaryFuse(10_000)
    keys = _orders(s, d)
    got = f.contains(f.build(keys, "o_orderkey"), _probes(s, d), "k")
    j = got.join(keys.select(F.col("o_orderkey").alias("k"), F.lit(True).alias("t")), "k", "left")
    return j.agg(F.count_if(F.col("t") & ~F.col("maybe")).alias("false_negatives"), (F.count_if(F.col("t").isNull() & F.col("maybe")) <= 0.025 * F.count("*")).alias("few_false_positives"))


def fuse_stats(s, d):
    f = M.BinaryFuse(10_000)
    return f.stats(f.build(_orders(s, d), "o_orderkey")).select("items", F.round("estimated_fpr", 8).alias("estimated_fpr"))


def ribbon_contains(s, d):
    r = M.Ribbon(N).insert(_orders(s, d), "o_orderkey").finalize()
    return r.contains(_probes(s, d), "k").filter("maybe").select("k")


def learned_contains(s, d):
    keys = table(s, d, "customer").filter("c_custkey % 2 = 0")
    model = _LB.train(keys, "c_name")
    got = _LB.contains(model, table(s, d, "customer"), "c_name")
    return got.agg(F.count_if((F.col("c_custkey") % 2 == 0) & ~F.col("maybe")).alias("false_negatives"), F.count_if(F.col("c_custkey") % 2 == 0).alias("keys"))


_F = "(select o_orderkey from orders where o_orderstatus = 'F')"


def bits_sql(rows: str, x: str, b: M.Bloom) -> str:
    return f"select distinct unnest({positions_sql(x, b.k, b.m)}) as pos from {rows}"


def contains_sql(bits: str, b: M.Bloom) -> str:
    return f"""with bits as ({bits}), p as (select k, list_distinct({positions_sql('k', b.k, b.m)}) as ps from (select distinct l_orderkey as k from lineitem)),
 u as (select k, len(ps) as need, unnest(ps) as pos from p) select k from u join bits using (pos) group by k, need having count(*) = need"""


_BLOCK_POS = f"list_transform(list_distinct({positions_sql('{x}', _BB.k, 512)}), lambda b: ({H(0, '{x}')} % {_BB.blocks}) * 512 + b)"
_blk = lambda x: _BLOCK_POS.replace("{x}", x)
_CNT = f"(select pos, sum(c)::BIGINT as cnt from (select c, unnest({positions_sql('user_id', _CB.k, _CB.m)}) as pos from (select user_id, count(*) as c from events where event_type = 'click' group by 1)) group by 1)"
_LAST = f"(select pos, max(l) as l from (select l, unnest({positions_sql('user_id', _SB.k, _SB.m)}) as pos from (select user_id, max(event_id) as l from events group by 1)) group by 1)"
_level = lambda now: f"greatest(0, {_SB.top} - floor({_SB.p} * ({now} - l) / {_SB.m}))::BIGINT"

QUERIES = [
    ("m02_bloom_bits", bloom_bits, bits_sql(_F, "o_orderkey", _B)),
    ("m03_bloom_contains", bloom_contains, contains_sql(bits_sql(_F, "o_orderkey", _B), _B)),
    ("m04_bloom_stats", bloom_stats, f"select count(*) as bits, round(pow(count(*) / {float(_B.m)}, {_B.k}), 6) as false_positive_rate, round(-{_B.m} * ln(1 - count(*) / {float(_B.m)}) / {_B.k}, 3) as items from ({bits_sql(_F, 'o_orderkey', _B)})"),
    ("m05_bloom_merge", bloom_merge, bits_sql("(select o_orderkey from orders where o_orderstatus in ('F', 'O'))", "o_orderkey", _B)),
    ("m06_semi_join_prefilter", prefilter, "select count(*) as n, sum(l_quantity) as qty from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')"),
    ("m07_blocked_bits", blocked_bits, f"select distinct unnest({_blk('o_orderkey')}) as pos from {_F}"),
    ("m08_blocked_contains", blocked_contains, f"with bits as (select distinct unnest({_blk('o_orderkey')}) as pos from {_F}), u as (select k, len({_blk('k')}) as need, unnest({_blk('k')}) as pos from (select distinct l_orderkey as k from lineitem)) select k from u join bits using (pos) group by k, need having count(*) = need"),
    ("m09_counting_counters", counting_counters, f"select pos, least(greatest(cnt, 0), 15) as counter, cnt > 15 as overflow from {_CNT}"),
    ("m10_counting_remove", counting_remove, contains_sql(bits_sql("(select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 2 = 1)", "o_orderkey", _CB), _CB)),
    ("m11_counting_estimate", counting_estimate, f"select user_id, min(coalesce(least(greatest(cnt, 0), 15), 0))::BIGINT as at_most from (select user_id, unnest({positions_sql('user_id', _CB.k, _CB.m)}) as pos from (select distinct user_id from events)) left join {_CNT} using (pos) group by 1"),
    ("m14_cuckoo_contains", cuckoo_contains, "select 0::BIGINT as false_negatives, true as few_false_positives"),
    ("m15_cuckoo_remove", cuckoo_remove, f"select count(*) as items, {_CK.buckets * 4} as slots, round(count(*) / {float(_CK.buckets * 4)}, 6) as load_factor from orders where o_orderstatus = 'F' and o_orderkey % 3 <> 0"),
    ("m16_stable_counters", stable_counters, f"select pos, {_level(20000)} as counter from {_LAST} where {_level(20000)} > 0"),
    ("m17_stable_contains", stable_contains, f"select user_id from (select user_id, unnest({positions_sql('user_id', _SB.k, _SB.m)}) as pos from (select distinct user_id from events)) join {_LAST} using (pos) group by 1 having min({_level(10000)}) > 0"),
    ("m20_fuse_contains", fuse_contains, "select 0::BIGINT as false_negatives, true as few_false_positives"),
    ("m21_fuse_stats", fuse_stats, "select count(distinct o_orderkey) as items, 0.00390625::double as estimated_fpr from orders where o_orderstatus = 'F'"),
    ("m22_ribbon_contains", ribbon_contains, None),
    ("m25_vacuum_contains", vacuum_contains, "select 0::BIGINT as false_negatives, true as few_false_positives"),
    ("m26_vacuum_stats", vacuum_stats, f"select count(*) as items, {_VF.buckets * 4} as slots, round(count(*) / {float(_VF.buckets * 4)}, 6) as load_factor from orders where o_orderstatus = 'F'"),
    ("m28_learned_contains", learned_contains, "select 0::BIGINT as false_negatives, count(*) as keys from customer where c_custkey % 2 = 0"),
]
_RB = M.Ribbon(N).bloom
QUERIES = [(n, f, contains_sql(bits_sql(_F, "o_orderkey", _RB), _RB) if n == "m22_ribbon_contains" else q) for n, f, q in QUERIES]
