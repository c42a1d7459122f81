"""Named queries of constructors, codecs, merges and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistra.operators import cardinality as C
from gistra.operators import frequency as Q
from gistra.operators import membership as M
from gistra.operators import quantiles as K
from gistra.operators import ranges as R

from gistra.operators import reconcile as X
from gistra.operators.state import State
from gistra.plans import frequency as PF
from gistra.plans import membership as PM
from gistra.plans import similarity as PS
from gistra.plans.cardinality import regs_sql
from gistra.plans.common import H, positions_sql, r6, table
from gistra.plans.streaming import _folder


def ull_build(s, d):
    return C.registers(table(s, d, "events"), "user_id", ["event_type"], precision=10, kind="ull").df


def cpc_build(s, d):
    return C.registers(table(s, d, "orders"), "o_custkey", ["o_orderpriority"], precision=11, kind="cpc").df


def cpc_stats(s, d):
    state = C.registers(table(s, d, "orders"), "o_custkey", ["o_orderpriority"], precision=11, kind="cpc")
    return state.df.groupBy("o_orderpriority").agg(F.count("*").alias("coupons"), F.max("rank").alias("greatest"), (F.count("*") * 5).alias("bytes"))


def qsketch_merge(s, d):
    t = table(s, d, "orders").withColumn("w", F.round("o_totalprice"))
    (a, _), (b, _) = (C.weighted(t.filter(c), "o_custkey", "w") for c in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"))
    return a.merge(b).df.agg(F.count("*").alias("distinct_items"), F.sum("w").cast("long").alias("total_weight"))


def bloom_params(s, d):
    rows = [(n, f, *M.bloom_shape(n, f)) for n in (10, 1000, 1_000_000) for f in (0.1, 0.01, 0.001)]
    return s.createDataFrame(rows, "n long, fpr double, m long, k long")


def bloom_codec(s, d):
    at = _folder(s)
    PM._B.build(PM._orders(s, d), "o_orderkey").save(at)
    return State.load(s, at).df


def counting_merge(s, d):
    t = table(s, d, "events").filter("event_type = 'click'")
    a, b = (PM._CB.build(t.filter(c), "user_id") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return PM._CB.counters(a.merge(b)).select("pos", F.col("counter").cast("long").alias("counter"), "overflow")


def cuckoo_entries(s, d):
    return PM._CK.build(PM._orders(s, d), "o_orderkey").df


def vacuum_entries(s, d):
    return PM._VF.build(PM._orders(s, d), "o_orderkey").df


def stable_merge(s, d):
    t = table(s, d, "events")
    a, b = (PM._SB.build(t.filter(c), "user_id", "event_id") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return a.merge(b).df


def fuse_build(s, d):
    f = M.BinaryFuse(10_000)
    return f.build(PM._orders(s, d), "o_orderkey").agg(F.sum("n").alias("items"), (F.min("n") > 0).alias("solved"))


def ribbon_stats(s, d):
    return M.Ribbon(PM.N).insert(PM._orders(s, d), "o_orderkey").finalize().stats().select("bits", r6("false_positive_rate"))


def learned_train(s, d):
    _, backup = PM._LB.train(table(s, d, "customer").filter("c_custkey % 2 = 0"), "c_name")
    return PM._LB.backup.stats(backup).select((F.col("bits") > 0).alias("has_backup"))


def learned_stats(s, d):
    """True accuracy: the share of probes judged rightly, from the data."""
    t = table(s, d, "customer")
    model = PM._LB.train(t.filter("c_custkey % 2 = 0"), "c_name")
    got = PM._LB.contains(model, t, "c_name")
    return got.select((F.avg((F.col("maybe") == (F.col("c_custkey") % 2 == 0)).cast("double")) >= 0.5).alias("better_than_chance"))


def heavy_keeper_merge(s, d):
    t = table(s, d, "events")
    a, b = (PF._HK.build(t.filter(c), "user_id") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return PF._HK.top(t, "user_id", a.merge(b)).select(F.col("item").alias("user_id"), F.col("estimate").cast("long").alias("estimate"))


def turnstile_merge(s, d):
    t = PF._signed(s, d)
    a, b = (PF._TS.build(t.filter(c), "user_id", (), "d") for c in ("user_id % 2 = 0", "user_id % 2 = 1"))
    return a.merge(b).df.filter("cnt <> 0")


def cms_params(s, d):
    rows = [(e, dl, q.width, q.depth) for e in (0.1, 0.01, 0.001) for dl in (0.1, 0.01) for q in (Q.CountMin(e, dl),)]
    return s.createDataFrame(rows, "epsilon double, delta double, width long, depth long")


def kll_count(s, d):
    k = K.Kll(200)
    return k.count(k.build(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), ["l_returnflag"])


def histogram_expire(s, d):
    state = PS._EH.build(PS._ts(s, d), "t", ["event_type"])
    return PS._EH.expire(state, PS._NOW + 20 * PS.DAY).df.groupBy("event_type").agg(F.count("*").alias("buckets"), F.sum("cnt").alias("cnt"))


def sliding_hll_stats(s, d):
    return PS._SL.build(PS._ts(s, d), "user_id", "t").df.agg(F.count("*").alias("entries"), F.countDistinct("idx").alias("registers"), F.max("rank").alias("greatest"), F.max("ts").alias("latest"))


def grafite_build(s, d):
    return PS._GF.build(PS._keys(s, d), "key")


def grf_gaps(s, d):
    return PS._GR.segments(PS._keys(s, d), "key").select((F.col("high") - F.col("low")).alias("width"), "keys").groupBy("width", "keys").count()


def iblt_insert_delete(s, d):
    a, _ = PS._sides(s, d)
    gone = a.filter("c_custkey % 2 = 0")
    state = PS._IB.build(a, "w").merge(PS._IB.build(gone, "w", -1))
    return state.df.filter("cnt <> 0 or word <> 0").select("cell", "cnt", "word")


def iblt_stats(s, d):
    return s.createDataFrame([(k, v) for k, v in X.Iblt(600).stats().items()], "name string, value long")


def univmon_stats(s, d):
    cells, heavy = PS._UM.build(table(s, d, "events"), "user_id")
    del cells
    return heavy.df.groupBy("layer").agg(F.count("*").alias("items"), F.sum("cnt").alias("cnt"))


def memento_expansions(s, d):
    """How often the covered range grew while keys arrived in the order of their rows."""
    from pyspark.sql.window import Window

    t = table(s, d, "orders").select((F.col("o_custkey") * 7919 % 1000).alias("k"), "o_orderkey").filter("o_orderkey < 2000")
    w = Window.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)  # under 2,000 rows
    grew = (F.col("k") < F.min("k").over(w)) | (F.col("k") > F.max("k").over(w))
    return t.select(grew.alias("g")).agg(F.count_if("g").alias("expansions"))


def memento_expansions_whole(s, d):
    """Over all orders, with keys spread so widely that the range grows for long."""
    return R.Memento.expansions(table(s, d, "orders").withColumn("k", F.col("o_custkey") * 7919 % 1_000_003), "k", "o_orderkey")


_entry = lambda f: f"(select least(h % {f.buckets}, xor(h % {f.buckets}, ({H(3, '((h >> ' + str(60 - f.fp_bits) + ') | 1)')}) % {f.buckets})) as bucket, (h >> {60 - f.fp_bits}) | 1 as fp from (select {H(0, 'o_orderkey')} as h from {PM._F}))"
_RBITS = PM.bits_sql(PM._F, "o_orderkey", PM._RB)

QUERIES = [
    ("c08_ull_build", ull_build, regs_sql("events", "event_type", "user_id", 10)),
    ("c11_cpc_build", cpc_build, regs_sql("orders", "o_orderpriority", "o_custkey", 11)),
    ("c13_cpc_stats", cpc_stats, f"select o_orderpriority, count(*) as coupons, max(rank)::INT as greatest, count(*) * 5 as bytes from ({regs_sql('orders', 'o_orderpriority', 'o_custkey', 11)}) group by 1"),
    ("c24_qsketch_merge", qsketch_merge, "select count(distinct o_custkey) as distinct_items, sum(round(o_totalprice))::BIGINT as total_weight from orders"),
    ("m01_bloom_params", bloom_params, "select n::BIGINT as n, f as fpr, ceil(-n * ln(f) / (ln(2) * ln(2)))::BIGINT as m, greatest(1, ceil(ceil(-n * ln(f) / (ln(2) * ln(2))) / n * ln(2)))::BIGINT as k from (select unnest([10, 1000, 1000000]) as n), (select unnest([0.1::double, 0.01, 0.001]) as f)"),
    ("m06_bloom_codec", bloom_codec, PM.bits_sql(PM._F, "o_orderkey", PM._B)),
    ("m12_counting_merge", counting_merge, f"select pos, least(greatest(cnt, 0), 15) as counter, cnt > 15 as overflow from {PM._CNT}"),
    ("m13_cuckoo_entries", cuckoo_entries, f"select bucket, fp, count(*) as cnt from {_entry(PM._CK)} group by all"),
    ("m24_vacuum_entries", vacuum_entries, f"select bucket, fp, count(*) as cnt from {_entry(PM._VF)} group by all"),
    ("m18_stable_merge", stable_merge, f"select pos, max(l)::BIGINT as last from (select l, unnest({positions_sql('user_id', PM._SB.k, PM._SB.m)}) as pos from (select user_id, max(event_id) as l from events group by 1)) group by 1"),
    ("m19_fuse_build", fuse_build, "select count(distinct o_orderkey) as items, true as solved from orders where o_orderstatus = 'F'"),
    ("m23_ribbon_stats", ribbon_stats, f"select count(*) as bits, round(pow(count(*) / {float(PM._RB.m)}, 2), 6) as false_positive_rate from ({_RBITS})"),
    ("m27_learned_train", learned_train, "select true as has_backup"),
    ("m29_learned_stats", learned_stats, "select true as better_than_chance"),
    ("f01_cms_params", cms_params, "select e as epsilon, d as delta, pow(2, ceil(log2(2 / e)))::BIGINT as width, greatest(1, ceil(ln(1 / d)))::BIGINT as depth from (select unnest([0.1::double, 0.01, 0.001]) as e), (select unnest([0.1::double, 0.01]) as d)"),
    ("f20_heavy_keeper_merge", heavy_keeper_merge, f"with c as (select user_id from events group by 1 order by count(*) desc, user_id limit 10), e as ({PF.est_sql(PF._HKC, 'select user_id from c', 'user_id', PF._HK)}) select user_id, estimate from e"),
    ("f28_turnstile_merge", turnstile_merge, f"select * from ({PF.cells_sql(PF._SG, 'user_id', 'sum(d)', '', PF._TS)}) where cnt <> 0"),
    ("q06_kll_count", kll_count, "select l_returnflag, count(*) as n from lineitem group by 1"),
    ("t04_histogram_expire", histogram_expire, f"with g as (select event_type, t // {PS._EH.granule} as g, count(*) as cnt, max(t) as l from {PS._E} group by all) select event_type, count(*) as buckets, sum(cnt)::BIGINT as cnt from g where l >= {PS._NOW + 20 * PS.DAY - 7 * PS.DAY} group by 1"),
    ("t11_sliding_hll_stats", sliding_hll_stats, f"select count(*) as entries, count(distinct idx) as registers, max(rank)::INT as greatest, max(ts) as latest from ({PS._SLR(PS._E)})"),
    ("r01_grafite_build", grafite_build, f"select key from {PS._KEYS}"),
    ("r04_grf_gaps", grf_gaps, f"select high - low as width, keys, count(*) as count from {PS._SEG} group by all"),
    ("r07_memento_expansions", memento_expansions, "select count(*) filter (k < lo or k > hi) as expansions from (select k, min(k) over w as lo, max(k) over w as hi from (select o_custkey * 7919 % 1000 as k, o_orderkey from orders where o_orderkey < 2000) window w as (order by o_orderkey rows between unbounded preceding and 1 preceding))"),
    ("r07_memento_expansions_whole", memento_expansions_whole, "select count(*) filter (k < lo or k > hi) as expansions from (select k, min(k) over w as lo, max(k) over w as hi from (select o_custkey * 7919 % 1000003 as k, o_orderkey from orders) window w as (order by o_orderkey, k rows between unbounded preceding and 1 preceding))"),
    ("x02_iblt_insert_delete", iblt_insert_delete, f"select * from (select cell, count(*) as cnt, bit_xor(w) as word from (select w, j * {PS._IB.third} + {H(7, chr(39) + chr(39) + '||w||' + chr(39) + '/' + chr(39) + '||j')} % {PS._IB.third} as cell from (select {PS._IW} as w from customer where c_custkey % 97 <> 3 and c_custkey % 2 = 1), range(3) t(j)) group by 1) where cnt <> 0 or word <> 0"),
    ("x01_iblt_stats", iblt_stats, "select 'num_cells' as name, 1200::BIGINT as value union all select 'hashes', 3 union all select 'cell_bytes', 24"),
    ("u08_univmon_stats", univmon_stats, f"select layer, count(*) as items, sum(cnt)::BIGINT as cnt from (select *, row_number() over (partition by layer order by cnt desc, item) as n from {PS._LAY('events', 'user_id', '1')}) where n <= greatest(10, floor(1000 / (layer + 1))) group by 1"),
]
