"""Results that must not change as tables grow: tables larger than a summary, a filter or a block of keys."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gistra import catalog
from gistra.operators import membership as M
from gistra.operators import quantiles as K
from gistra.operators import ranges as R
from gistra.operators import reconcile as X
from gistra.operators import similarity as S
from gistra.operators import windows as W
from gistra.streaming import dgim
from test_queries import rows


@pytest.fixture
def same(spark, tmp_path):
    """Writes a table and holds queries against their SQL on it."""

    def check(table, sql, *names):
        duckdb.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
        c = duckdb.connect()
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        for name in names:
            got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
            assert len(got) and rows(got, sorted(got.columns)) == rows(want, sorted(want.columns)), name

    return check


def test_greatest_count_among_more_users_than_the_summary_holds(same):
    same("events", "select i as event_id, case when i < 9 then 7 else i % 6000 end as user_id from range(12000) t(i)", "f31_built_in_top")


def test_difference_larger_than_one_table_of_cells(same):
    same("customer", "select i as c_custkey, 'c' || i as c_name, i % 25 as c_nationkey from range(70000) t(i)", "x04_iblt_decode")


def test_difference_of_sets(spark, tmp_path):
    a, b = spark.range(0, 900).selectExpr("id as w"), spark.range(60, 930).selectExpr("id as w")
    got = {tuple(r) for r in X.Iblt(5).difference(a.union(a), b, "w", str(tmp_path)).collect()}
    assert got == {("insert", k) for k in range(60)} | {("remove", k) for k in range(900, 930)}
    assert not X.Iblt(5).difference(a, a, "w", str(tmp_path / "none")).collect()


def test_fuse_shards_follow_the_number_of_items(spark, monkeypatch):
    monkeypatch.setattr(M.BinaryFuse, "SHARD", 500)
    f = M.BinaryFuse(400)
    built = f.build(spark.range(4000), "id")
    assert built.agg({"n": "max"}).first()[0] < 700 and f.stats(built).first().items == 4000
    got = f.contains(built, spark.range(8000), "id").collect()
    assert all(r.maybe for r in got if r.id < 4000) and sum(r.maybe for r in got) < 4000 + 0.025 * 4000


def test_statistics_of_a_full_filter(same):
    same("orders", "select i as o_orderkey, 'F' as o_orderstatus from range(420000) t(i)", "m04_bloom_stats")


@pytest.mark.parametrize("block", [100_000, 7])
def test_segments_do_not_depend_on_zones(spark, monkeypatch, same, block):
    monkeypatch.setattr(R.Grf, "BLOCK", block)
    names = ["r04_grf_segments_whole", "r04_grf_gaps_whole", "r06_grf_stats_whole"]
    same("orders", "select (i + 1000 * (i // 90) + i // 5 * (i % 2))::BIGINT as o_orderkey, 'F' as o_orderstatus from range(700) t(i)", *names)


def test_segments_of_all_keys_of_a_large_table(same):
    names = ["r04_grf_segments", "r04_grf_gaps", "r06_grf_stats"]
    same("lineitem", "select i * 3 // 2 + i // 7000 * 97 as l_orderkey, 50.0 as l_quantity from range(250000) t(i)", *names)


def test_merged_monitors_of_more_items_than_a_layer_keeps(same):
    same("events", "select i as event_id, i * i % 2617 * 7 % 1500 as user_id from range(9000) t(i)", "u09_univmon_merge")


def test_sliding_counts_of_a_stream_in_no_order(same):
    """Rows of a key come in several chunks, times repeat and are in no order."""
    same("events", "select i as event_id, 'ab'[1 + i % 2] as event_type, timestamp '2024-01-01' + interval (i * 7919 % 50021 * 4) second as ts from range(50000) t(i)", "t05_stream_sliding_count")


def test_bounds_hold_for_late_arrivals():
    rng, buckets, seen = random.Random(4), [], []
    for t in range(1, 1500):
        at = t - rng.choice([0, 0, rng.randrange(400)])
        buckets = dgim.add(buckets, at, 5)
        seen.append(at)
    for start in range(200, 1500, 50):
        _, low, high = dgim.count(buckets, start)
        assert low <= sum(x >= start for x in seen) <= high


def test_sliding_counts_by_a_running_sum(spark):
    """As counted row by row; no frame moves, as its cost a row grows with the rows in the window."""
    rng = random.Random(5)
    kept = [("xy"[rng.randrange(2)], rng.randrange(-300, 2000), k) for k in range(600)]
    df = spark.createDataFrame(kept, "g string, t long, k long")
    for by, parts in ((["g"], 1), ([], 1), ([], 7)):
        got = W.sliding_counts(df, "t", 40, by, parts)
        assert got.columns == ["g", "t", "k", "in_window"]
        assert {r.k: r.in_window for r in got.collect()} == {k: sum(t - 40 <= u <= t and (not by or h == g) for h, u, _ in kept) for g, t, k in kept}
        assert "unboundedpreceding" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "-40" not in plan


def test_built_in_summaries_are_not_kept_per_item(spark, data):
    plan = catalog.queries()["c24_built_in_distinct"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "sketch" in x and "l_partkey" in x.split("functions=")[0]]


def _nodes(plan, name):
    return [x for x in plan.splitlines() if name in x]


def test_slots_are_computed_within_their_aggregate(spark):
    """Sixty columns below an aggregate make its code too long to be compiled."""
    words = spark.range(50).selectExpr("id % 3 as g", "cast(id as string) as x")
    for state in (S.SimHash().build(words, "x", ["g"]), S.MinHash(32).build(words, "x", ["g"])):
        plan = state.df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in _nodes(plan, "Project") if x.count(" AS ") > 8]


def test_signatures_are_computed_once(spark, data):
    df = catalog.queries()["s02_similar_documents"](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(_nodes(plan, "Scan parquet")) == 1


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_near_fingerprints_are_those_of_all_pairs(spark, distance):
    rng = random.Random(distance)
    prints = [rng.getrandbits(60) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(5))) for p in prints for _ in range(4)]
    least = {p: prints.index(p) for p in prints}
    want = {tuple(sorted((least[p], least[q]))) + (n,) for p in least for q in least if p < q and (n := (p ^ q).bit_count()) <= distance}
    df = spark.createDataFrame(list(enumerate(prints)), "doc long, fingerprint long")
    got = [tuple(r) for r in S.SimHash().near(df, "doc", distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_fingerprints_are_dealt_by_number(spark):
    """By their few bytes all would be joined in one task."""
    df = spark.range(50).selectExpr("id", "xxhash64(id) & ((1L << 60) - 1) as fingerprint")
    assert "REPARTITION_BY_NUM" in S.SimHash().near(df, "id", 3)._jdf.queryExecution().executedPlan().toString()


def test_running_weights_by_zones(spark):
    """Ranks over values of all signs, equal ones, groups and a null group; no task orders a whole group."""
    rng = random.Random(8)
    kept = [(rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1e-300, -7.5, 3.25, 1e300, rng.uniform(-9, 9), rng.uniform(900, 905)])) for _ in range(900)]
    df = spark.createDataFrame(kept, "g string, v double")
    got = {(r.g, r.value): r.cdf for r in K.exact_cdf(df, "v", ["g"]).collect()}
    groups = {g: [v for h, v in kept if h == g] for g, _ in kept}
    assert got.keys() == {(g, v) for g, v in kept}
    assert all(abs(cdf - sum(u <= v for u in groups[g]) / len(groups[g])) < 1e-12 for (g, v), cdf in got.items())
    assert not K.exact_cdf(df.filter("v > 1e308"), "v").collect() and len(K.exact_cdf(df, "v").collect()) == len({v for _, v in kept})
    for state in (K.TDigest(50).build(df, "v", ["g"]), K.Spline(20).build(df, "v", ["g"])):
        windows = _nodes(state.df._jdf.queryExecution().optimizedPlan().toString(), "Window")
        assert any("__zone" in x for x in windows)
        assert {r.g: r.w for r in state.df.groupBy("g").agg(F.sum("weight" if "weight" in state.df.columns else "w").alias("w")).collect()} == {g: len(v) for g, v in groups.items()}


def test_fingerprints_take_one_shuffle(spark):
    words = spark.range(50).selectExpr("id % 3 as g", "cast(id % 7 as string) as x")
    plan = S.SimHash().build(words, "x", ["g"]).df._jdf.queryExecution().executedPlan().toString()
    assert len(_nodes(plan, "Exchange")) == 1
