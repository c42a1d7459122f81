"""Operators and queries that take whole tables."""

import random

import duckdb
import pytest

from gistra import catalog
from gistra.operators import ranges as R
from gistra.operators import similarity as S
from test_queries import TABLES, rows


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def same(spark, data, duck, name):
    got, want = catalog.queries()[name](spark, data).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert len(got) and rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_similar_sets_are_those_of_all_pairs(spark):
    """Bands shared with a lesser, dissimilar set hide no pair."""
    rng = random.Random(2)
    sets = {k: {f"i{rng.randrange(14)}" for _ in range(rng.randint(1, 9))} for k in range(60)}
    m = S.MinHash(16)
    state = m.build(spark.createDataFrame([(k, x) for k, v in sets.items() for x in sorted(v)], "k long, x string"), "x", ["k"])
    sig = {r.k: tuple(r.signature) for r in m.signatures(state).collect()}
    least = {}
    for k in sorted(sig):
        least.setdefault(sig[k], k)
    want = {(least[s], k, 1.0) for k, s in sig.items() if least[s] < k}
    for s, a in least.items():
        for t, b in least.items():
            share = sum(p == q for p, q in zip(s, t)) / 16
            if a < b and share >= 0.6 and any(s[i : i + 2] == t[i : i + 2] for i in range(0, 16, 2)):
                want.add((a, b, share))
    got = [(r.a, r.b, r.jaccard) for r in m.similar(state, 0.6, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_documents(spark, data, duck):
    same(spark, data, duck, "s02_similar_documents")
    same(spark, data, duck, "s02_similar_sets")


@pytest.mark.parametrize("block", [100_000, 40])
def test_expansions_of_all_rows(spark, block):
    rng = random.Random(6)
    kept = [(rng.randrange(-9, 9) * n + rng.randrange(50), n) for n in range(500)] + [(None, 3), (7, None)]
    low = high = None
    want = 0
    for k, _ in kept[:500]:
        want += low is not None and (k < low or k > high)
        low, high = (k, k) if low is None else (min(low, k), max(high, k))
    rng.shuffle(kept)
    got = R.Memento.expansions(spark.createDataFrame(kept, "k long, n long"), "k", "n", block).first().expansions
    assert got == want


def test_expansions_query(spark, data, duck):
    same(spark, data, duck, "r07_memento_expansions_whole")


WHOLE = [n for n in catalog.queries() if n[0] == "r" and n.endswith("_whole") and n != "r07_memento_expansions_whole"]


def test_range_queries_take_all_keys(spark, data, duck):
    """Keys and probes grow with the orders and cover their whole range."""
    assert {n[:3] for n in WHOLE} == {"r01", "r02", "r03", "r04", "r05", "r06", "r08"}
    for name in WHOLE:
        same(spark, data, duck, name)
    (n,) = duck.execute("select count(distinct o_orderkey) from orders").fetchone()
    hits = catalog.queries()["r02_grafite_range_whole"](spark, data).groupBy("hit").count().collect()
    assert sum(r["count"] for r in hits) == n and len(hits) == 2


def test_every_twin_is_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
