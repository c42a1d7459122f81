"""Every named query with an SQL twin gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from gistra import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Not constant at the smallest scale: published for larger tables only.
SKIP = {"f13_space_saving_merge", "m14_cuckoo_contains", "m20_fuse_contains", "m25_vacuum_contains", "t12_stream_sessions"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


NAMES = [n for n in catalog.oracle_sql() if n not in SKIP]
#: One in three in a usual run, all with GISTRA_ALL=1: the driver compares all of them anyway.
PICKED = NAMES if os.environ.get("GISTRA_ALL") else NAMES[::3]


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_twin(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_twin_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
