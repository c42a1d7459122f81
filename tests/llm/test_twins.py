"""SQL twins of the corpus operators against the queries, also on tables with planted cases."""

import random

import duckdb
import pytest

from gistra.llm import registry, secrets, urls

DATA = "/root/testdata/sf0.001"


def same(spark, query, sql, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if str(folder) == DATA else '/*.parquet'}'")
    got, want = query(spark, str(folder)).toPandas(), c.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    return got


def test_every_twin_is_text():
    import __spark_entry__ as entry

    twins = entry.oracle_sql()
    assert set(twins) <= set(entry.queries())
    assert all(isinstance(s, str) and s.split()[0].lower() in ("select", "with") for s in twins.values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], DATA, ["documents", "pages", "labels"])


def test_linked_secrets_equal_the_twin(spark, tmp_path):
    """Keys and endpoints near and far from what completes them, in all orders."""
    rng = random.Random(3)
    chars = "ABCDEFGHIJabcdefghij0123456789+/"
    parts = [
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGH234567", k=16)),
        lambda: "aZ9" + "".join(rng.choices(chars, k=37)),
        lambda: "https://svc%d.example.org/v1" % rng.randrange(99),
        lambda: "Api_Key = '%s'" % "".join(rng.choices("abcdef123", k=rng.randrange(4, 12))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randrange(20, 34))),
        lambda: "é" * rng.randrange(380),
        lambda: "word " * rng.randrange(120),
        lambda: "postgres://a:b@h/db",
    ]
    rows = [(d, " ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 9)))) for d in range(400)] + [(400, None), (401, "")]
    rows += rows[:40]
    spark.createDataFrame(rows, "doc_id long, text string").distinct().write.parquet(str(tmp_path / "documents.parquet"))
    got = same(spark, secrets.op8_secret_scans, secrets.OP8_SQL, tmp_path, ["documents"])
    linked = got.spans.str.count("key:|endpoint:").sum()
    alone = sum(len(t.split("://")) - 1 for _, t in rows[:400] if t)
    assert 50 < linked < alone + 400


def test_linked_secrets_by_a_joined_table(spark, monkeypatch):
    rows = [(1, "aZ9" + "x" * 37 + " AKIA" + "Q" * 16), (2, "aZ9" + "x" * 37), (3, "plain"), (3, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda: sorted((r.doc_id, [s.kind for s in r.spans]) for r in secrets.scan(docs).collect())
    few = told()
    monkeypatch.setattr(secrets, "TOLD", 0)
    assert told() == few == [(1, ["key", "access"]), (2, []), (3, []), (3, [])]


def test_planted_hosts_equal_the_twin(spark, tmp_path):
    """Hosts with bad pages are blocked, also for pages without a label; domains lend to their hosts."""
    rng = random.Random(2)
    pages, labels = [], []
    for p in range(1500):
        bad = p % 3 == 0
        host = f"h{rng.randrange(6)}.bad{rng.randrange(4)}.info" if bad else f"h{rng.randrange(6)}.good{rng.randrange(9)}.info"
        pages.append((p, f"http://{host}/x/{p}"))
        if p % 4:
            labels.append((p, int(rng.random() < (0.05 if bad else 0.9))))
    pages += [(2000, None), (2001, "no scheme"), (2002, "http://h9.bad1.info/"), (2003, "http://new.example/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = same(spark, urls.op9_url_filters, urls.OP9_SQL, tmp_path, ["pages", "labels"])
    verdict = dict(zip(got.host, got.verdict))
    assert all(v == ("block" if ".bad" in h else "allow") for h, v in verdict.items() if h.startswith("h") and h != "h9.bad1.info")
    assert {"block", "allow"} == set(verdict.values())
