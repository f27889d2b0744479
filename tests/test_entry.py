"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_against_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, D)
    r = duck.execute(entry.oracle_sql()[name])
    want = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(want)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(want, r.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
