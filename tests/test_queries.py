"""Every registered point query gives what its SQL gives, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
import lodestone.plans.validation  # noqa: F401
from lodestone.plans.analysis import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    theirs = duck.sql(SQL[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    key = lambda row: [(v is None, str(v)) for v in row]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"contaminated_tau"}))
def test_without_sql_runs(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() == 6000
    assert set(entry.oracle_sql()) <= set(entry.queries())
