"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: f for k, f in entry.queries().items() if k in entry.oracle_sql()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark):
    for name in ("em_mixture", "resampling_test", "bad_splices", "kmeans_assign"):
        assert entry.queries()[name](spark, SF).count() > 0, name
