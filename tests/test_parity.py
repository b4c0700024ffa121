"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.core.oracle_sql()))
def test_same_rows(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr(tuple(x)) for x in df.select(*sorted(columns)).collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.core.queries()) - set(entry.core.oracle_sql())))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
