"""Every registered query with SQL text against DuckDB on the smallest tables."""

import duckdb
import pytest

from plumewire import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, small, duck, name):
    got = plans.QUERIES[name](spark, small)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert left == sorted(repr(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
