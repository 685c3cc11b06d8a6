"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from tideline import plans

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(row):
    return repr(tuple(0.0 if isinstance(x, float) and x == 0 else x for x in row))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted(plain(r) for r in df.select(*columns).collect())
    assert got == sorted(plain(r) for r in want.select(", ".join(columns)).fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
