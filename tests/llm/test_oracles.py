"""Queries with SQL give what DuckDB gives on the same tables."""

import duckdb
import pytest

from tideline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))
