"""How the modules of this package register queries."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """(queries, oracles, decorator): the decorator puts a function and its SQL under the function's name."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query


def rounded(df, *columns, places: int = 6):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, places) for c in columns})
