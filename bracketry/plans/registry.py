"""Every query over the test tables with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


from . import careers, choice, cuts, details, fits, judging, linking, lookups, markets, merges, pages, pasting, ratings, resolution, rounds, scores, streams, texts, trading, trials  # noqa: E402, F401
