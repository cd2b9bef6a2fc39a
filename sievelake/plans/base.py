"""How a query and its SQL are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; without SQL, tests hold its operator or function against plain Python (tests/test_whole_jobs.py, tests/test_functions.py), not the query."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def at(text: str) -> Column:
    """A time, as the tables have it. Rules never read the clock: now is always a parameter."""
    return F.lit(text).cast("timestamp_ntz")


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


__all__ = ["ORACLE", "QUERIES", "at", "long", "query", "table"]
