"""Where queries and their SQL are registered; it imports no module that registers any, so these may be imported in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.plans.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def said(text: str) -> Callable:
    """Registers a query under its SQL."""

    def keep(f: Query) -> Query:
        SQL[f.__name__] = text
        return query(f)

    return keep
