"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .listing import LISTING_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, listing: bool = False):
    """Registers a function as a query under its own name; listing: its SQL may use the bundled tables as listings."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if listing:
                body = f"WITH {LISTING_SQL.strip()}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
            ORACLE_SQL[f.__name__] = body
        return f

    return add
