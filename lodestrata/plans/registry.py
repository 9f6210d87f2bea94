"""Registering queries beside their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, per_row: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL where SQL can say it.

    ``per_row``: the query maps rows to rows and keeps their id, so it may run
    on the rows as delivered (see ``sources.corpus``).
    """

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = corpus.per_row(function) if per_row else function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register
