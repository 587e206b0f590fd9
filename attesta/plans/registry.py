"""The catalogue: name -> (spark, root) -> DataFrame, and name -> checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its independent check."""

    def register(function: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
