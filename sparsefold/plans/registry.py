"""A decorator that files a query under its name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparsefold.plans.fixture import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """sql reads the tables obs, var, x and presence (plain: only the driver's tables)."""

    def file(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else f"{SQL}{sql.strip()}" if not sql.strip().startswith(",") else f"{SQL.rstrip()}{sql.strip()}"
        return f

    return file
