"""Registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AREAS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; ``sql`` returns the same rows from the same tables."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        AREAS[name] = f.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def r6(c) -> Column:
    """Doubles are compared at six decimals, as sums depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``digits`` beyond six where averages of averages would end in a tie at six."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
