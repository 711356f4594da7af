"""Query registry: every entry pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creaseline.queries.oracle import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NUDGE = 1e-9


#: Queries whose SQL reads deduplicated balls.
UNIQUE_BALLS: set[str] = set()


def query(name: str, sql: str | None = None, of_unique_balls: bool = False) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if of_unique_balls:
            UNIQUE_BALLS.add(name)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that the order of summation does not show; -0.0 becomes 0.0.

    The nudge moves short decimals off the rounding border, where the last bit would decide.
    """
    return df.select(
        *[
            (F.round(F.col(n) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def r(*columns: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`rounded` for the named columns."""
    return ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, {digits}) + 0.0 AS {c}" for c in columns)


def oracles() -> dict[str, str]:
    """Complete SQL of every checked query."""
    return {name: with_tables(sql, name in UNIQUE_BALLS) for name, sql in ORACLES.items()}
