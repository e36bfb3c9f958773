"""Where the plan modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives the same rows."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return enter


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, as sums depend on their order in the last digits; own: other digits for some columns."""
    return df.select(*[_round(F.col(f"`{c}`"), own.get(c, digits)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def _round(x: Column, digits: int) -> Column:
    return F.round(x, digits) + F.lit(0.0)
