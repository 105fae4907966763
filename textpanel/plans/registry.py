"""Where the query modules enter their queries: a function of (spark, folder of tables) and, if there is one, SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return enter


def r6(c: Column | str) -> Column:
    """Rounded to six places, never minus zero: what two engines' floating-point sums agree on."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """12 digits for plain means of decimals: with 6, a mean may lie just between two roundings, and the order of its sum would decide."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
