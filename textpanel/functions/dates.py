"""Column expressions on periods: months as whole numbers, quarters, formation dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def month_id(d: Column | str) -> Column:
    """year * 100 + month."""
    d = as_col(d)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def month_tick(d: Column | str) -> Column:
    """Months since January of year 0: consecutive months are consecutive whole numbers."""
    d = as_col(d)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def tick_month_id(tick: Column | str) -> Column:
    """The month_id of a month_tick."""
    t = as_col(tick)
    return (F.floor(t / 12) * 100 + t % 12 + 1).cast("int")


def quarter_start(year: Column | str, quarter: Column | str) -> Column:
    """First day of a quarter; null if either part is null or there is no such quarter."""
    y, q = as_col(year), as_col(quarter)
    return F.when(q.between(1, 4) & y.between(1, 9999), F.make_date(y, q * 3 - 2, F.lit(1)))
