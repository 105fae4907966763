"""Plans on security panels that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_id, quarter_start
from ..functions.numeric import is_finite


def return_records(returns: DataFrame, value: bool = False) -> DataFrame:
    """Distinct (permno, month_id) of rows with a permno, a month and a finite RetM; with `value` also RetM.

    Repeated rows agree in RetM; should they not, the smallest is taken, so the result doesn't depend on row order. The
    aggregate combines on the map side, so a security or month that holds much of the table costs no task more than others.
    """
    kept = returns.filter(F.col("permno").isNotNull() & F.col("Month").isNotNull() & is_finite("RetM")).select("permno", month_id("Month").alias("month_id"), "RetM")
    return kept.groupBy("permno", "month_id").agg(F.min("RetM").alias("RetM")) if value else kept.select("permno", "month_id").distinct()


def formation_date() -> Column:
    """form_q, or else the first day of quarter of year."""
    return F.coalesce(F.col("form_q").cast("date"), quarter_start("year", "quarter"))
