"""p5: the version of a firm-quarter row that was known when the month of a return began."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_tick, tick_month_id
from ..functions.numeric import is_finite
from ..operators.asof_versions import asof_versions, supersede
from ..sources.tables import table
from .panel import formation_date

LAG_MONTHS = 3


def firm_quarter_versions(exposure: DataFrame) -> DataFrame:
    """(permno, known_from, form, known_ts, fq_id): a row may be used from the first month that begins LAG_MONTHS after its
    formation date or later, and strictly after it became known. A month begins at 00:00:00 of its first day, so a row known at
    that very instant is known from the following month on."""
    form = F.add_months(formation_date(), LAG_MONTHS)
    kept = exposure.filter(F.col("permno").isNotNull() & F.col("known_ts").isNotNull()).withColumn("form", formation_date()).filter("form IS NOT NULL")
    ready = month_tick(form) + F.when(F.dayofmonth(form) > 1, 1).otherwise(0)
    known = month_tick("known_ts") + 1
    return kept.select("permno", F.greatest(ready, known).alias("known_from"), "form", "known_ts", "fq_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = table(spark, sf_dir, "crsp_returns_monthly", "permno", "Month", "RetM")
    events = returns.filter(F.col("permno").isNotNull() & F.col("Month").isNotNull() & is_finite("RetM")).select("permno", month_tick("Month").alias("tick")).distinct()
    versions = supersede(firm_quarter_versions(table(spark, sf_dir, "exposure_firmquarter_crsp", "permno", "year", "quarter", "form_q", "known_ts", "fq_id")), ["permno"], "known_from", ["form", "known_ts", "fq_id"])
    first, last = returns.agg(F.min(month_tick("Month")), F.max(month_tick("Month"))).first()
    met = asof_versions(events, versions, ["permno"], "tick", ["fq_id"], span=(first, last) if last is not None else (0, 0))
    return met.select("permno", tick_month_id("tick").alias("month_id"), "fq_id")
