"""Event studies: anchors, estimation by sufficient statistics, abnormal returns, window tests, volatility ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_finite, safe_div
from .joins import asof_forward, offset_window


def trading_index(daily: DataFrame, key: str, date: str, name: str = "ti") -> DataFrame:
    """daily with the running number of each key's days, from 1. One row per key and day."""
    return daily.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(date)))


def anchors(events: DataFrame, indexed: DataFrame, key: str, date: str, event_id: str, days: int = 7, before: int = 0, after: int = 0) -> DataFrame:
    """(event_id, key, ti): the first trading day on or after the event, at most `days` later, that has `before` days of history and
    `after` days of future."""
    t0 = asof_forward(events, indexed, [key], date, event_id, ["ti"], days).drop("matched")
    ends = indexed.groupBy(key).agg(F.max("ti").alias("_n"))
    return t0.join(ends, key).filter((F.col("ti") - before >= 1) & (F.col("ti") + after <= F.col("_n"))).select(event_id, key, "ti")


def market_model(anchored: DataFrame, indexed: DataFrame, key: str, event_id: str, ret: str, market: str, lo: int, hi: int, least: int = 3) -> DataFrame:
    """(event_id, n, alpha, beta) of the estimation window [lo, hi] around the anchor, from sums per event."""
    w = offset_window(anchored.select(event_id, key, "ti"), indexed.select(key, "ti", ret, market), key, "ti", lo, hi)
    ok = w.filter(is_finite(ret) & is_finite(market))
    return ok.groupBy(event_id).agg(F.count("*").alias("n"), F.regr_intercept(ret, market).alias("alpha"), F.regr_slope(ret, market).alias("beta")).filter(F.col("n") >= least)


def factor_model(anchored: DataFrame, indexed: DataFrame, key: str, event_id: str, ret: str, factors: Sequence[str], lo: int, hi: int, least: int = 10) -> DataFrame:
    """(event_id, n, coef): the same with several factors: 1 + k + k (k + 1) / 2 sums per event, solved in batches; singular: null."""
    from .regress import grouped_ols

    w = offset_window(anchored.select(event_id, key, "ti"), indexed.select(key, "ti", ret, *factors), key, "ti", lo, hi)
    return grouped_ols(w, [event_id], ret, factors, least).select(event_id, "n", "coef")


def abnormal(anchored: DataFrame, indexed: DataFrame, models: DataFrame, key: str, event_id: str, ret: str, market: str, lo: int, hi: int) -> DataFrame:
    """(event_id, k, ar_mean, ar_market, ar_model): abnormal returns against 0 beta (market adjusted) and the market model, by day k."""
    w = offset_window(anchored.select(event_id, key, "ti"), indexed.select(key, "ti", ret, market), key, "ti", lo, hi).filter(is_finite(ret) & is_finite(market))
    return w.join(models.select(event_id, "alpha", "beta"), event_id).select(event_id, "k", F.col(ret).alias("ar_raw"), (F.col(ret) - F.col(market)).alias("ar_market"), (F.col(ret) - F.col("alpha") - F.col("beta") * F.col(market)).alias("ar_model"))


def car(ar: DataFrame, groups: DataFrame, event_id: str, group: str, value: str) -> DataFrame:
    """(group, k, aar, car, n): mean abnormal return by day, and its running sum."""
    m = ar.join(groups.select(event_id, group).filter(F.col(group).isNotNull()), event_id).groupBy(group, "k").agg(F.avg(value).alias("aar"), F.count(value).alias("n"))
    return m.withColumn("car", F.sum("aar").over(Window.partitionBy(group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))


def window_car(ar: DataFrame, event_id: str, value: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(event_id, window, car): sums of abnormal returns over each window."""
    parts = [F.when(F.col("k").between(lo, hi), F.lit(name)) for name, (lo, hi) in windows.items()]
    long = ar.select(event_id, value, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("window"))
    return long.groupBy(event_id, "window").agg(F.sum(value).alias("car"))


def welch(df: DataFrame, by: Sequence[str], group: str, value: str, a, b) -> DataFrame:
    """(by, diff, t, df): mean of group a minus mean of group b with Welch's t and degrees of freedom; null below two rows each."""
    x = df.filter(is_finite(value) & F.col(group).isin([a, b]))
    stats = [f(F.when(F.col(group) == g, F.col(value))).alias(n) for g, s in ((a, "a"), (b, "b")) for f, n in ((F.avg, f"m{s}"), (F.var_samp, f"v{s}"), (F.count, f"n{s}"))]
    s = x.groupBy(*by).agg(*stats)
    ea, eb = safe_div("va", "na"), safe_div("vb", "nb")
    ok = (F.col("na") > 1) & (F.col("nb") > 1)
    return s.select(*by, (F.col("ma") - F.col("mb")).alias("diff"), F.when(ok & (ea + eb > 0), (F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"), F.when(ok & (ea + eb > 0), (ea + eb) ** 2 / (ea**2 / (F.col("na") - 1) + eb**2 / (F.col("nb") - 1))).alias("df"), (F.col("na") + F.col("nb")).alias("n"))


def volatility_ratio(anchored: DataFrame, indexed: DataFrame, key: str, event_id: str, ret: str, event: tuple[int, int] = (-1, 5), before: tuple[int, int] = (-20, -6), least: int = 3, most: float = 10.0) -> DataFrame:
    """(event_id, sd_event, sd_before, ratio) with at least `least` days in both windows and a ratio below `most`; one join for both windows."""
    lo, hi = min(before[0], event[0]), max(before[1], event[1])
    w = offset_window(anchored.select(event_id, key, "ti"), indexed.select(key, "ti", ret), key, "ti", lo, hi).filter(is_finite(ret))
    cell = lambda span: F.when(F.col("k").between(*span), F.col(ret))
    s = w.groupBy(event_id).agg(F.stddev_samp(cell(event)).alias("sd_event"), F.stddev_samp(cell(before)).alias("sd_before"), F.count(cell(event)).alias("_e"), F.count(cell(before)).alias("_b"))
    ok = s.filter((F.col("_e") >= least) & (F.col("_b") >= least)).withColumn("ratio", safe_div("sd_event", "sd_before"))
    return ok.filter(F.col("ratio") < most).select(event_id, "sd_event", "sd_before", "ratio")
