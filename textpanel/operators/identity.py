"""Deduplication, event registry, identifier resolution, region and industry maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SIC_DIVISIONS
from ..functions.numeric import as_col
from ..functions.text import ric_base, ric_suffix


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order` (ascending, nulls last); rows that agree in keys and order are the same to the rule.

    An aggregate with a map-side combine, not a window: a key that holds much of the table costs no single task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(f"_v_{c}"))])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def event_registry(versions: DataFrame, key: str, ticker: str, file_year: str) -> DataFrame:
    """Per event: ticker of the first file year, all tickers in order of first appearance joined by ;, number of file years, first file year.

    Null tickers are left out; an event with none has null and an empty string.
    """
    seen = versions.filter(F.col(ticker).isNotNull()).groupBy(key, ticker).agg(F.min(file_year).alias("_y"))
    tickers = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_y", ticker))).alias("_l"))
    years = versions.groupBy(key).agg(F.countDistinct(file_year).alias("n_versions"), F.min(file_year).alias("first_file_year"))
    named = years.join(tickers, key, "left")
    listed = F.transform("_l", lambda x: x[ticker])
    return named.select(key, F.get("_l", F.lit(0))[ticker].alias("event_time_ticker"), F.coalesce(F.array_join(listed, ";"), F.lit("")).alias("all_tickers"), "n_versions", "first_file_year")


def resolve_ric(rics: DataFrame, ric: str, prices: DataFrame, price_ric: str) -> DataFrame:
    """rics with `resolved`: the same RIC if priced; else the one priced RIC with its base, if there is exactly one and the RIC has no suffix
    or that same suffix; else null."""
    known = prices.select(F.col(price_ric).alias("_p")).filter("_p IS NOT NULL").distinct()
    by_base = known.groupBy(ric_base("_p").alias("_base")).agg(F.count("*").alias("_n"), F.min("_p").alias("_only")).filter("_n = 1")
    exact = known.withColumnRenamed("_p", "_exact")
    out = rics.join(exact, F.col(ric) == F.col("_exact"), "left").withColumn("_b", ric_base(ric)).join(by_base, F.col("_b") == F.col("_base"), "left")
    fits = (ric_suffix(ric) == "") | (ric_suffix(ric) == ric_suffix("_only"))
    return out.withColumn("resolved", F.coalesce("_exact", F.when(fits, F.col("_only")))).select(*rics.columns, "resolved")


def coverage(events: DataFrame, first: str, every: str, known: DataFrame, name: str) -> DataFrame:
    """One row: events, how many are matched by their first ticker, and by any of them (separated by ;)."""
    k = known.select(F.col(name).alias("_k")).filter("_k IS NOT NULL").distinct()
    rows = events.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in events.columns else events
    long = rows.select("_id", F.col(first).alias("_f"), F.explode_outer(F.split(every, ";")).alias("_t")).join(k, F.col("_t") == F.col("_k"), "left")
    per = long.groupBy("_id").agg(F.max(((F.col("_t") == F.col("_f")) & F.col("_k").isNotNull()).cast("int")).alias("a"), F.max(F.col("_k").isNotNull().cast("int")).alias("b"))
    return per.agg(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_first"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_any"))


def one_to_one(pairs: DataFrame, a: str, b: str, order: Sequence[str]) -> DataFrame:
    """At most one row per a, then at most one per b: the first by `order`."""
    return keep_first(keep_first(pairs, [a], [*order, b]), [b], [*order, a])


def first_known(column: str, order: str) -> Column:
    """Aggregate: the value at the smallest `order` at which it isn't null."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


#: Return regions by the codes of the exchange map; what is listed under (code, country) goes before the code alone.
REGIONS = {"NorthAmerica": "NorthAmerica", "Europe": "Europe", "EM": "Emerging", "AsiaPacific_DM": "AsiaPacExJapan", ("AsiaPacific_DM", "Japan"): "Japan"}


def region(region_col: Column | str, country: Column | str, regions: Mapping[str | tuple[str, str], str] = REGIONS) -> Column:
    """The return region of an exchange's region code and country by the map `regions`; null for codes that it doesn't have."""
    r, c = as_col(region_col), as_col(country)
    out = F.lit(None).cast("string")
    for code, name in regions.items():
        if isinstance(code, str):
            out = F.when(r == code, name).otherwise(out)
    for code, name in regions.items():
        if not isinstance(code, str):
            out = F.when((r == code[0]) & (c == code[1]), name).otherwise(out)
    return out


def sic_division(sic: Column | str) -> Column:
    """Name of the industry division; null for a null code."""
    s = as_col(sic)
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for top, name in SIC_DIVISIONS:
        out = out.otherwise(F.lit(name)) if top is None else out.when(s < top, name)
    return out


def sic_level(sic: Column | str, digits: int) -> Column:
    """The first `digits` of a four-digit code, as a number."""
    return F.floor(as_col(sic) / 10 ** (4 - digits)).cast("int")
