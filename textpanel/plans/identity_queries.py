"""Queries on deduplication, identifiers and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SIC_DIVISIONS
from ..functions.text import clean_ric as ric_col
from ..functions.text import clean_ticker as ticker_col
from ..functions.text import ric_base, ric_suffix
from ..operators import identity
from ..sources.tables import table
from .panel import formation_date
from .registry import query

#: The codes of this collection's exchange map.
REGIONS = {"North America": "NorthAmerica", "Europe": "Europe", "Asia": "AsiaPacExJapan", "Oceania": "AsiaPacExJapan", "Latin America": "Emerging", ("Asia", "Japan"): "Japan", ("Asia", "China"): "Emerging"}
FORM = "coalesce(CAST(form_q AS DATE), CASE WHEN quarter BETWEEN 1 AND 4 THEN make_date(year, quarter * 3 - 2, 1) END)"


@query(f"SELECT permno, {FORM} AS form, fq_id FROM exposure_firmquarter_crsp WHERE permno IS NOT NULL QUALIFY row_number() OVER (PARTITION BY permno, {FORM} ORDER BY known_ts NULLS LAST, fq_id) = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first version of each firm-quarter to become known."""
    e = table(spark, d, "exposure_firmquarter_crsp").filter("permno IS NOT NULL").select("permno", formation_date().alias("form"), "fq_id", "known_ts")
    return identity.keep_first(e, ["permno", "form"], ["known_ts", "fq_id"]).select("permno", "form", "fq_id")


def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "text", "companyTicker", "eventYear").filter("text IS NOT NULL").select(F.md5("text").alias("Id"), "companyTicker", "eventYear")


REG = """v AS (SELECT md5(text) AS Id, companyTicker, eventYear FROM documents WHERE text IS NOT NULL), sn AS (SELECT Id, companyTicker, min(eventYear) AS y FROM v WHERE companyTicker IS NOT NULL GROUP BY 1, 2),
tk AS (SELECT Id, first(companyTicker ORDER BY y NULLS FIRST, companyTicker) AS event_time_ticker, string_agg(companyTicker, ';' ORDER BY y NULLS FIRST, companyTicker) AS all_tickers FROM sn GROUP BY 1),
ev AS (SELECT Id, count(DISTINCT eventYear) AS n_versions, min(eventYear) AS first_file_year FROM v GROUP BY 1),
reg AS (SELECT Id, event_time_ticker, coalesce(all_tickers, '') AS all_tickers, n_versions, first_file_year FROM ev LEFT JOIN tk USING (Id))"""


@query(f"WITH {REG} SELECT * FROM reg")
def event_registry(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct text, with its tickers in order of appearance."""
    return identity.event_registry(versions(spark, d), "Id", "companyTicker", "eventYear")


RIC = "nullif(trim(split_part(upper(trim(Ticker)), '^', 1)), '')"


@query(f"SELECT DISTINCT Ticker, {RIC} AS ric, nullif(trim(regexp_replace(split_part(upper(trim(Ticker)), '.', 1), '[*^~].*$', '')), '') AS ticker_base, split_part({RIC}, '.', 1) AS base, CASE WHEN contains({RIC}, '.') THEN substring({RIC}, strpos({RIC}, '.')) WHEN {RIC} IS NOT NULL THEN '' END AS suffix FROM panel_ric")
def clean_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Canonical forms of identifiers."""
    r = ric_col("Ticker")
    return table(spark, d, "panel_ric", "Ticker").select("Ticker", r.alias("ric"), ticker_col("Ticker").alias("ticker_base"), ric_base(r).alias("base"), F.when(r.isNotNull(), ric_suffix(r)).alias("suffix")).distinct()


RES = f"""pr AS (SELECT DISTINCT {RIC} AS p FROM panel_ric WHERE {RIC} IS NOT NULL), bs AS (SELECT split_part(p, '.', 1) AS base, min(p) AS sole FROM pr GROUP BY 1 HAVING count(*) = 1),
ev AS (SELECT DISTINCT nullif(trim(split_part(upper(trim(companyTicker)), '^', 1)), '') AS ric FROM documents), ee AS (SELECT ric FROM ev WHERE ric IS NOT NULL UNION SELECT split_part(ric, '.', 1) FROM ev WHERE ric IS NOT NULL)"""


def event_rics(spark: SparkSession, d: str) -> DataFrame:
    """RICs of documents, with and without their suffix."""
    r = table(spark, d, "documents", "companyTicker").select(ric_col("companyTicker").alias("ric")).filter("ric IS NOT NULL")
    return r.unionAll(r.select(ric_base("ric"))).distinct()


@query(
    f"WITH {RES} SELECT ric, coalesce(pr.p, CASE WHEN NOT contains(ric, '.') OR substring(ric, strpos(ric, '.')) = substring(sole, strpos(sole, '.')) THEN sole END) AS resolved FROM ee LEFT JOIN pr ON pr.p = ric LEFT JOIN bs ON bs.base = split_part(ric, '.', 1)"
)
def resolve_ric(spark: SparkSession, d: str) -> DataFrame:
    """Exact match, else the only priced RIC of the base."""
    prices = table(spark, d, "panel_ric", "Ticker").select(ric_col("Ticker").alias("p"))
    return identity.resolve_ric(event_rics(spark, d), "ric", prices, "p")


@query(
    f"WITH {REG}, k AS (SELECT DISTINCT Ticker FROM panel_ric) SELECT count(*) AS n, count(*) FILTER (event_time_ticker IN (SELECT Ticker FROM k)) AS n_first, count(*) FILTER (list_has_any(string_split(all_tickers, ';'), (SELECT list(Ticker) FROM k))) AS n_any FROM reg"
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Events whose tickers have prices."""
    reg = identity.event_registry(versions(spark, d), "Id", "companyTicker", "eventYear").withColumnRenamed("Id", "_id")
    return identity.coverage(reg, "event_time_ticker", "all_tickers", table(spark, d, "panel_ric", "Ticker"), "Ticker")


@query(
    "WITH x AS (SELECT permno, comnam, namedt, nameendt FROM crsp_names WHERE permno IS NOT NULL AND comnam IS NOT NULL), a AS (SELECT permno, comnam, namedt FROM x QUALIFY row_number() OVER (PARTITION BY permno ORDER BY namedt NULLS LAST, comnam) = 1) SELECT permno, comnam FROM a QUALIFY row_number() OVER (PARTITION BY comnam ORDER BY namedt NULLS LAST, permno) = 1"
)
def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """One name per security, one security per name."""
    n = table(spark, d, "crsp_names", "permno", "comnam", "namedt").filter("permno IS NOT NULL AND comnam IS NOT NULL")
    return identity.one_to_one(n, "permno", "comnam", ["namedt"]).select("permno", "comnam")


@query(
    f"WITH p AS (SELECT {RIC} AS ric, count(*) AS n FROM panel_ric WHERE {RIC} IS NOT NULL GROUP BY 1) SELECT ric, n, CASE WHEN Region = 'North America' THEN 'NorthAmerica' WHEN Region = 'Europe' THEN 'Europe' WHEN Region = 'Asia' AND Country_Clean = 'Japan' THEN 'Japan' WHEN Region = 'Asia' AND Country_Clean = 'China' THEN 'Emerging' WHEN Region IN ('Asia', 'Oceania') THEN 'AsiaPacExJapan' WHEN Region = 'Latin America' THEN 'Emerging' END AS region FROM p LEFT JOIN exchange_region e ON e.suffix = split_part(ric, '.', 2)"
)
def region_map(spark: SparkSession, d: str) -> DataFrame:
    """Return region of each RIC by its exchange."""
    p = table(spark, d, "panel_ric", "Ticker").select(ric_col("Ticker").alias("ric")).filter("ric IS NOT NULL").groupBy("ric").agg(F.count("*").alias("n"))
    e = table(spark, d, "exchange_region", "suffix", "Region", "Country_Clean")
    return p.join(e, F.split_part("ric", F.lit("."), F.lit(2)) == F.col("suffix"), "left").select("ric", "n", identity.region("Region", "Country_Clean", REGIONS).alias("region"))


_DIV = " ".join(f"WHEN siccd < {top} THEN '{name}'" if top else f"WHEN siccd IS NOT NULL THEN '{name}'" for top, name in SIC_DIVISIONS)


@query(f"SELECT siccd, CASE {_DIV} END AS division, CAST(floor(siccd / 100) AS INTEGER) AS sic2, CAST(floor(siccd / 1000) AS INTEGER) AS sic1, count(*) AS n FROM exposure_firmquarter_crsp GROUP BY 1")
def sic_division(spark: SparkSession, d: str) -> DataFrame:
    """Industry divisions."""
    e = table(spark, d, "exposure_firmquarter_crsp", "siccd").groupBy("siccd").agg(F.count("*").alias("n"))
    return e.select("siccd", identity.sic_division("siccd").alias("division"), identity.sic_level("siccd", 2).alias("sic2"), identity.sic_level("siccd", 1).alias("sic1"), "n")


@query(
    f"SELECT {RIC} AS ric, year(Quarter)::INTEGER AS year, round(avg(QuarterlyRet) FILTER (isfinite(QuarterlyRet)), 9) + 0.0 AS ret, coalesce(bool_or(us_can), false) AS us_can, arg_min(siccd, Quarter) FILTER (siccd IS NOT NULL) AS siccd, count(*) AS n FROM (SELECT DISTINCT Ticker, Quarter, us_can, siccd, QuarterlyRet FROM panel_ric) WHERE {RIC} IS NOT NULL GROUP BY 1, 2"
)
def firm_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by firm and period, any US flag, first known industry."""
    from ..functions.numeric import finite

    p = table(spark, d, "panel_ric", "Ticker", "Quarter", "us_can", "siccd", "QuarterlyRet").distinct().select(ric_col("Ticker").alias("ric"), F.year("Quarter").alias("year"), "Quarter", "us_can", "siccd", "QuarterlyRet").filter("ric IS NOT NULL")
    g = p.groupBy("ric", "year").agg(F.avg(finite("QuarterlyRet")).alias("ret"), F.coalesce(F.bool_or("us_can"), F.lit(False)).alias("us_can"), identity.first_known("siccd", "Quarter").alias("siccd"), F.count("*").alias("n"))
    return g.withColumn("ret", F.round("ret", 9) + F.lit(0.0))
