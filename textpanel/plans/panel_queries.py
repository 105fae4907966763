"""Queries on panels: returns by month and quarter, firm-quarter measures held forward, bins, leads, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite, is_finite
from ..functions.text import clean_ric
from ..operators import joins, panel, sorts, validate
from ..operators.identity import sic_division
from ..sources.tables import table
from .identity_queries import FORM, RIC
from .panel import formation_date
from .storage import stored
from .registry import query, r6, rounded

RET_MOST = 3.0  # months with wilder returns are left out of the panels: their statistics would be the dirt's


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(permno, Month, ret, cap): one row per security and month."""
    r = table(spark, d, "crsp_returns_monthly", "permno", "Month", "RetM", "MCap_MEnd").filter(F.col("permno").isNotNull() & is_finite("RetM") & (F.abs("RetM") < RET_MOST))
    return r.groupBy("permno", F.trunc(F.col("Month").cast("date"), "month").alias("Month")).agg(F.min("RetM").alias("ret"), F.min(finite("MCap_MEnd")).alias("cap"))


MRET = f"mr AS (SELECT permno, CAST(date_trunc('month', Month) AS DATE) AS Month, min(RetM) AS ret, min(MCap_MEnd) FILTER (isfinite(MCap_MEnd)) AS cap FROM crsp_returns_monthly WHERE permno IS NOT NULL AND isfinite(RetM) AND abs(RetM) < {RET_MOST} GROUP BY 1, 2)"


def firm_quarters(spark: SparkSession, d: str) -> DataFrame:
    """(permno, form, siccd, measures): the last known version of each firm-quarter."""
    e = table(spark, d, "exposure_firmquarter_crsp").filter("permno IS NOT NULL AND known_ts IS NOT NULL").withColumn("form", formation_date()).filter("form IS NOT NULL")
    v = F.max(F.struct("known_ts", "fq_id", "siccd", "gvkey", "GeoExposure", "GeoRisk", "GeoSentiment", "n_calls")).alias("v")
    return e.groupBy("permno", "form").agg(v).select("permno", "form", *[F.col(f"v.{c}").alias(c) for c in ("siccd", "gvkey", "GeoExposure", "GeoRisk", "GeoSentiment", "n_calls")])


FQ = f"fq AS (SELECT permno, {FORM} AS form, siccd, gvkey, GeoExposure, GeoRisk, GeoSentiment, n_calls FROM exposure_firmquarter_crsp WHERE permno IS NOT NULL AND known_ts IS NOT NULL AND {FORM} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY permno, {FORM} ORDER BY known_ts DESC, fq_id DESC) = 1)"


def held(spark: SparkSession, d: str) -> DataFrame:
    """(permno, Month, siccd, measures, ret, cap): firm-quarters in the three months after a lag, with that month's return."""
    h = joins.hold_forward(firm_quarters(spark, d), "form")
    return h.join(monthly(spark, d), ["permno", "Month"])


HELD = f"{MRET}, {FQ}, hd AS (SELECT fq.*, CAST(form + to_months(k::INTEGER) AS DATE) AS Month FROM fq, range(3, 6) AS r(k)), he AS (SELECT hd.*, ret, cap FROM hd JOIN mr USING (permno, Month))"


@query(f"WITH {MRET} SELECT permno, CAST(date_trunc('quarter', Month) AS DATE) AS Quarter, round(product(1 + ret) - 1, 6) + 0.0 AS RetQ, round(arg_max(cap, Month) FILTER (cap IS NOT NULL), 6) + 0.0 AS MCap_QEnd, count(ret) AS n_months FROM mr GROUP BY 1, 2 HAVING count(ret) >= 2")
def compound_quarterly(spark: SparkSession, d: str) -> DataFrame:
    """A2, A5: returns compounded over quarters with two months or more."""
    return rounded(panel.quarterly(monthly(spark, d), "permno", "Month", "ret", "cap"), "RetQ", "MCap_QEnd")


@query(f"WITH {MRET}, q AS (SELECT Month, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM mr GROUP BY 1) SELECT permno, Month, round(least(greatest(ret, lo), hi), 6) + 0.0 AS ret_w FROM mr JOIN q USING (Month)")
def winsorize_period(spark: SparkSession, d: str) -> DataFrame:
    """Returns held within their month's quantiles."""
    return rounded(panel.winsorize(monthly(spark, d), ["Month"], "ret").select("permno", "Month", "ret_w"), "ret_w")


FIN = lambda c: f"(CASE WHEN isfinite({c}) THEN {c} END)"


@query(f"WITH {FQ}, q AS (SELECT form, avg({FIN('GeoExposure')}) AS m, stddev_samp({FIN('GeoExposure')}) AS s FROM fq GROUP BY 1) SELECT permno, form, CASE WHEN s > 0 THEN round(({FIN('GeoExposure')} - m) / s, 6) + 0.0 END AS z FROM fq JOIN q USING (form)")
def zscore_period(spark: SparkSession, d: str) -> DataFrame:
    """Exposure standardised within the quarter."""
    return rounded(panel.zscore(firm_quarters(spark, d), ["form"], "GeoExposure", "z").select("permno", "form", "z"), "z")


@query(f"WITH {MRET}, q AS (SELECT quantile_cont(ret, 0.99) AS p FROM mr) SELECT permno, Month, round(least(ret, p), 6) + 0.0 AS ret_u FROM mr, q")
def winsorize_upper(spark: SparkSession, d: str) -> DataFrame:
    """Held below the 99th percentile of all rows."""
    return rounded(panel.winsorize_upper(monthly(spark, d), "ret", 0.99, "ret_u").select("permno", "Month", "ret_u"), "ret_u")


@query(f"WITH {FQ}, q AS (SELECT form, siccd, avg({FIN('GeoRisk')}) AS m FROM fq GROUP BY 1, 2) SELECT permno, fq.form, round({FIN('GeoRisk')} - m, 11) + 0.0 AS x FROM fq JOIN q ON fq.form = q.form AND fq.siccd IS NOT DISTINCT FROM q.siccd")
def group_demean(spark: SparkSession, d: str) -> DataFrame:
    """Risk minus its industry's mean in the quarter."""
    x = panel.demean(firm_quarters(spark, d), ["form", "siccd"], "GeoRisk", "x")
    return x.select("permno", "form", (F.round("x", 11) + F.lit(0.0)).alias("x"))


@query(f"WITH {FQ}, q AS (SELECT form, quantile_cont({FIN('GeoExposure')}, 0.5) AS m FROM fq GROUP BY 1) SELECT permno, form, ({FIN('GeoExposure')} > m)::INTEGER AS above FROM fq JOIN q USING (form)")
def median_split(spark: SparkSession, d: str) -> DataFrame:
    """Above the quarter's median."""
    return panel.median_split(firm_quarters(spark, d), ["form"], "GeoExposure").select("permno", "form", "above")


QRET = f"{MRET}, qr AS (SELECT permno, CAST(date_trunc('quarter', Month) AS DATE) AS Quarter, product(1 + ret) - 1 AS RetQ FROM mr GROUP BY 1, 2 HAVING count(ret) >= 2)"


@query(f"WITH {QRET} SELECT permno, Quarter, CASE WHEN date_diff('day', Quarter, lead(Quarter) OVER w) <= 95 THEN round(lead(RetQ) OVER w, 6) + 0.0 END AS lead_ret FROM qr WINDOW w AS (PARTITION BY permno ORDER BY Quarter)")
def lead_gap_guard(spark: SparkSession, d: str) -> DataFrame:
    """Next quarter's return, if there is no gap."""
    q = panel.quarterly(monthly(spark, d), "permno", "Month", "ret", "cap")
    return rounded(panel.lead_guarded(q, "permno", "Quarter", "RetQ", 95, "lead_ret").select("permno", "Quarter", "lead_ret"), "lead_ret")


_TICK = "(year(form) * 4 + quarter(form))"


@query(f"WITH {FQ} SELECT permno, form, CASE WHEN {_TICK} - lag({_TICK}) OVER w = 1 THEN round({FIN('GeoExposure')} - lag({FIN('GeoExposure')}) OVER w, 6) + 0.0 END AS d1, CASE WHEN {_TICK} - lag({_TICK}, 4) OVER w = 4 THEN round({FIN('GeoExposure')} - lag({FIN('GeoExposure')}, 4) OVER w, 6) + 0.0 END AS d4 FROM fq WINDOW w AS (PARTITION BY permno ORDER BY {_TICK})")
def diff_gap_guard(spark: SparkSession, d: str) -> DataFrame:
    """Changes over one and four quarters."""
    q = firm_quarters(spark, d).withColumn("t", F.year("form") * 4 + F.quarter("form")).withColumn("GeoExposure", finite("GeoExposure"))
    x = panel.diff_guarded(panel.diff_guarded(q, "permno", "t", "GeoExposure", 1, "d1"), "permno", "t", "GeoExposure", 4, "d4")
    return rounded(x.select("permno", "form", "d1", "d4"), "d1", "d4")


OKF = f"ok AS (SELECT * FROM fq WHERE isfinite(GeoExposure))"


@query(f"WITH {FQ}, {OKF} SELECT permno, form, CAST((row_number() OVER (PARTITION BY form ORDER BY GeoExposure, permno) * 5 + count(*) OVER (PARTITION BY form) - 1) // count(*) OVER (PARTITION BY form) AS INTEGER) AS bin FROM ok UNION ALL SELECT permno, form, NULL FROM fq WHERE GeoExposure IS NULL OR NOT isfinite(GeoExposure)")
def rank_bin_first(spark: SparkSession, d: str) -> DataFrame:
    """Quintiles by rank, ties by identifier."""
    return panel.bins(firm_quarters(spark, d), ["form"], "GeoExposure", 5, "first", "permno").select("permno", "form", "bin")


@query(f"WITH {FQ}, {OKF} SELECT permno, form, CAST(((2 * rank() OVER (PARTITION BY form ORDER BY GeoExposure) + count(*) OVER (PARTITION BY form, GeoExposure) - 1) * 10 + 2 * count(*) OVER (PARTITION BY form) - 1) // (2 * count(*) OVER (PARTITION BY form)) AS INTEGER) AS bin FROM ok UNION ALL SELECT permno, form, NULL FROM fq WHERE GeoExposure IS NULL OR NOT isfinite(GeoExposure)")
def rank_bin_average(spark: SparkSession, d: str) -> DataFrame:
    """Deciles by mean rank."""
    return panel.bins(firm_quarters(spark, d), ["form"], "GeoExposure", 10, "average").select("permno", "form", "bin")


@query(f"WITH {FQ}, q AS (SELECT form, quantile_cont(GeoExposure, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM fq WHERE isfinite(GeoExposure) AND GeoExposure <> 0 GROUP BY 1) SELECT permno, form, CAST(CASE WHEN GeoExposure = 0 THEN 0 WHEN isfinite(GeoExposure) THEN 1 + len(list_filter(b, lambda x: GeoExposure > x)) END AS INTEGER) AS decile FROM fq LEFT JOIN q USING (form)")
def decile_zero_bin(spark: SparkSession, d: str) -> DataFrame:
    """V6: deciles of the exposure that isn't zero, by quantile breaks."""
    return validate.deciles_with_zero(firm_quarters(spark, d), "GeoExposure", 10, ["form"]).select("permno", "form", F.col("decile").cast("int").alias("decile"))


@query(f"WITH {HELD} SELECT permno, Month, form, round(ret, 6) + 0.0 AS ret FROM he")
def hold_forward(spark: SparkSession, d: str) -> DataFrame:
    """Firm-quarters held for three months."""
    return rounded(held(spark, d).select("permno", "Month", "form", "ret"), "ret")


@query(f"WITH {HELD}, x AS (SELECT gvkey, Month, ret, cap FROM he WHERE gvkey IS NOT NULL) SELECT gvkey, Month, round(sum(ret * cap) FILTER (cap > 0) / sum(cap) FILTER (cap > 0), 6) + 0.0 AS ret, round(sum(cap) FILTER (cap > 0), 2) + 0.0 AS cap, count(*) AS n FROM x GROUP BY 1, 2")
def firm_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Securities to firms, value-weighted."""
    x = panel.collapse(held(spark, d).filter("gvkey IS NOT NULL"), ["gvkey", "Month"], "ret", "cap")
    return rounded(x, "ret").withColumn("cap", F.round("cap", 2) + F.lit(0.0))


@query(f"WITH {MRET}, x AS (SELECT Month, avg(ret) AS ret FROM mr GROUP BY 1) SELECT Month, round(sum(ret) OVER w, 6) + 0.0 AS total, round(exp(sum(ln(1 + ret)) OVER w), 6) + 0.0 AS growth FROM x WINDOW w AS (ORDER BY Month)")
def cumulative_return(spark: SparkSession, d: str) -> DataFrame:
    """Running sum and growth of the mean return."""
    x = monthly(spark, d).groupBy("Month").agg(F.avg("ret").alias("ret")).withColumn("all", F.lit(1))
    y = panel.cumulative(panel.cumulative(x, ["all"], "Month", "ret", "sum", "total"), ["all"], "Month", "ret", "growth", "growth")
    return rounded(y.select("Month", "total", "growth"), "total", "growth")


EVM = "ev AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events), dy AS (SELECT user_id, day, avg(value) / 1000 AS ret FROM ev GROUP BY 1, 2)"


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, day, ret): a daily series per user, from the events' values."""
    return event_rows(spark, d).groupBy("user_id", "day").agg((F.avg("value") / 1000).alias("ret"))


@query(f"WITH {EVM}, p AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'purchase'), j AS (SELECT event_id, ev.user_id, min(p.day) AS matched FROM ev JOIN p ON p.user_id = ev.user_id AND p.day BETWEEN ev.day AND ev.day + 7 GROUP BY 1, 2) SELECT * FROM j")
def asof_forward_days(spark: SparkSession, d: str) -> DataFrame:
    """Each event's next purchase day of its user, at most seven days on."""
    e = event_rows(spark, d)
    p = e.filter("event_type = 'purchase'").select("user_id", "day").distinct().withColumn("one", F.lit(1))
    return joins.asof_forward(e.select("event_id", "user_id", "day"), p, ["user_id"], "day", "event_id", ["one"], 7).select("event_id", "user_id", "matched")


@query(f"WITH {EVM}, p AS (SELECT DISTINCT user_id, day, 1 AS one FROM ev WHERE event_type = 'purchase') SELECT event_id, ev.user_id, min(p.day) AS matched, 1 AS one FROM ev JOIN p ON p.user_id = ev.user_id AND p.day >= ev.day GROUP BY 1, 2")
def asof_forward_any(spark: SparkSession, d: str) -> DataFrame:
    """The same without a limit."""
    e = event_rows(spark, d)
    p = e.filter("event_type = 'purchase'").select("user_id", "day").distinct().withColumn("one", F.lit(1))
    return joins.asof_forward_unbounded(e, p, "user_id", "day", "event_id", "one")


@query(f"WITH {EVM}, ix AS (SELECT user_id, day, ret, row_number() OVER (PARTITION BY user_id ORDER BY day) AS ti FROM dy), a AS (SELECT user_id, ti FROM ix) SELECT a.user_id, a.ti::INTEGER AS anchor, (ix.ti - a.ti)::INTEGER AS k, round(ret, 12) + 0.0 AS ret FROM a JOIN ix ON ix.user_id = a.user_id AND ix.ti BETWEEN a.ti - 3 AND a.ti + 3")
def offset_window(spark: SparkSession, d: str) -> DataFrame:
    """Every day of a user with the three days before and after."""
    from ..operators.events import trading_index

    ix = trading_index(daily(spark, d), "user_id", "day")
    a = ix.select("user_id", "ti", F.col("ti").alias("anchor"))
    return joins.offset_window(a, ix.select("user_id", "ti", "ret"), "user_id", "ti", -3, 3).select("user_id", "anchor", "k", (F.round("ret", 12) + F.lit(0.0)).alias("ret"))


PEER = f"{FQ}, pe AS (SELECT permno, form, lead(permno, k::INTEGER) OVER (PARTITION BY form, siccd, k ORDER BY permno) AS peer, 1.0 / k AS score FROM fq, range(1, 4) AS r(k) WHERE siccd IS NOT NULL)"


@query(f"WITH {PEER} SELECT pe.permno, pe.form, round(sum(score * v.GeoExposure) / sum(score), 6) + 0.0 AS peer_value, count(*) AS n_peers FROM pe JOIN fq v ON v.permno = pe.peer AND v.form = pe.form AND isfinite(v.GeoExposure) GROUP BY 1, 2")
def peer_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Exposure of the next three firms of the industry, weighted."""
    from pyspark.sql import Window

    q = firm_quarters(spark, d)
    w = Window.partitionBy("form", "siccd").orderBy("permno")
    near = F.array(*[F.struct(F.lead("permno", k).over(w).alias("peer"), F.lit(1.0 / k).alias("score")) for k in (1, 2, 3)])
    edges = q.filter("siccd IS NOT NULL").select("permno", "form", near.alias("e")).select("permno", "form", F.explode("e").alias("x")).select(F.struct("permno", "form").alias("src"), F.struct(F.col("x.peer").alias("permno"), "form").alias("dst"), "x.score")
    v = q.select(F.struct("permno", "form").alias("node"), finite("GeoExposure").alias("value"))
    p = joins.peer_weighted(edges, v, "src", "dst", "score", "node", "value")
    return rounded(p.select("src.permno", "src.form", "peer_value", "n_peers"), "peer_value")


# sorts

MEAS = "GeoRisk"
SORT = f"{HELD}, ok AS (SELECT * FROM he WHERE isfinite({MEAS})), bn AS (SELECT *, (row_number() OVER (PARTITION BY Month ORDER BY {MEAS}, permno) * 5 + count(*) OVER (PARTITION BY Month) - 1) // count(*) OVER (PARTITION BY Month) AS bin FROM ok)"


def _wide(src: str, keys: str, mean: str, n: int = 5) -> str:
    cells = ", ".join(f"max(r) FILTER (bin = {i}) AS ret_{i}" for i in range(1, n + 1))
    return f"br AS (SELECT {keys}, bin, {mean} AS r FROM {src} GROUP BY ALL), ls AS (SELECT {keys}, {cells}, max(r) FILTER (bin = {n}) - max(r) FILTER (bin = 1) AS LS FROM br GROUP BY ALL)"


_CELLS = ", ".join(f"round(ret_{i}, 12) + 0.0 AS ret_{i}" for i in range(1, 6))
VW = "sum(ret * cap) FILTER (cap > 0) / sum(cap) FILTER (cap > 0)"


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')} SELECT Month, {_CELLS}, round(LS, 12) + 0.0 AS LS FROM ls")
def ls_equal_weight(spark: SparkSession, d: str) -> DataFrame:
    """Quintile returns and long-short, equal weights."""
    return rounded(sorts.quantile_sort(held(spark, d), ["Month"], MEAS, "ret", "permno", store=stored), *[f"ret_{i}" for i in range(1, 6)], "LS", digits=12)


@query(f"WITH {SORT}, {_wide('bn', 'Month', VW)} SELECT Month, round(LS, 12) + 0.0 AS LS FROM ls")
def ls_value_weight(spark: SparkSession, d: str) -> DataFrame:
    """The same, value weights."""
    return rounded(sorts.quantile_sort(held(spark, d), ["Month"], MEAS, "ret", "permno", weight="cap", store=stored).select("Month", "LS"), "LS", digits=12)


@query(f"WITH {SORT.replace('* 5 +', '* 10 +')}, {_wide('bn', 'Month', 'avg(ret)', 10)} SELECT Month, round(LS, 12) + 0.0 AS LS FROM ls")
def ls_decile(spark: SparkSession, d: str) -> DataFrame:
    """Deciles."""
    return rounded(sorts.quantile_sort(held(spark, d), ["Month"], MEAS, "ret", "permno", n=10, store=stored).select("Month", "LS"), "LS", digits=12)


def _bin(n: int, part: str, col: str) -> str:
    return f"(row_number() OVER (PARTITION BY {part} ORDER BY {col}, permno) * {n} + count(*) OVER (PARTITION BY {part}) - 1) // count(*) OVER (PARTITION BY {part})"


@query(
    f"WITH {HELD}, ok AS (SELECT * FROM he WHERE isfinite({MEAS}) AND isfinite(cap)), sb AS (SELECT *, {_bin(5, 'Month', 'cap')} AS size_bin FROM ok), b2 AS (SELECT *, {_bin(5, 'Month, size_bin', MEAS)} AS bin FROM sb), {_wide('b2', 'Month, size_bin', 'avg(ret)')} SELECT Month, round(avg(LS), 12) + 0.0 AS LS, count(LS) AS n_size_bins FROM ls GROUP BY 1"
)
def size_neutral_double_sort(spark: SparkSession, d: str) -> DataFrame:
    """Bins within size bins."""
    return rounded(sorts.size_neutral(held(spark, d), ["Month"], "cap", MEAS, "ret", "permno", store=stored), "LS", digits=12)


@query(
    f"WITH {HELD}, ok AS (SELECT * FROM he WHERE isfinite({MEAS}) AND isfinite(cap)), b2 AS (SELECT *, {_bin(3, 'Month', 'cap')}::INTEGER AS char_bin, {_bin(5, 'Month', MEAS)} AS bin FROM ok), {_wide('b2', 'Month, char_bin', 'avg(ret)')} SELECT Month, char_bin, round(LS, 12) + 0.0 AS LS FROM ls"
)
def tercile_quintile_double_sort(spark: SparkSession, d: str) -> DataFrame:
    """Independent double sort."""
    return rounded(sorts.double_sort(held(spark, d), ["Month"], "cap", MEAS, "ret", "permno", store=stored), "LS", digits=12)


@query(
    f"WITH {HELD}, ok AS (SELECT *, round({MEAS} - avg({MEAS}) OVER (PARTITION BY Month, siccd), 9) + 0.0 AS m2 FROM he WHERE isfinite({MEAS}) AND siccd IS NOT NULL), b2 AS (SELECT *, {_bin(5, 'Month', 'm2')} AS bin FROM ok), {_wide('b2', 'Month', 'avg(ret)')} SELECT Month, round(LS, 12) + 0.0 AS LS FROM ls"
)
def industry_neutral_ls(spark: SparkSession, d: str) -> DataFrame:
    """The measure net of its industry. Rounded before ranking, so that sums in another order make the same ties."""
    h = held(spark, d).filter(F.col("siccd").isNotNull() & is_finite(MEAS))
    x = panel.demean(h, ["Month", "siccd"], MEAS, "m2").withColumn("m2", F.round("m2", 9) + F.lit(0.0))
    return rounded(sorts.quantile_sort(x, ["Month"], "m2", "ret", "permno", store=stored).select("Month", "LS"), "LS", digits=12)


@query(
    f"WITH {HELD}, q AS (SELECT Month, quantile_cont(cap, 0.5) AS m FROM he WHERE isfinite(cap) GROUP BY 1), ok AS (SELECT he.*, (cap > m)::INTEGER AS above FROM he JOIN q USING (Month) WHERE isfinite(cap) AND isfinite({MEAS})), b2 AS (SELECT *, {_bin(5, 'Month, above', MEAS)} AS bin FROM ok), {_wide('b2', 'Month, above', 'avg(ret)')} SELECT Month, above, round(LS, 12) + 0.0 AS LS FROM ls"
)
def split_sample(spark: SparkSession, d: str) -> DataFrame:
    """Long-short of large and of small securities."""
    return rounded(sorts.split_sample(held(spark, d), ["Month"], "cap", MEAS, "ret", "permno", store=stored), "LS", digits=12)


@query(
    f"WITH {HELD}, ok AS (SELECT * FROM he WHERE isfinite({MEAS}) AND isfinite(ret)), sd AS (SELECT ok.*, seed FROM ok, range(1, 26) AS r(seed)), b2 AS (SELECT *, (row_number() OVER (PARTITION BY Month, seed ORDER BY {MEAS}, ((permno::BIGINT % 2147483647) * 48271 + seed * 7919) % 104729, permno) * 5 + count(*) OVER (PARTITION BY Month, seed) - 1) // count(*) OVER (PARTITION BY Month, seed) AS bin FROM sd), br AS (SELECT Month, seed, avg(ret) FILTER (bin = 5) - avg(ret) FILTER (bin = 1) AS LS FROM b2 GROUP BY 1, 2) SELECT Month, round(avg(LS), 9) + 0.0 AS LS FROM br GROUP BY 1"
)
def seed_averaged(spark: SparkSession, d: str) -> DataFrame:
    """Random ties, averaged over 25 seeds; the order of a seed is arithmetic here, so that SQL can repeat it."""
    order = lambda seed, by: ((F.col(by).cast("bigint") % 2147483647) * 48271 + seed * 7919) % 104729
    return rounded(sorts.seed_averaged(held(spark, d), ["Month"], MEAS, "ret", "permno", order=order), "LS", digits=9)


RP = f"rp AS (SELECT DISTINCT {RIC} AS ric, CAST(Quarter AS DATE) AS Quarter, QuarterlyRet AS r, Beta_CAPM AS b, MCap_QEnd AS cap FROM panel_ric WHERE {RIC} IS NOT NULL AND isfinite(QuarterlyRet) AND isfinite(Beta_CAPM)), rr AS (SELECT rp.*, CASE WHEN Region = 'North America' THEN 'NorthAmerica' WHEN Region = 'Europe' THEN 'Europe' ELSE 'Other' END AS region FROM rp JOIN exchange_region e ON e.suffix = split_part(ric, '.', 2))"


def ric_panel(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "panel_ric", "Ticker", "Quarter", "QuarterlyRet", "Beta_CAPM", "MCap_QEnd").select(clean_ric("Ticker").alias("ric"), F.col("Quarter").cast("date").alias("Quarter"), F.col("QuarterlyRet").alias("r"), F.col("Beta_CAPM").alias("b"), F.col("MCap_QEnd").alias("cap")).filter(F.col("ric").isNotNull() & is_finite("r") & is_finite("b")).distinct()
    e = table(spark, d, "exchange_region", "suffix", "Region")
    met = p.join(e.withColumnRenamed("Region", "_reg"), F.split_part("ric", F.lit("."), F.lit(2)) == F.col("suffix"))
    return met.withColumn("region", F.when(F.col("_reg") == "North America", "NorthAmerica").when(F.col("_reg") == "Europe", "Europe").otherwise("Other")).drop("_reg", "suffix")


@query(f"WITH {RP}, x AS (SELECT Quarter, region, avg(r) AS LS FROM rr GROUP BY 1, 2) SELECT Quarter, round(avg(LS), 12) + 0.0 AS LS FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT region) FROM x)")
def region_composite(spark: SparkSession, d: str) -> DataFrame:
    """Composite over regions, in quarters that have them all."""
    x = ric_panel(spark, d).groupBy("Quarter", "region").agg(F.avg("r").alias("LS"))
    return rounded(sorts.composite(x, "Quarter", "region", "LS"), "LS", digits=12)


TURN = f"{SORT}, me AS (SELECT DISTINCT Month, permno FROM bn WHERE bin = 5), pm AS (SELECT Month, lag(Month) OVER (ORDER BY Month) AS prev FROM (SELECT DISTINCT Month FROM me)), tu AS (SELECT me.Month, count(*) AS n, count(*) FILTER (m2.permno IS NULL) AS n_new, any_value(prev) AS prev FROM me JOIN pm USING (Month) LEFT JOIN me m2 ON m2.Month = prev AND m2.permno = me.permno GROUP BY 1)"


@query(f"WITH {TURN} SELECT Month, n, n_new, CASE WHEN prev IS NOT NULL THEN round(n_new / n, 6) + 0.0 END AS turnover FROM tu")
def turnover_prev_month(spark: SparkSession, d: str) -> DataFrame:
    """New names of the top quintile."""
    b = panel.bins(stored(held(spark, d).filter(is_finite(MEAS)).select("Month", "permno", MEAS)), ["Month"], MEAS, 5, "first", "permno").filter("bin = 5")
    return rounded(panel.turnover(b, "Month", "permno"), "turnover")


@query(f"WITH {TURN}, {_wide('bn', 'Month', 'avg(ret)')} SELECT Month, round(LS - 2 * n_new / n * 10 / 10000, 12) + 0.0 AS net_10, round(LS - 2 * n_new / n * 25 / 10000, 12) + 0.0 AS net_25, round(LS - 2 * n_new / n * 50 / 10000, 12) + 0.0 AS net_50, CASE WHEN n_new > 0 THEN round(LS * 10000 / (2 * n_new / n), 8) + 0.0 END AS breakeven_bps FROM ls JOIN tu USING (Month) WHERE prev IS NOT NULL")
def cost_net_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns after a grid of costs, and the break-even cost."""
    h = held(spark, d)
    ls = sorts.quantile_sort(h, ["Month"], MEAS, "ret", "permno", store=stored).select("Month", "LS")
    b = panel.bins(stored(h.filter(is_finite(MEAS)).select("Month", "permno", MEAS)), ["Month"], MEAS, 5, "first", "permno").filter("bin = 5")
    x = sorts.net_of_costs(ls.join(panel.turnover(b, "Month", "permno").filter("turnover IS NOT NULL"), "Month"), "LS", "turnover")
    return rounded(x.select("Month", "net_10", "net_25", "net_50", "breakeven_bps"), "net_10", "net_25", "net_50", digits=12).withColumn("breakeven_bps", F.round("breakeven_bps", 8) + F.lit(0.0))


@query(f"WITH {MRET}, x AS (SELECT *, row_number() OVER (PARTITION BY Month ORDER BY cap DESC NULLS LAST) AS k FROM mr WHERE cap > 0), q AS (SELECT Month, quantile_cont(cap, 0.5) AS ref FROM x WHERE k <= 500 GROUP BY 1) SELECT permno, Month, CASE WHEN cap > 0 THEN round(least(5 + 5 * sqrt(ref / cap), 150), 6) + 0.0 END AS cost_bps FROM mr LEFT JOIN q USING (Month) WHERE cap > 0")
def cap_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost that falls with market value."""
    x = sorts.cap_costs(monthly(spark, d).filter("cap > 0"), ["Month"], "cap")
    return rounded(x.select("permno", "Month", "cost_bps"), "cost_bps")


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')} SELECT count(LS) AS n, round(avg(LS) * 12, 6) + 0.0 AS mean_year, round(stddev_samp(LS) * sqrt(12), 6) + 0.0 AS vol_year, round(avg(LS) / stddev_samp(LS) * sqrt(12), 6) + 0.0 AS sharpe, round(avg((LS > 0)::INTEGER), 6) + 0.0 AS share_positive FROM ls")
def sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Performance of the long-short series."""
    ls = sorts.quantile_sort(held(spark, d), ["Month"], MEAS, "ret", "permno", store=stored)
    return rounded(sorts.performance(ls, "LS"), "mean_year", "vol_year", "sharpe", "share_positive")


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')}, mk AS (SELECT Month, avg(ret) AS mkt FROM mr GROUP BY 1), b AS (SELECT Month, LS, mkt FROM ls JOIN mk USING (Month) WHERE LS IS NOT NULL), g AS (SELECT Month, exp(sum(ln(1 + LS)) OVER w) AS LS, exp(sum(ln(1 + mkt)) OVER w) AS mkt FROM b WINDOW w AS (ORDER BY Month)) SELECT Month, round(LS, 6) + 0.0 AS LS, round(mkt, 6) + 0.0 AS mkt FROM g UNION ALL SELECT CAST(min(Month) - INTERVAL 1 MONTH AS DATE), 1.0::DOUBLE, 1.0::DOUBLE FROM b")
def growth_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Growth of the strategy and of the market on common months."""
    ls = sorts.quantile_sort(held(spark, d), ["Month"], MEAS, "ret", "permno", store=stored)
    mk = monthly(spark, d).groupBy("Month").agg(F.avg("ret").alias("mkt"))
    return rounded(sorts.growth_comparison(ls, mk, "Month", "LS", "mkt"), "LS", "mkt")


_SUM = " UNION ALL ".join(f"SELECT '{m}' AS measure, count({FIN(m)}) AS n, round(avg({FIN(m)}), 6) + 0.0 AS mean, round(stddev_samp({FIN(m)}), 6) + 0.0 AS sd, round(quantile_cont({FIN(m)}, 0.1), 6) + 0.0 AS p10, round(quantile_cont({FIN(m)}, 0.5), 6) + 0.0 AS median, round(quantile_cont({FIN(m)}, 0.9), 6) + 0.0 AS p90, round(avg(({FIN(m)} > 0)::INTEGER), 6) + 0.0 AS share_positive FROM fq" for m in ("GeoExposure", "GeoRisk", "GeoSentiment"))


@query(f"WITH {FQ} {_SUM}")
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Table of summary statistics."""
    return rounded(sorts.summary(firm_quarters(spark, d), ["GeoExposure", "GeoRisk", "GeoSentiment"]), "mean", "sd", "p10", "median", "p90", "share_positive")


@query(f"WITH {HELD}, ok AS (SELECT * FROM he WHERE isfinite(GeoExposure)), b2 AS (SELECT *, {_bin(20, 'Month', 'GeoExposure')}::INTEGER AS bin FROM ok) SELECT bin, round(avg(GeoExposure), 6) + 0.0 AS x, round(avg(ret), 6) + 0.0 AS y, count(*) AS n FROM b2 GROUP BY 1")
def binscatter(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-bin scatter."""
    return rounded(sorts.binscatter(held(spark, d), ["Month"], "GeoExposure", "ret", "permno", store=stored), "x", "y")


@query(f"WITH {FQ}, x AS (SELECT *, year(form)::INTEGER AS yr FROM fq) SELECT CASE WHEN siccd < 1000 THEN 'Agriculture' WHEN siccd < 1500 THEN 'Mining' WHEN siccd < 1800 THEN 'Construction' WHEN siccd < 4000 THEN 'Manufacturing' WHEN siccd < 5000 THEN 'Transport/Utilities' WHEN siccd < 5200 THEN 'Wholesale' WHEN siccd < 6000 THEN 'Retail' WHEN siccd < 6800 THEN 'Finance' WHEN siccd < 9000 THEN 'Services' WHEN siccd IS NOT NULL THEN 'Public Admin.' END AS row, yr AS column, round(avg({FIN('GeoExposure')}) * 1000, 6) + 0.0 AS value, count({FIN('GeoExposure')}) AS n FROM x GROUP BY 1, 2")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Division by year."""
    return rounded(sorts.heatmap(firm_quarters(spark, d), sic_division("siccd"), F.year("form"), "GeoExposure"), "value")


@query("WITH e AS (SELECT *, permno IS NOT NULL AS a, known_ts IS NOT NULL AS b, coalesce(isfinite(GeoRisk), false) AS c, siccd IS NOT NULL AS s FROM exposure_firmquarter_crsp) SELECT * FROM (SELECT 1 AS step, 'permno' AS label, count(*) AS n_rows, count(DISTINCT permno) AS n_firms FROM e WHERE a UNION ALL SELECT 2, 'known', count(*), count(DISTINCT permno) FROM e WHERE a AND b UNION ALL SELECT 3, 'measure', count(*), count(DISTINCT permno) FROM e WHERE a AND b AND c UNION ALL SELECT 4, 'industry', count(*), count(DISTINCT permno) FROM e WHERE a AND b AND c AND s)")
def sample_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows and firms after each step of the selection."""
    e = table(spark, d, "exposure_firmquarter_crsp", "permno", "known_ts", "GeoRisk", "siccd")
    return sorts.funnel(e, [("permno", F.col("permno").isNotNull()), ("known", F.col("known_ts").isNotNull()), ("measure", is_finite("GeoRisk")), ("industry", F.col("siccd").isNotNull())], "permno")


AGG = f"{FQ}, sr AS (SELECT form, avg({FIN('GeoExposure')}) AS e, avg({FIN('GeoRisk')}) AS r FROM fq GROUP BY 1)"


@query(f"WITH {AGG}, l AS (SELECT form, 'e' AS series, e AS v FROM sr UNION ALL SELECT form, 'r', r FROM sr) SELECT form, series, round((v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series), 6) + 0.0 AS z FROM l")
def standardized_series(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate series standardised over time."""
    s = firm_quarters(spark, d).groupBy("form").agg(F.avg(finite("GeoExposure")).alias("e"), F.avg(finite("GeoRisk")).alias("r"))
    return rounded(sorts.standardize(s, ["e", "r"], "form"), "z")
