"""Queries on regressions, series, event studies, agreement and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite, is_finite
from ..operators import events, regress, series, sorts, validate
from ..sources.tables import table
from .panel_queries import EVM, FQ, HELD, MRET, SORT, _wide, daily, firm_quarters, held, monthly
from .storage import stored
from .registry import SQL, query, r6, rounded
from .text_queries import _tail, detected_language

LEAST = 30


@query(f"WITH {HELD}, g AS (SELECT Month, count(*) AS n, regr_intercept(ret, GeoExposure) AS a, regr_slope(ret, GeoExposure) AS b, regr_r2(ret, GeoExposure) AS r2 FROM he WHERE isfinite(GeoExposure) GROUP BY 1 HAVING count(*) >= {LEAST}) SELECT Month, n, round(a, 6) + 0.0 AS intercept, round(b, 6) + 0.0 AS slope, round(r2, 6) + 0.0 AS r2 FROM g")
def grouped_slope(spark: SparkSession, d: str) -> DataFrame:
    """One regression per month."""
    x = regress.slopes(held(spark, d), ["Month"], "ret", "GeoExposure", LEAST)
    return rounded(x.select("Month", "n", "intercept", "slope", "r2"), "intercept", "slope", "r2")


def _nw(src: str, order: str, x: str, lags: int, by: str = "") -> str:
    """CTEs up to nw (by, n, mean, t)."""
    part = f"PARTITION BY {by} " if by else ""
    b = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    total = "g0 + " + " + ".join(f"2 * {1 - k / (lags + 1)!r} * coalesce(g{k}, 0)" for k in range(1, lags + 1))
    ls = ", ".join(f"sum(e * lag_{k}) AS g{k}" for k in range(1, lags + 1))
    la = ", ".join(f"lag(e, {k}) OVER ({part}ORDER BY {order}) AS lag_{k}" for k in range(1, lags + 1))
    return f"""nd AS (SELECT {b}{order}, {x} AS x, {x} - avg({x}) OVER ({part.strip()}) AS e FROM {src} WHERE {x} IS NOT NULL), nl AS (SELECT *, {la} FROM nd), ns AS (SELECT {b}avg(x) AS mean, count(*) AS n, sum(e * e) AS g0, {ls} FROM nl{grp}),
nw AS (SELECT {b}n, mean, CASE WHEN {total} > 0 AND n > 1 THEN mean / sqrt(({total}) / n / n * n / (n - 1)) END AS t FROM ns)"""


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')}, {_nw('ls', 'Month', 'LS', 4)} SELECT n, round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t FROM nw")
def mean_newey_west(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the long-short series with its HAC t."""
    ls = sorts.quantile_sort(held(spark, d), ["Month"], "GeoRisk", "ret", "permno", store=stored)
    x = series.mean_newey_west(ls, [], "Month", "LS", 4)
    return x.select("n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


@query(
    f"WITH {HELD}, ok AS (SELECT * FROM he WHERE isfinite(GeoExposure)), z AS (SELECT Month, ret, (GeoExposure - avg(GeoExposure) OVER (PARTITION BY Month)) / stddev_samp(GeoExposure) OVER (PARTITION BY Month) AS z FROM ok), sl AS (SELECT Month, regr_slope(ret, z) AS b FROM z GROUP BY 1 HAVING count(z) >= {LEAST}), {_nw('sl', 'Month', 'b', 4)} SELECT n, round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t FROM nw"
)
def fama_macbeth(spark: SparkSession, d: str) -> DataFrame:
    """E5: mean slope of monthly regressions on the standardised exposure, HAC t."""
    x = regress.fama_macbeth(held(spark, d), "Month", "ret", ["GeoExposure"], 4, LEAST)
    return x.select("n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    parts = []
    for j, x in enumerate(m[0]):
        minor = [[v for i, v in enumerate(row) if i != j] for row in m[1:]]
        parts.append(f"{'-' if j % 2 else '+'} ({x}) * ({_det(minor)})")
    return " ".join(parts)


def _solution(c: list[list[str]], y: list[str]) -> list[str]:
    """SQL of the solution of a linear system, by determinants."""
    whole = _det(c)
    return [f"(({_det([[y[r] if j == i else v for j, v in enumerate(row)] for r, row in enumerate(c)])}) / nullif(({whole}), 0))" for i in range(len(y))]


def _moments(y: str, xs: list[str]) -> str:
    """SQL aggregates c<i>_<j> and cy<i>: population covariances."""
    k = range(len(xs))
    return ", ".join([f"covar_pop({xs[i]}, {xs[j]}) AS c{i}_{j}" for i in k for j in k if j <= i] + [f"covar_pop({y}, {xs[i]}) AS cy{i}" for i in k])


def _slopes(k: int) -> list[str]:
    return _solution([[f"c{max(i, j)}_{min(i, j)}" for j in range(k)] for i in range(k)], [f"cy{i}" for i in range(k)])


def _z(c: str) -> str:
    f = f"CASE WHEN isfinite({c}) THEN {c} END"
    return f"({f} - avg({f}) OVER (PARTITION BY Month)) / nullif(stddev_samp({f}) OVER (PARTITION BY Month), 0)"


CONTROLS = ["GeoExposure", "GeoRisk", "GeoSentiment"]


def _fm(src: str, y: str, xs: list[str]) -> str:
    """CTEs up to nw: Fama-MacBeth of y on standardised xs of src."""
    z = ", ".join(f"{_z(x)} AS z{i}" for i, x in enumerate(xs))
    ok = " AND ".join([f"isfinite({y})", *[f"z{i} IS NOT NULL" for i in range(len(xs))]])
    long = " UNION ALL ".join(f"SELECT Month, '{x}' AS regressor, b{i} AS b FROM sl" for i, x in enumerate(xs))
    slopes = ", ".join(f"{b} AS b{i}" for i, b in enumerate(_slopes(len(xs))))
    return f"zs AS (SELECT Month, {y}, {z} FROM {src}), zo AS (SELECT * FROM zs WHERE {ok}), mo AS (SELECT Month, {_moments(y, [f'z{i}' for i in range(len(xs))])} FROM zo GROUP BY 1 HAVING count(*) >= {LEAST}), sl AS (SELECT Month, {slopes} FROM mo), lg AS ({long}), {_nw('lg', 'Month', 'b', 4, 'regressor')}"


@query(f"WITH {HELD}, {_fm('he', 'ret', CONTROLS)} SELECT regressor, n, round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t FROM nw")
def fama_macbeth_controls(spark: SparkSession, d: str) -> DataFrame:
    """E5: with three regressors, solved in batches."""
    x = regress.fama_macbeth(held(spark, d), "Month", "ret", CONTROLS, 4, LEAST)
    return x.select("regressor", "n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


LAGGED = f"{HELD}, lr AS (SELECT permno, Month AS m0, ret AS last FROM mr), hl AS (SELECT he.*, last FROM he LEFT JOIN lr ON lr.permno = he.permno AND lr.m0 + INTERVAL 1 MONTH = he.Month)"


@query(f"WITH {LAGGED}, {_fm('hl', 'ret', ['GeoExposure', 'last'])} SELECT regressor, n, round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t FROM nw")
def pead_control(spark: SparkSession, d: str) -> DataFrame:
    """Fama-MacBeth with the return of the month before as a control, which a gap leaves null."""
    last = monthly(spark, d).select("permno", F.add_months("Month", 1).alias("Month"), F.col("ret").alias("last"))
    x = regress.fama_macbeth(held(spark, d).join(last, ["permno", "Month"], "left"), "Month", "ret", ["GeoExposure", "last"], 4, LEAST)
    return x.select("regressor", "n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


def factor_series(spark: SparkSession, d: str) -> DataFrame:
    """(Month, LS, mkt, smb): the long-short series, the mean return, small minus large."""
    h = held(spark, d)
    ls = sorts.quantile_sort(h, ["Month"], "GeoRisk", "ret", "permno", store=stored).select("Month", "LS")
    m = monthly(spark, d)
    mk = m.groupBy("Month").agg(F.avg("ret").alias("mkt"))
    smb = sorts.quantile_sort(m, ["Month"], "cap", "ret", "permno", n=3, store=stored).select("Month", (-F.col("LS")).alias("smb"))
    return ls.join(mk, "Month").join(smb, "Month")


SERIES = f"{SORT}, {_wide('bn', 'Month', 'avg(ret)')}, mkt AS (SELECT Month, avg(ret) AS mkt FROM mr GROUP BY 1), cb AS (SELECT *, (row_number() OVER (PARTITION BY Month ORDER BY cap, permno) * 3 + count(*) OVER (PARTITION BY Month) - 1) // count(*) OVER (PARTITION BY Month) AS bin FROM mr WHERE isfinite(cap)), sm AS (SELECT Month, avg(ret) FILTER (bin = 1) - avg(ret) FILTER (bin = 3) AS smb FROM cb GROUP BY 1), fs AS (SELECT Month, LS, mkt, smb FROM ls JOIN mkt USING (Month) JOIN sm USING (Month) WHERE LS IS NOT NULL AND mkt IS NOT NULL AND smb IS NOT NULL)"


def _hac_t(name: str, src: str, b: str, r: str, k: int, lags: int = 4) -> str:
    """CTEs up to t<name> (t, n): HAC t of coefficient b, with r what is left of its regressor after the others and e the residual of src."""
    ls = ", ".join(f"sum(u * l{i}) AS g{i}" for i in range(1, lags + 1))
    la = ", ".join(f"lag(u, {i}) OVER (ORDER BY Month) AS l{i}" for i in range(1, lags + 1))
    total = "g0 + " + " + ".join(f"2 * {1 - i / (lags + 1)!r} * coalesce(g{i}, 0)" for i in range(1, lags + 1))
    return f"u{name} AS (SELECT Month, ({r}) AS r, ({r}) * e AS u, {b} AS b FROM {src}), v{name} AS (SELECT *, {la} FROM u{name}), w{name} AS (SELECT any_value(b) AS b, count(*) AS n, sum(r * r) AS rr, sum(u * u) AS g0, {ls} FROM v{name}), t{name} AS (SELECT b, b / sqrt(({total}) / (rr * rr) * n / (n - {k})) AS t, n FROM w{name})"


_SPAN = f"""{SERIES}, mm AS (SELECT avg(LS) AS my, avg(mkt) AS m0, avg(smb) AS m1, {_moments("LS", ["mkt", "smb"])}, count(*) AS n, sum(mkt * mkt) AS q00, sum(mkt * smb) AS q01, sum(smb * smb) AS q11, sum(mkt) AS s0, sum(smb) AS s1 FROM fs),
bb AS (SELECT *, {_slopes(2)[0]} AS b0, {_slopes(2)[1]} AS b1, {_solution([["q00", "q01"], ["q01", "q11"]], ["s0", "s1"])[0]} AS a0, {_solution([["q00", "q01"], ["q01", "q11"]], ["s0", "s1"])[1]} AS a1 FROM mm),
ee AS (SELECT fs.*, bb.*, my - b0 * m0 - b1 * m1 AS alpha, LS - (my - b0 * m0 - b1 * m1) - b0 * mkt - b1 * smb AS e FROM fs, bb)"""
_TS = ", ".join([_hac_t("a", "ee", "alpha", "1 - a0 * mkt - a1 * smb", 3), _hac_t("m", "ee", "b0", "(mkt - m0) - c1_0 / c1_1 * (smb - m1)", 3), _hac_t("s", "ee", "b1", "(smb - m1) - c1_0 / c0_0 * (mkt - m0)", 3)])


@query(
    f"WITH {_SPAN}, {_TS}, r2 AS (SELECT 1 - sum(e * e) / sum((LS - my) * (LS - my)) AS r2 FROM ee) SELECT stat, round(value, 6) + 0.0 AS value FROM (SELECT 'alpha' AS stat, b AS value FROM ta UNION ALL SELECT 't', t FROM ta UNION ALL SELECT 'r2', r2 FROM r2 UNION ALL SELECT 'n', n FROM ta UNION ALL SELECT 'beta_mkt', b FROM tm UNION ALL SELECT 't_mkt', t FROM tm UNION ALL SELECT 'beta_smb', b FROM ts UNION ALL SELECT 't_smb', t FROM ts)"
)
def factor_spanning(spark: SparkSession, d: str) -> DataFrame:
    """Alpha and loadings of the long-short series on two factors, HAC t."""
    out = series.spanning(series.local(factor_series(spark, d), "Month"), "LS", ["mkt", "smb"], 4)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in out.items()], "stat string, value double"), "value")


_UNI = ", ".join(f"x{f} AS (SELECT Month, LS, {f} AS x, avg(LS) OVER () AS my, avg({f}) OVER () AS mx, covar_pop(LS, {f}) OVER () / var_pop({f}) OVER () AS b FROM fs), e{f} AS (SELECT Month, x - mx AS d, b, (LS - my) - b * (x - mx) AS e FROM x{f}), {_hac_t(f, f'e{f}', 'b', 'd', 2)}" for f in ("mkt", "smb"))


@query(f"WITH {SERIES}, {_UNI} SELECT 'mkt' AS factor, round(b, 6) + 0.0 AS beta, round(t, 4) + 0.0 AS t, n FROM tmkt UNION ALL SELECT 'smb', round(b, 6) + 0.0, round(t, 4) + 0.0, n FROM tsmb")
def factor_loadings(spark: SparkSession, d: str) -> DataFrame:
    """The loading on each factor alone."""
    out = series.loadings(series.local(factor_series(spark, d), "Month"), "LS", ["mkt", "smb"])
    x = spark.createDataFrame([(f, float(b), float(t), int(n)) for f, b, t, n in out.itertuples(index=False)], "factor string, beta double, t double, n bigint")
    return x.select("factor", r6("beta").alias("beta"), (F.round("t", 4) + F.lit(0.0)).alias("t"), "n")


_PRE = "ORDER BY Month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_WIN = ", ".join(f"{x.rsplit(' AS ', 1)[0]} OVER ({_PRE}) AS {x.rsplit(' AS ', 1)[1]}" for x in _moments("LS", ["mkt", "smb"]).split(", c") for x in [x if x.startswith("covar") else "c" + x])
WALK = f"{SERIES}, wa AS (SELECT Month, LS, mkt, smb, row_number() OVER (ORDER BY Month) AS i, {_WIN} FROM fs), oo AS (SELECT Month, LS - {_slopes(2)[0]} * mkt - {_slopes(2)[1]} * smb AS oos FROM wa WHERE i > 36)"


@query(f"WITH {WALK} SELECT CAST(Month AS VARCHAR) AS month, round(oos, 6) + 0.0 AS oos FROM oo")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Returns less the factor part that earlier months imply."""
    f = series.walk_forward(series.local(factor_series(spark, d), "Month"), "LS", ["mkt", "smb"], 36)
    rows = [(str(r.Month), float(r.oos)) for r in f.itertuples() if r.oos == r.oos]
    return rounded(spark.createDataFrame(rows, "month string, oos double"), "oos")


@query(f"WITH {WALK}, {_nw('oo', 'Month', 'oos', 4)} SELECT n, round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t FROM nw")
def walk_forward_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the walk-forward series with its HAC t."""
    x = series.mean_newey_west(walk_forward(spark, d), [], "month", "oos", 4)
    return x.select("n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


@query(f"WITH {SERIES}, ye AS (SELECT DISTINCT year(Month)::INTEGER AS through FROM fs), pr AS (SELECT through, avg(LS) AS my, avg(mkt) AS m0, avg(smb) AS m1, {_moments('LS', ['mkt', 'smb'])}, count(*) AS n FROM ye JOIN fs ON year(Month) <= through GROUP BY 1 HAVING count(*) >= 36) SELECT through, n, round(my - {_slopes(2)[0]} * m0 - {_slopes(2)[1]} * m1, 6) + 0.0 AS alpha FROM pr")
def expanding_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Alpha of all months up to each year's end."""
    out = series.expanding_alpha(series.local(factor_series(spark, d), "Month"), "Month", "LS", ["mkt", "smb"])
    return rounded(spark.createDataFrame([(int(y), int(n), float(a)) for y, n, a, _ in out.itertuples(index=False)], "through int, n bigint, alpha double"), "alpha")


@query()
def panel_fe_twoway(spark: SparkSession, d: str) -> DataFrame:
    """Firm and month effects, errors clustered by both."""
    out = regress.two_way_fe(held(spark, d), "permno", "Month", "ret", ["GeoExposure", "GeoSentiment"], store=stored)
    return spark.createDataFrame([(x, v["b"], v["t"], v["n"]) for x, v in out.items()], "regressor string, b double, t double, n bigint")


@query(
    f"WITH {HELD}, ok AS (SELECT permno, Month, ret, GeoExposure AS x0, GeoSentiment AS x1 FROM he WHERE isfinite(ret) AND isfinite(GeoExposure) AND isfinite(GeoSentiment)), dm AS (SELECT permno, ret - avg(ret) OVER w AS y, x0 - avg(x0) OVER w AS x0, x1 - avg(x1) OVER w AS x1 FROM ok WINDOW w AS (PARTITION BY Month)), sm AS (SELECT sum(x0 * x0) AS c0_0, sum(x1 * x0) AS c1_0, sum(x1 * x1) AS c1_1, sum(y * x0) AS cy0, sum(y * x1) AS cy1, count(*) AS n FROM dm), be AS (SELECT *, {_slopes(2)[0]} AS b0, {_slopes(2)[1]} AS b1, c0_0 * c1_1 - c1_0 * c1_0 AS det, (SELECT count(DISTINCT Month) FROM ok) AS np FROM sm), u AS (SELECT permno, sum(dm.x0 * (y - b0 * dm.x0 - b1 * dm.x1)) AS u0, sum(dm.x1 * (y - b0 * dm.x0 - b1 * dm.x1)) AS u1 FROM dm, be GROUP BY 1), me AS (SELECT count(*) AS g, sum(u0 * u0) AS s00, sum(u0 * u1) AS s01, sum(u1 * u1) AS s11 FROM u), fa AS (SELECT *, g::DOUBLE / (g - 1) * (n - 1) / (n - 2 - np) AS f FROM me, be) SELECT 'GeoExposure' AS regressor, round(b0, 6) + 0.0 AS b, round(b0 / sqrt(f * (c1_1 * c1_1 * s00 - 2 * c1_1 * c1_0 * s01 + c1_0 * c1_0 * s11) / det / det), 4) + 0.0 AS t, n FROM fa UNION ALL SELECT 'GeoSentiment', round(b1, 6) + 0.0, round(b1 / sqrt(f * (c1_0 * c1_0 * s00 - 2 * c1_0 * c0_0 * s01 + c0_0 * c0_0 * s11) / det / det), 4) + 0.0, n FROM fa"
)
def panel_fe_time(spark: SparkSession, d: str) -> DataFrame:
    """Month effects only, errors clustered by firm."""
    x = regress.time_fe(held(spark, d), "permno", "Month", "ret", ["GeoExposure", "GeoSentiment"])
    return x.select("regressor", r6("b").alias("b"), (F.round("t", 4) + F.lit(0.0)).alias("t"), "n")


@query(f"WITH {MRET}, lg AS (SELECT *, CASE WHEN lag(Month) OVER w + INTERVAL 1 MONTH = Month THEN lag(ret) OVER w END AS prev FROM mr WINDOW w AS (PARTITION BY permno ORDER BY Month)), pb AS (SELECT Month, ret, (row_number() OVER (PARTITION BY Month ORDER BY prev, permno) * 5 + count(*) OVER (PARTITION BY Month) - 1) // count(*) OVER (PARTITION BY Month) AS bin FROM lg WHERE prev IS NOT NULL) SELECT Month, round(avg(ret) FILTER (bin = 1) - avg(ret) FILTER (bin = 5), 12) + 0.0 AS REV FROM pb GROUP BY 1 HAVING avg(ret) FILTER (bin = 1) - avg(ret) FILTER (bin = 5) IS NOT NULL")
def reversal_factor(spark: SparkSession, d: str) -> DataFrame:
    """Losers minus winners of the month before."""
    return rounded(sorts.reversal(monthly(spark, d), "permno", "Month", "ret", store=stored), "REV", digits=12)


NAMED = f"""nq AS (SELECT permno, CAST(date_trunc('quarter', Month) AS DATE) AS Quarter, product(1 + ret) - 1 AS r1 FROM mr GROUP BY 1, 2 HAVING count(ret) >= 3), nm AS (SELECT upper(trim(comnam)) AS name, min(permno) AS permno FROM crsp_names WHERE permno IS NOT NULL AND comnam IS NOT NULL GROUP BY 1 HAVING count(DISTINCT permno) = 1),
pn AS (SELECT upper(trim(companyName)) AS name, CAST(Quarter AS DATE) AS Quarter, min(QuarterlyRet) AS r2, min(MCap_QEnd) FILTER (isfinite(MCap_QEnd)) AS size FROM panel_ric WHERE companyName IS NOT NULL AND isfinite(QuarterlyRet) GROUP BY 1, 2),
bo AS (SELECT permno, Quarter, any_value(r1) AS r1, min(r2) AS r2, min(size) AS size FROM pn JOIN nm USING (name) JOIN nq USING (permno, Quarter) GROUP BY 1, 2), bz AS (SELECT *, (row_number() OVER (PARTITION BY Quarter ORDER BY size, permno) * 3 + count(*) OVER (PARTITION BY Quarter) - 1) // count(*) OVER (PARTITION BY Quarter) AS bin FROM bo WHERE size IS NOT NULL)"""


@query(f"WITH {MRET}, {NAMED} SELECT Quarter, round(avg(r1) FILTER (bin = 3) - avg(r1) FILTER (bin = 1), 9) + 0.0 AS first, round(avg(r2) FILTER (bin = 3) - avg(r2) FILTER (bin = 1), 9) + 0.0 AS second, count(*) AS n, round(avg(r1) FILTER (bin = 3) - avg(r1) FILTER (bin = 1) - (avg(r2) FILTER (bin = 3) - avg(r2) FILTER (bin = 1)), 9) + 0.0 AS gap FROM bz GROUP BY 1")
def source_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The same firms' long-short by two vendors' returns; firms are matched by a name that only one security has."""
    from ..operators import panel

    m = monthly(spark, d)
    nq = panel.quarterly(m, "permno", "Month", "ret", "cap", 3).select("permno", "Quarter", F.col("RetQ").alias("r1"))
    nm = table(spark, d, "crsp_names", "permno", "comnam").filter("permno IS NOT NULL AND comnam IS NOT NULL").groupBy(F.upper(F.trim("comnam")).alias("name")).agg(F.min("permno").alias("permno"), F.countDistinct("permno").alias("k")).filter("k = 1").drop("k")
    p = table(spark, d, "panel_ric", "companyName", "Quarter", "QuarterlyRet", "MCap_QEnd").filter(F.col("companyName").isNotNull() & is_finite("QuarterlyRet"))
    pn = p.groupBy(F.upper(F.trim("companyName")).alias("name"), F.col("Quarter").cast("date").alias("Quarter")).agg(F.min("QuarterlyRet").alias("r2"), F.min(finite("MCap_QEnd")).alias("size"))
    both = pn.join(nm, "name").join(nq, ["permno", "Quarter"]).groupBy("permno", "Quarter").agg(F.min("r1").alias("r1"), F.min("r2").alias("r2"), F.min("size").alias("size"))
    return rounded(sorts.reconcile(both, "Quarter", "size", "r1", "r2", "permno", 3, store=stored).select("Quarter", "first", "second", "n", "gap"), "first", "second", "gap", digits=9)


MK = f"{MRET}, mk AS (SELECT Month, avg(ret) AS mkt FROM mr GROUP BY 1), jm AS (SELECT mr.*, mkt FROM mr JOIN mk USING (Month))"


@query(
    f"WITH {MK}, m AS (SELECT *, avg(ret) OVER (PARTITION BY permno) AS mr0, avg(mkt) OVER (PARTITION BY permno) AS mm0, avg(mkt) OVER () AS gm FROM jm), g AS (SELECT permno, count(*) AS n, regr_slope(ret, mkt) AS beta, CASE WHEN var_samp(mkt) FILTER (mkt < gm) > 0 THEN covar_samp(ret, mkt) FILTER (mkt < gm) / var_samp(mkt) FILTER (mkt < gm) END AS dn, avg((ret - mr0) * (mkt - mm0) * (mkt - mm0)) / nullif(stddev_samp(ret), 0) / nullif(var_samp(mkt), 0) AS ck FROM m GROUP BY 1 HAVING count(*) >= 24) SELECT permno, n, round(beta, 4) + 0.0 AS beta, round(dn, 4) + 0.0 AS downside_beta, round(ck, 4) + 0.0 AS coskew FROM g"
)
def downside_beta(spark: SparkSession, d: str) -> DataFrame:
    """Beta in months below the mean market return of the whole sample, and co-skewness."""
    m = monthly(spark, d)
    x = regress.downside_beta(m.join(m.groupBy("Month").agg(F.avg("ret").alias("mkt")), "Month"), ["permno"], "ret", "mkt", 24)
    return x.select("permno", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("beta", "downside_beta", "coskew")])


@query(f"WITH {MK}, g AS (SELECT permno, count(*) AS n, regr_slope(ret, mkt) AS b, regr_syy(ret, mkt) AS yy, regr_sxy(ret, mkt) AS xy FROM jm GROUP BY 1 HAVING count(*) >= 12) SELECT permno, n, round(sqrt(greatest(yy - b * xy, 0) / (n - 1)), 6) + 0.0 AS ivol FROM g")
def idiosyncratic_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Standard deviation of the residuals (n - 1)."""
    m = monthly(spark, d)
    x = regress.slopes(m.join(m.groupBy("Month").agg(F.avg("ret").alias("mkt")), "Month"), ["permno"], "ret", "mkt", 12)
    return x.select("permno", "n", r6("resid_sd").alias("ivol"))


LIQ = "li AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m, avg(CASE WHEN l_extendedprice * l_quantity > 0 THEN abs(l_discount) / (l_extendedprice * l_quantity) END) * 1e6 AS illiq, count(CASE WHEN l_extendedprice * l_quantity > 0 THEN l_discount END) AS n_days FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {LIQ} SELECT l_suppkey, m, round(illiq, 6) + 0.0 AS illiq, n_days FROM li WHERE n_days >= 10")
def amihud_illiquidity(spark: SparkSession, d: str) -> DataFrame:
    """Price impact by supplier and month of the line items (rate, price and quantity as return, price and volume)."""
    x = table(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_discount", "l_extendedprice", "l_quantity").withColumn("m", F.trunc(F.col("l_shipdate").cast("date"), "month"))
    y = regress.illiquidity(x, ["l_suppkey", "m"], "l_discount", "l_extendedprice", "l_quantity", 10)
    return y.select("l_suppkey", "m", r6(F.col("illiq") * 1e6).alias("illiq"), "n_days")


# event studies: a user's daily series, purchases as events

IX = f"{EVM}, mkt AS (SELECT day, avg(ret) AS m FROM dy GROUP BY 1), ix AS (SELECT dy.user_id, dy.day, ret, m, row_number() OVER (PARTITION BY dy.user_id ORDER BY dy.day) AS ti FROM dy JOIN mkt USING (day)), pe AS (SELECT event_id, user_id, day, value FROM ev WHERE event_type = 'purchase')"
ANC = f"{IX}, t0 AS (SELECT event_id, pe.user_id, arg_min(ti, ix.day) AS t0 FROM pe JOIN ix ON ix.user_id = pe.user_id AND ix.day BETWEEN pe.day AND pe.day + 7 GROUP BY 1, 2), mx AS (SELECT user_id, max(ti) AS nmax FROM ix GROUP BY 1), an AS (SELECT event_id, user_id, t0 FROM t0 JOIN mx USING (user_id) WHERE t0 - 12 >= 1 AND t0 + 2 <= nmax)"
MOD = f"{ANC}, es AS (SELECT event_id, count(*) AS n, regr_intercept(ret, m) AS alpha, regr_slope(ret, m) AS beta FROM an JOIN ix ON ix.user_id = an.user_id AND ix.ti BETWEEN t0 - 12 AND t0 - 4 GROUP BY 1 HAVING count(*) >= 3)"
ARS = f"{MOD}, ar AS (SELECT event_id, ix.ti - t0 AS k, ret - alpha - beta * m AS ar FROM an JOIN ix ON ix.user_id = an.user_id AND ix.ti BETWEEN t0 - 2 AND t0 + 2 JOIN es USING (event_id))"


def study(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, indexed days, purchases)"""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts").withColumn("day", F.col("ts").cast("date"))
    x = daily(spark, d)
    x = x.join(x.groupBy("day").agg(F.avg("ret").alias("m")), "day")
    ix = events.trading_index(x, "user_id", "day")
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "day", "value")
    return events.anchors(p.select("event_id", "user_id", "day"), ix, "user_id", "day", "event_id", 7, 12, 2), ix, p


@query(f"WITH {ANC} SELECT event_id, user_id, t0::INTEGER AS ti FROM an")
def event_anchors(spark: SparkSession, d: str) -> DataFrame:
    """First day on or after the event, with full history and future."""
    return study(spark, d)[0]


@query(f"WITH {MOD} SELECT event_id, n, round(alpha, 6) + 0.0 AS alpha, round(beta, 4) + 0.0 AS beta FROM es")
def market_model(spark: SparkSession, d: str) -> DataFrame:
    """Market model of each event's estimation window."""
    a, ix, _ = study(spark, d)
    x = events.market_model(a, ix, "user_id", "event_id", "ret", "m", -12, -4)
    return x.select("event_id", "n", r6("alpha").alias("alpha"), (F.round("beta", 4) + F.lit(0.0)).alias("beta"))


@query(
    f"WITH {ANC}, ew AS (SELECT event_id, ret, m, m * m AS m2 FROM an JOIN ix ON ix.user_id = an.user_id AND ix.ti BETWEEN t0 - 12 AND t0 - 4), em AS (SELECT event_id, count(*) AS n, avg(ret) AS my, avg(m) AS x0, avg(m2) AS x1, {_moments('ret', ['m', 'm2'])} FROM ew GROUP BY 1 HAVING count(*) >= 5) SELECT event_id, n, round(my - {_slopes(2)[0]} * x0 - {_slopes(2)[1]} * x1, 4) + 0.0 AS alpha FROM em"
)
def event_factor_model(spark: SparkSession, d: str) -> DataFrame:
    """Two factors per event, solved in batches."""
    a, ix, _ = study(spark, d)
    x = ix.withColumn("m2", F.col("m") * F.col("m"))
    return events.factor_model(a, x, "user_id", "event_id", "ret", ["m", "m2"], -12, -4, 5).select("event_id", "n", (F.round(F.get("coef", F.lit(0)), 4) + F.lit(0.0)).alias("alpha"))


GRP = "gp AS (SELECT event_id, (value > 25)::INTEGER AS g FROM pe)"


@query(f"WITH {ARS}, {GRP}, c AS (SELECT g, k, avg(ar) AS aar, count(ar) AS n FROM ar JOIN gp USING (event_id) GROUP BY 1, 2) SELECT g, k::INTEGER AS k, round(aar, 6) + 0.0 AS aar, n, round(sum(aar) OVER (PARTITION BY g ORDER BY k), 6) + 0.0 AS car FROM c")
def event_car(spark: SparkSession, d: str) -> DataFrame:
    """Mean abnormal return by day and its sum, by group of events."""
    a, ix, p = study(spark, d)
    mm = events.market_model(a, ix, "user_id", "event_id", "ret", "m", -12, -4)
    ar = events.abnormal(a, ix, mm, "user_id", "event_id", "ret", "m", -2, 2)
    g = p.select("event_id", (F.col("value") > 25).cast("int").alias("g"))
    return rounded(events.car(ar, g, "event_id", "g", "ar_model"), "aar", "car")


@query(f"WITH {ARS}, {GRP}, c AS (SELECT event_id, 'around' AS w, sum(ar) AS car FROM ar WHERE k BETWEEN -1 AND 1 GROUP BY 1 UNION ALL SELECT event_id, 'full', sum(ar) FROM ar GROUP BY 1), s AS (SELECT w, avg(car) FILTER (g = 1) AS ma, avg(car) FILTER (g = 0) AS mb, var_samp(car) FILTER (g = 1) AS va, var_samp(car) FILTER (g = 0) AS vb, count(car) FILTER (g = 1) AS na, count(car) FILTER (g = 0) AS nb FROM c JOIN gp USING (event_id) GROUP BY 1) SELECT w AS \"window\", round(ma - mb, 6) + 0.0 AS diff, round((ma - mb) / sqrt(va / na + vb / nb), 4) + 0.0 AS t, na + nb AS n FROM s")
def event_welch_t(spark: SparkSession, d: str) -> DataFrame:
    """Welch's test of window returns between groups of events."""
    a, ix, p = study(spark, d)
    mm = events.market_model(a, ix, "user_id", "event_id", "ret", "m", -12, -4)
    c = events.window_car(events.abnormal(a, ix, mm, "user_id", "event_id", "ret", "m", -2, 2), "event_id", "ar_model", {"around": (-1, 1), "full": (-2, 2)})
    g = p.select("event_id", (F.col("value") > 25).cast("int").alias("g"))
    x = events.welch(c.join(g, "event_id"), ["window"], "g", "car", 1, 0)
    return x.select("window", r6("diff").alias("diff"), (F.round("t", 4) + F.lit(0.0)).alias("t"), "n")


@query(f"WITH {ANC}, v AS (SELECT event_id, stddev_samp(ret) FILTER (ix.ti - t0 BETWEEN -1 AND 2) AS se, stddev_samp(ret) FILTER (ix.ti - t0 BETWEEN -8 AND -3) AS sb, count(ret) FILTER (ix.ti - t0 BETWEEN -1 AND 2) AS ne, count(ret) FILTER (ix.ti - t0 BETWEEN -8 AND -3) AS nb FROM an JOIN ix ON ix.user_id = an.user_id AND ix.ti BETWEEN t0 - 8 AND t0 + 2 GROUP BY 1) SELECT event_id, round(se / sb, 4) + 0.0 AS ratio FROM v WHERE ne >= 3 AND nb >= 3 AND sb > 0 AND se / sb < 10")
def volatility_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Volatility around the event by that before it."""
    a, ix, _ = study(spark, d)
    x = events.volatility_ratio(a, ix, "user_id", "event_id", "ret", (-1, 2), (-8, -3))
    return x.select("event_id", (F.round("ratio", 4) + F.lit(0.0)).alias("ratio"))


# agreement and results


@query("WITH g AS (SELECT DISTINCT doc_id, rater_id, grade FROM reading_labels WHERE grade IS NOT NULL AND rater_id IS NOT NULL), x AS (SELECT doc_id, rater_id, min(grade) AS g FROM g GROUP BY 1, 2) SELECT a.rater_id AS rater_a, b.rater_id AS rater_b, count(*) AS n, round(avg((abs(a.g - b.g) <= 2)::INTEGER), 6) + 0.0 AS agree FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.rater_id < b.rater_id GROUP BY 1, 2")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two raters are within two years of each other."""
    return rounded(validate.pairwise_agreement(table(spark, d, "reading_labels"), "doc_id", "rater_id", "grade", 2), "agree")


@query("WITH l AS ({lang}), x AS (SELECT source, (lower(substring(d.lang, 1, 2)) = 'en')::INTEGER AS t, (l.lang = 'en')::INTEGER AS p FROM documents d JOIN l USING (doc_id)), c AS (SELECT source, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn FROM x WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1) SELECT source, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) + 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) + 0.0 END AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS agreement FROM c".replace("{lang}", SQL["detected_language"]))
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Given against detected language, by source."""
    x = table(spark, d, "documents", "doc_id", "source", "lang").withColumn("t", (F.lower(F.substring("lang", 1, 2)) == "en").cast("int")).drop("lang")
    p = detected_language(spark, d).select("doc_id", (F.col("lang") == "en").cast("int").alias("p"))
    return rounded(validate.confusion(x.join(p, "doc_id"), "t", "p", ["source"]), "precision", "recall", "agreement")


@query(
    f"WITH {FQ}, ok AS (SELECT year(form)::INTEGER AS yr, GeoExposure AS a, GeoRisk AS b FROM fq WHERE isfinite(GeoExposure) AND isfinite(GeoRisk)), r AS (SELECT *, rank() OVER (PARTITION BY yr ORDER BY a) + (count(*) OVER (PARTITION BY yr, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY yr ORDER BY b) + (count(*) OVER (PARTITION BY yr, b) - 1) / 2 AS rb FROM ok) SELECT yr, count(*) AS n, round(corr(a, b), 6) + 0.0 AS pearson, round(corr(ra, rb), 6) + 0.0 AS spearman FROM r GROUP BY 1"
)
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """A10, V9: Pearson and Spearman of two measures by year."""
    q = firm_quarters(spark, d).withColumn("yr", F.year("form"))
    return rounded(validate.correlations(q, "GeoExposure", "GeoRisk", ["yr"]), "pearson", "spearman")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ((doc_id % 2147483647) * 48271 + 7) % 2147483647, doc_id)::INTEGER AS draw FROM documents QUALIFY draw <= 5")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """V1: five documents of each source in pseudo-random order."""
    return validate.stratified(table(spark, d, "documents", "doc_id", "source"), ["source"], "doc_id", 5, 7).select("source", "doc_id", "draw")


PV = f"{HELD}, gs AS (SELECT Month, regr_r2(ret, GeoExposure) AS r2, count(*) AS n FROM he WHERE isfinite(GeoExposure) GROUP BY 1 HAVING count(*) >= {LEAST}), tv AS (SELECT Month, round(sqrt(r2 * (n - 2) / (1 - r2)), 6) AS t FROM gs), pv AS (SELECT Month, t, round({_tail('t * t')}, 9) AS p FROM tv)"


@query(f"WITH {PV}, r AS (SELECT *, row_number() OVER (ORDER BY p, Month) AS k, count(*) OVER () AS m FROM pv), q AS (SELECT *, p * m / k AS q0 FROM r) SELECT Month, t, round(p, 6) + 0.0 AS p, round(least(min(q0) OVER (ORDER BY p DESC, Month DESC), 1), 6) + 0.0 AS q, (t > 3)::INTEGER AS clears_three FROM q")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """False discovery rate over months of the slopes' p, and whether the t clears 3."""
    g = regress.slopes(held(spark, d), ["Month"], "ret", "GeoExposure", LEAST).select("Month", F.round(F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))), 6).alias("t"))
    p = validate.with_p(g, "t").withColumn("p", F.round("p", 9))
    return rounded(validate.bh_fdr(p, "p", ["Month"]).withColumn("clears_three", (F.col("t") > 3).cast("int")), "p", "q")


@query(f"WITH {HELD}, a AS (SELECT Month, sum(ret) AS v FROM he WHERE isfinite(GeoRisk) GROUP BY 1), b AS (SELECT Month, sum(ret) AS v FROM he WHERE isfinite(GeoExposure) AND siccd < 4000 GROUP BY 1) SELECT Month, round(a.v, 9) + 0.0 AS old, round(b.v, 9) + 0.0 AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN abs(round(b.v - a.v, 6)) <= 0.005 THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (Month)")
def results_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a table of results (here sums, which are decimals that round alike), row by row."""
    h = held(spark, d)
    a = h.filter(is_finite("GeoRisk")).groupBy("Month").agg(F.sum("ret").alias("v"))
    b = h.filter(is_finite("GeoExposure") & (F.col("siccd") < 4000)).groupBy("Month").agg(F.sum("ret").alias("v"))
    x = validate.compare(a, b, ["Month"], "v", 1e9)
    status = F.when(F.col("status").isin("added", "removed"), F.col("status")).when(F.abs(F.round(F.col("new") - F.col("old"), 6)) <= 0.005, "same").otherwise("changed")
    return rounded(x.withColumn("status", status).select("Month", "old", "new", "status"), "old", "new", digits=9)


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')}, {_nw('ls', 'Month', 'LS', 6)}, w AS (SELECT round(mean, 6) + 0.0 AS value, round(t, 4) + 0.0 AS t, n FROM nw) SELECT 'price' AS question, 'GeoRisk' AS measure, 'all' AS sample, 'monthly' AS freq, 'ls_mean' AS stat, value, t, n::DOUBLE AS n FROM w")
def tidy_results(spark: SparkSession, d: str) -> DataFrame:
    """The results table's form: one row per statistic."""
    ls = sorts.quantile_sort(held(spark, d), ["Month"], "GeoRisk", "ret", "permno", store=stored)
    x = series.mean_newey_west(ls, [], "Month", "LS", 6).select("n", r6("mean").alias("mean"), (F.round("t", 4) + F.lit(0.0)).alias("t"))
    return validate.tidy(x, "price", "GeoRisk", "all", "monthly", {"ls_mean": ("mean", "t")}, "n")


@query(f"WITH {SORT}, {_wide('bn', 'Month', 'avg(ret)')}, {_nw('ls', 'Month', 'LS', 6)} SELECT round(mean - 1.96 * abs(mean / t), 6) + 0.0 AS lo, round(mean + 1.96 * abs(mean / t), 6) + 0.0 AS hi, (mean - 1.96 * abs(mean / t)) * (mean + 1.96 * abs(mean / t)) > 0 AS clears, CASE WHEN abs(t) >= 2.576 THEN '***' WHEN abs(t) >= 1.96 THEN '**' WHEN abs(t) >= 1.645 THEN '*' ELSE '' END AS stars FROM nw")
def interval_stars(spark: SparkSession, d: str) -> DataFrame:
    """Interval and stars from a value and its t."""
    ls = sorts.quantile_sort(held(spark, d), ["Month"], "GeoRisk", "ret", "permno", store=stored)
    x = series.mean_newey_west(ls, [], "Month", "LS", 6)
    i = sorts.interval("mean", "t")
    return x.select(r6(i["lo"]).alias("lo"), r6(i["hi"]).alias("hi"), i["clears"].alias("clears"), i["stars"].alias("stars"))


CHG = f"{FQ}, tk AS (SELECT permno, year(form) * 4 + quarter(form) AS t, CASE WHEN isfinite(GeoExposure) THEN GeoExposure END AS a, CASE WHEN isfinite(GeoRisk) THEN GeoRisk END AS b FROM fq), ag AS (SELECT t, avg(a) AS a, avg(b) AS b FROM tk GROUP BY 1), ch AS (SELECT t, a, b, CASE WHEN t - lag(t, 4) OVER w = 4 THEN a - lag(a, 4) OVER w END AS da, CASE WHEN t - lag(t, 4) OVER w = 4 THEN b - lag(b, 4) OVER w END AS db FROM ag WINDOW w AS (ORDER BY t))"


@query(f"WITH {CHG} SELECT 'level' AS kind, count(*) AS n, round(corr(a, b), 6) + 0.0 AS pearson FROM ch WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'change', count(*), round(corr(da, db), 6) + 0.0 FROM ch WHERE da IS NOT NULL AND db IS NOT NULL")
def external_correlation(spark: SparkSession, d: str) -> DataFrame:
    """V8: two aggregate series, in levels and in changes over four quarters."""
    from ..operators import panel

    q = firm_quarters(spark, d).withColumn("t", F.year("form") * 4 + F.quarter("form")).groupBy("t").agg(F.avg(finite("GeoExposure")).alias("a"), F.avg(finite("GeoRisk")).alias("b")).withColumn("all", F.lit(1))
    x = panel.diff_guarded(panel.diff_guarded(q, "all", "t", "a", 4, "da"), "all", "t", "b", 4, "db")
    long = x.select(F.explode(F.array(F.struct(F.lit("level").alias("kind"), F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.lit("change").alias("kind"), F.col("da").alias("x"), F.col("db").alias("y")))).alias("s")).select("s.*")
    return rounded(long.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson")), "pearson")


AUD = f"{FQ}, q AS (SELECT form, quantile_cont(GeoExposure, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM fq WHERE isfinite(GeoExposure) AND GeoExposure <> 0 GROUP BY 1), de AS (SELECT permno, form, GeoExposure, GeoRisk, CAST(CASE WHEN GeoExposure = 0 THEN 0 WHEN isfinite(GeoExposure) THEN 1 + len(list_filter(b, lambda x: GeoExposure > x)) END AS INTEGER) AS decile FROM fq LEFT JOIN q USING (form)), co AS (SELECT *, (GeoRisk > 0.0005)::INTEGER AS code FROM de WHERE decile IS NOT NULL AND isfinite(GeoRisk))"


@query(f"WITH {AUD} SELECT decile, count(*) AS n, count(*) FILTER (code = 1) AS n_pos, round(avg(code), 6) + 0.0 AS pos_rate, round(avg(GeoExposure), 9) + 0.0 AS mean_score, CASE WHEN decile = 0 THEN 0 ELSE decile * 10 - 5 END AS percentile FROM co GROUP BY 1")
def audit_rates(spark: SparkSession, d: str) -> DataFrame:
    """V7: rows shuffled and numbered without their score, coded (here by a rule), joined back to the key, share of positives by decile."""
    x = validate.deciles_with_zero(firm_quarters(spark, d), "GeoExposure", 10, ["form"]).filter(F.col("decile").isNotNull() & is_finite("GeoRisk"))
    sheet, key = validate.blind(x.withColumn("key", F.col("permno").cast("bigint") * 10_000_000 + F.unix_date("form")).select("key", "decile", "GeoExposure", "GeoRisk"), "key", ["decile", "GeoExposure"], store=stored)
    coded = sheet.select("rater_id", (F.col("GeoRisk") > 0.0005).cast("int").alias("code")).join(key, "rater_id")
    out = validate.rate_by_bin(coded, "decile", "code", "GeoExposure")
    return out.select(F.col("decile").cast("int").alias("decile"), "n", "n_pos", r6("pos_rate").alias("pos_rate"), (F.round("mean_score", 9) + F.lit(0.0)).alias("mean_score"), F.col("percentile").cast("int").alias("percentile"))


TIERS = [("small", 0.12, 1), ("medium", 0.55, 2), ("large", 1.9, 4)]


@query("WITH t AS (SELECT * FROM (VALUES {rows}) AS v(tier, s_item, gpus)), n AS (SELECT count(*) AS n FROM documents) SELECT tier, (8 // gpus)::INTEGER AS instances, round(s_item * n / 3600, 6) + 0.0 AS gpu_hours, round(s_item * n / 3600 / (8 // gpus) / 24, 6) + 0.0 AS wall_days FROM t, n".replace("{rows}", ", ".join(f"('{a}', {b}::DOUBLE, {c})" for a, b, c in TIERS)))
def model_cost(spark: SparkSession, d: str) -> DataFrame:
    """V4: hours and days that models of three sizes would take for every document on eight accelerators."""
    n = table(spark, d, "documents", "doc_id").count()
    x = validate.model_cost(spark.createDataFrame(TIERS, "tier string, s_item double, gpus int"), float(n), 8)
    return rounded(x.select("tier", "instances", "gpu_hours", "wall_days"), "gpu_hours", "wall_days")
