"""Cross-sectional and panel regressions: sums in the JVM, small solves in numpy on what the sums leave."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, finite, is_finite
from .panel import with_period_stats, zscore
from .series import mean_newey_west

PERIODS_MOST = 5_000


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every column is finite."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & is_finite(c)
    return df.filter(cond)


def slopes(df: DataFrame, groups: Sequence[str], y: str, x: str, least: int = 3) -> DataFrame:
    """Least squares of y on one x by group: intercept, slope, r2, n and sd of the residuals (n - 1); groups below `least` rows are dropped."""
    d = complete(df, [y, x])
    agg = d.groupBy(*groups).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    sse = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    return agg.filter(F.col("n") >= least).select(*groups, "n", "intercept", "slope", "r2", F.sqrt(sse / (F.col("n") - 1)).alias("resid_sd"))


def grouped_ols(df: DataFrame, groups: Sequence[str], y: str, xs: Sequence[str], least: int = 30) -> DataFrame:
    """Least squares of y on several xs by group: (groups, n, coef (constant first), resid_sd with n - 1).

    The sums of products are one aggregate with a map-side combine, around the groups' means for accuracy; the solves run on batches
    of groups. A singular group has a null coef.
    """
    d = complete(df, [y, *xs]).select(*groups, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([y, *xs])])
    k = len(xs) + 1
    means = with_period_stats(d, groups, {f"_m{i}": F.avg(f"_{i}") for i in range(k)})
    c = [F.col(f"_{i}") - F.col(f"_m{i}") for i in range(k)]
    moments = [F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i + 1)]
    s = means.groupBy(*groups).agg(F.count("*").alias("n"), *[F.max(f"_m{i}").alias(f"m{i}") for i in range(k)], *moments).filter(F.col("n") >= least)
    packed = s.select(*groups, "n", F.array(*[F.col(f"m{i}") for i in range(k)]).alias("m"), F.array(*[F.col(f"s{i}_{j}") for i in range(k) for j in range(i + 1)]).alias("s"))

    @F.pandas_udf("coef array<double>, resid_sd double")
    def solve(n: pd.Series, m: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = len(n)
        full = np.zeros((rows, k, k))
        i, j = np.tril_indices(k)
        low = np.stack(s.to_numpy()) if rows else np.zeros((0, k * (k + 1) // 2))
        full[:, i, j] = full[:, j, i] = low
        mean = np.stack(m.to_numpy()) if rows else np.zeros((0, k))
        a, b = full[:, 1:, 1:], full[:, 1:, 0]
        fine = np.linalg.matrix_rank(a) == k - 1 if rows else np.zeros(0, dtype=bool)
        beta = np.full((rows, k - 1), np.nan)
        if fine.any():
            beta[fine] = np.linalg.solve(a[fine], b[fine][:, :, None])[:, :, 0]
        alpha = mean[:, 0] - (beta * mean[:, 1:]).sum(axis=1)
        rest = np.sqrt(np.maximum(full[:, 0, 0] - (beta * b).sum(axis=1), 0) / np.maximum(n.to_numpy(float) - 1, 1))
        coef = [list(map(float, (x, *y))) if ok else None for ok, x, y in zip(fine, alpha, beta, strict=True)]
        sd = [float(x) if ok else None for ok, x in zip(fine, rest, strict=True)]
        return pd.DataFrame({"coef": coef, "resid_sd": sd})

    return packed.select(*groups, "n", solve("n", "m", "s").alias("_r")).select(*groups, "n", "_r.coef", "_r.resid_sd")


def fama_macbeth(df: DataFrame, period: str, y: str, xs: Sequence[str], lags: int = 4, least: int = 30) -> DataFrame:
    """(regressor, n, mean, t): each x standardised within periods over its own finite rows, then one regression per period with at least
    `least` complete rows, the mean of each coefficient over periods and its HAC t."""
    d = df.select(period, y, *xs)
    for x in xs:
        d = zscore(d, [period], x, f"{x}_z")
    d = complete(d, [y, *[f"{x}_z" for x in xs]])
    if len(xs) == 1:
        per = slopes(d, [period], y, f"{xs[0]}_z", least).filter("slope IS NOT NULL").select(period, F.lit(xs[0]).alias("regressor"), F.col("slope").alias("b"))
    else:
        g = grouped_ols(d, [period], y, [f"{x}_z" for x in xs], least).filter("coef IS NOT NULL")
        pairs = [F.struct(F.lit(x).alias("regressor"), F.get("coef", F.lit(i + 1)).alias("b")) for i, x in enumerate(xs)]
        per = g.select(period, F.explode(F.array(*pairs)).alias("p")).select(period, "p.regressor", "p.b")
    return mean_newey_west(per, ["regressor"], period, "b", lags)


def time_fe(df: DataFrame, firm: str, period: str, y: str, xs: Sequence[str]) -> DataFrame:
    """(regressor, b, t, n): fixed effects of the period only, errors clustered by firm.

    One demeaning and one aggregate for the normal equations, one for the firms' scores. Small-sample factor G / (G - 1) * (n - 1) / (n - k),
    k the regressors and the periods, as none of the periods is nested in firms. No rows: no result.
    """
    cols, k = [y, *xs], len(xs)
    d = complete(df, cols).filter(F.col(firm).isNotNull() & F.col(period).isNotNull()).select(F.col(firm).alias("_f"), F.col(period).alias("_p"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    m = with_period_stats(d, ["_p"], {f"_m{i}": F.avg(f"_{i}") for i in range(k + 1)})
    x = m.select("_f", "_p", *[(F.col(f"_{i}") - F.col(f"_m{i}")).alias(f"_{i}") for i in range(k + 1)])
    out = "regressor string, b double, t double, n bigint"
    row = x.agg(F.count("*"), F.countDistinct("_p"), *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(k + 1) for j in range(k + 1)]).first()
    n, periods = row[0], row[1]
    if not n:
        return df.sparkSession.createDataFrame([], out)
    g = np.array(row[2:], dtype=float).reshape(k + 1, k + 1)
    inv = np.linalg.pinv(g[1:, 1:])
    b = inv @ g[1:, 0]
    e = F.col("_0") - sum((F.lit(float(b[i])) * F.col(f"_{i + 1}") for i in range(k)), F.lit(0.0))
    u = x.groupBy("_f").agg(*[F.sum(F.col(f"_{i + 1}") * e).alias(f"u{i}") for i in range(k)])
    score = u.agg(F.count("*"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(k) for j in range(k)]).first()
    firms, meat = score[0], np.array(score[1:], dtype=float).reshape(k, k)
    v = np.diag(inv @ meat @ inv) * firms / max(firms - 1, 1) * (n - 1) / max(n - k - periods, 1)
    return df.sparkSession.createDataFrame([(c, float(b[i]), float(b[i] / np.sqrt(v[i])) if v[i] > 0 else None, n) for i, c in enumerate(xs)], out)


def two_way_fe(df: DataFrame, firm: str, period: str, y: str, xs: Sequence[str], cluster: str = "both", store=None) -> dict[str, dict[str, float]]:
    """Fixed effects of firm and period, errors clustered by firm ('firm') or by both.

    The two-way problem is solved exactly: with firm means taken out, the period effects are the solution of a linear system with a row
    per period (some hundred, on the driver). Its matrix is a sum over firms of outer products of their row counts by period, added up
    inside each task; what is left after both effects needs one more pass. The frame is stored once with `store` (checkpoint by
    default). Then one aggregate gives the normal equations, one per cluster dimension the scores.
    Small-sample factor G / (G - 1) * (n - 1) / (n - k), effects nested in clusters not counted; for two clusterings V(firm) + V(period) -
    V(both), G the smaller number of clusters.
    """
    cols = [y, *xs]
    d = complete(df, cols).filter(F.col(firm).isNotNull() & F.col(period).isNotNull()).select(F.col(firm).alias("_f"), F.col(period).alias("_p"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    d = (store or (lambda f: f.checkpoint(eager=True)))(d)
    n = d.count()
    if n == 0:
        return {x: {"b": float("nan"), "t": float("nan"), "n": 0} for x in xs}
    spark, kind, many = d.sparkSession, d.schema["_p"].dataType.simpleString(), len(cols)
    periods = sorted(r[0] for r in d.select("_p").distinct().limit(PERIODS_MOST + 1).collect())
    if len(periods) > PERIODS_MOST:
        raise ValueError(f"more than {PERIODS_MOST} periods")
    size = len(periods)
    index = F.broadcast(spark.createDataFrame([(p, i) for i, p in enumerate(periods)], f"_q {kind}, _t int"))
    x = d.join(index, F.col("_p") == F.col("_q")).drop("_q")
    cells = x.groupBy("_f", "_t").agg(F.count("*").alias("c"))
    firms = cells.groupBy("_f").agg(F.collect_list("_t").alias("t"), F.collect_list("c").alias("c"))  # a firm has at most a cell per period

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            for t, c in zip(batch["t"], batch["c"], strict=True):
                w = np.asarray(c, dtype=float)
                total[np.ix_(t, t)] += np.outer(w, w) / w.sum()
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    matrix = np.zeros((size, size))
    for r in firms.mapInPandas(outer, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        matrix[r[0], r[1]] = -r[2]
    means = with_period_stats(x, ["_f"], {f"_m{i}": F.avg(f"_{i}") for i in range(many)})
    right = np.zeros((size, many))
    for r in means.groupBy("_t").agg(F.count("*"), *[F.sum(F.col(f"_{i}") - F.col(f"_m{i}")) for i in range(many)]).collect():
        matrix[r[0], r[0]] += r[1]
        right[r[0]] = r[2:]
    effect = np.linalg.pinv(matrix, rcond=1e-12) @ right

    def demeaned() -> DataFrame:
        e = spark.createDataFrame([(p, *map(float, effect[i])) for i, p in enumerate(periods)], f"_q {kind}, " + ", ".join(f"_e{i} double" for i in range(many)))
        y = d.join(F.broadcast(e), F.col("_p") == F.col("_q")).select("_f", "_p", *[(F.col(f"_{i}") - F.col(f"_e{i}")).alias(f"_{i}") for i in range(many)])
        m = with_period_stats(y, ["_f"], {f"_m{i}": F.avg(f"_{i}") for i in range(many)})
        return m.select("_f", "_p", *[(F.col(f"_{i}") - F.col(f"_m{i}")).alias(f"_{i}") for i in range(many)])

    d, firm, period = (store or (lambda f: f.checkpoint(eager=True)))(demeaned()), "_f", "_p"
    k = len(xs)
    gram = d.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(k + 1) for j in range(k + 1)]).first()
    g = np.array(gram, dtype=float).reshape(k + 1, k + 1)
    inv = np.linalg.pinv(g[1:, 1:])
    b = inv @ g[1:, 0]
    e = F.col("_0") - sum((F.lit(float(b[i])) * F.col(f"_{i + 1}") for i in range(k)), F.lit(0.0))
    scored = d.select(firm, period, *[(F.col(f"_{i + 1}") * e).alias(f"u{i}") for i in range(k)])

    def meat(keys: Sequence[str]) -> tuple[np.ndarray, int]:
        s = scored.groupBy(*keys).agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
        row = s.agg(F.count("*"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(k) for j in range(k)]).first()
        return np.array(row[1:], dtype=float).reshape(k, k), row[0]

    by_firm, firms = meat([firm])
    if cluster == "firm":
        middle, groups, nested = by_firm, firms, k + d.select(period).distinct().count()
    else:
        by_period, periods = meat([period])
        by_cell, _ = meat([firm, period])
        middle, groups, nested = by_firm + by_period - by_cell, min(firms, periods), k
    factor = groups / max(groups - 1, 1) * (n - 1) / max(n - nested, 1)
    v = np.diag(inv @ middle @ inv) * factor
    return {x: {"b": float(b[i]), "t": float(b[i] / np.sqrt(v[i])) if v[i] > 0 else float("nan"), "n": n} for i, x in enumerate(xs)}


def downside_beta(df: DataFrame, groups: Sequence[str], ret: str, market: str, least: int = 12, down_least: int = 0) -> DataFrame:
    """(groups, n, beta, downside_beta, coskew): beta in all periods, beta in those in which the market is below its mean over the whole table
    (null if a group has `down_least` of them or fewer), and co-skewness, with sd and variance over n - 1. Groups below `least` rows are
    dropped."""
    d = complete(df, [ret, market])
    mean = d.agg(F.avg(market)).first()[0]
    low = F.col(market) < F.lit(mean).cast("double")
    d = with_period_stats(d, groups, {"_m": F.avg(market), "_r": F.avg(ret)})
    m = F.col(market) - F.col("_m")
    a = d.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(low).alias("_d"), F.covar_samp(F.when(low, as_col(ret)), F.when(low, as_col(market))).alias("_c"), F.var_samp(F.when(low, as_col(market))).alias("_v"), F.regr_slope(ret, market).alias("beta"), F.avg((F.col(ret) - F.col("_r")) * m * m).alias("_s"), F.stddev_samp(ret).alias("_sr"), F.var_samp(market).alias("_vm"))
    return a.filter(F.col("n") >= least).select(*groups, "n", "beta", F.when((F.col("_v") > 0) & (F.col("_d") > down_least), F.col("_c") / F.col("_v")).alias("downside_beta"), F.when((F.col("_sr") > 0) & (F.col("_vm") > 0), F.col("_s") / F.col("_sr") / F.col("_vm")).alias("coskew"))


def illiquidity(daily: DataFrame, groups: Sequence[str], ret: str, price: str, volume: str, least: int = 10) -> DataFrame:
    """Mean of |return| / (price * volume) over days with trade; groups below `least` days are dropped."""
    value = F.when((F.col(price) * F.col(volume)) > 0, F.abs(finite(ret)) / (F.col(price) * F.col(volume)))
    return daily.groupBy(*groups).agg(F.avg(value).alias("illiq"), F.count(value).alias("n_days")).filter(F.col("n_days") >= least)
