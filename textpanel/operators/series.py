"""Estimators on one short series (some hundred periods): least squares, HAC errors, spanning, walk-forward.

The distributed part ends where a panel has become a series; `local` brings that to the driver and refuses one that is too long.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, safe_div

SERIES_MOST = 100_000


def local(series: DataFrame, order: str, most: int = SERIES_MOST) -> pd.DataFrame:
    """The series as a pandas frame in order; an error if it has more rows than a series can have."""
    rows = series.orderBy(order).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a series of periods")
    return rows


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residuals of y on x (which holds its constant)."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def newey_west(x: np.ndarray, e: np.ndarray, lags: int) -> np.ndarray:
    """HAC covariance of least squares: Bartlett weights 1 - l / (lags + 1), no prewhitening, times n / (n - k)."""
    n, k = x.shape
    u = x * e[:, None]
    s = u.T @ u
    for lag in range(1, min(lags, n - 1) + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    bread = np.linalg.pinv(x.T @ x)
    return bread @ s @ bread * (n / (n - k))


def spanning(frame: pd.DataFrame, y: str, factors: Sequence[str], lags: int = 4, least: int = 24) -> dict[str, float]:
    """alpha, its HAC t, R squared, n, and beta_<f> / t_<f> of each factor; NaN if fewer than `least` complete rows."""
    d = frame[[y, *factors]].apply(pd.to_numeric).replace([np.inf, -np.inf], np.nan).dropna()
    names = ["alpha", *factors]
    if len(d) < max(least, len(names) + 1):
        return {"alpha": math.nan, "t": math.nan, "r2": math.nan, "n": len(d)}
    x = np.column_stack([np.ones(len(d)), d[list(factors)].to_numpy(float)])
    b, e = ols(d[y].to_numpy(float), x)
    se = np.sqrt(np.diag(newey_west(x, e, lags)))
    t = np.divide(b, se, out=np.full_like(b, np.nan), where=se > 0)
    total = ((d[y] - d[y].mean()) ** 2).sum()
    out = {"alpha": b[0], "t": t[0], "r2": 1 - (e @ e) / total if total > 0 else math.nan, "n": len(d)}
    return {k: float(v) for k, v in out.items()} | {f"beta_{f}": float(b[i + 1]) for i, f in enumerate(factors)} | {f"t_{f}": float(t[i + 1]) for i, f in enumerate(factors)}


def walk_forward(frame: pd.DataFrame, y: str, factors: Sequence[str], first: int = 36) -> pd.DataFrame:
    """From row `first` on: the return minus its factor part, with betas of all earlier rows. Columns of frame and `oos`."""
    d = frame.dropna(subset=[y, *factors]).reset_index(drop=True)
    x = np.column_stack([np.ones(len(d)), d[list(factors)].to_numpy(float)]) if len(d) else np.empty((0, len(factors) + 1))
    v = d[y].to_numpy(float)
    gram, cross = np.cumsum(x[:, :, None] * x[:, None, :], axis=0), np.cumsum(x * v[:, None], axis=0)
    out = np.full(len(d), np.nan)
    for t in range(first, len(d)):
        b = np.linalg.pinv(gram[t - 1]) @ cross[t - 1]
        out[t] = v[t] - x[t, 1:] @ b[1:]
    return d.assign(oos=out)


def mean_newey_west(df: DataFrame, groups: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """(groups, n, mean, t) of a series: the HAC t of a mean in closed form, by lags in a window; all inside the JVM.

    Variance: (g0 + 2 * sum over l of (1 - l / (lags + 1)) * gl) / n**2 * n / (n - 1), gl the sum of products of deviations l apart.
    """
    x = finite(value)
    d = df.filter(x.isNotNull()).select(*groups, order, x.alias("_x"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))  # a series has some hundred rows
    e = d.withColumns({"_m": F.avg("_x").over(whole), "n": F.count("*").over(whole)}).withColumn("_e", F.col("_x") - F.col("_m"))
    w = whole.orderBy(order)
    lagged = [F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_g{k}") for k in range(1, lags + 1)]
    e = e.select(*groups, "_m", "n", "_e", *[F.lag("_e", k).over(w).alias(f"_e{k}") for k in range(1, lags + 1)])
    s = e.groupBy(*groups).agg(F.max("_m").alias("mean"), F.max("n").alias("n"), F.sum(F.col("_e") ** 2).alias("_g0"), *lagged)
    total = F.col("_g0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(f"_g{k}", F.lit(0.0))
    n = F.col("n").cast("double")
    return s.select(*groups, "n", "mean", safe_div("mean", F.sqrt(F.when((total > 0) & (n > 1), total / n / n * n / (n - 1)))).alias("t"))


def loadings(frame: pd.DataFrame, y: str, factors: Sequence[str], lags: int = 4, least: int = 12) -> pd.DataFrame:
    """(factor, beta, t, n): one regression of y on each factor alone, HAC t; null below `least` complete rows."""
    rows = []
    for f in factors:
        out = spanning(frame, y, [f], lags, least)
        rows.append((f, out.get(f"beta_{f}"), out.get(f"t_{f}"), out["n"]))
    return pd.DataFrame(rows, columns=["factor", "beta", "t", "n"])


def expanding_alpha(frame: pd.DataFrame, order: str, y: str, factors: Sequence[str], lags: int = 4, first: int = 36) -> pd.DataFrame:
    """(through, n, alpha, t): spanning of all rows up to the last one of each year, for years that end at row `first` or later."""
    d = frame.dropna(subset=[y, *factors]).reset_index(drop=True)
    years = pd.to_datetime(d[order]).dt.year if len(d) else pd.Series([], dtype=int)
    rows = []
    for year in sorted(years.unique()):
        n = int((years <= year).sum())
        if n >= first:
            out = spanning(d.iloc[:n], y, factors, lags)
            rows.append((int(year), n, out["alpha"], out["t"]))
    return pd.DataFrame(rows, columns=["through", "n", "alpha", "t"])
