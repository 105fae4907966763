"""Column expressions on numbers that treat null, NaN and the infinities explicitly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for an ordinary number; false (never null) for null, NaN and the infinities."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite(c: Column | str) -> Column:
    """The number, or null if it is null, NaN or infinite: what aggregates should see."""
    c = as_col(c)
    return F.when(is_finite(c), c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is null or zero (ANSI mode would raise)."""
    a, b = as_col(a), as_col(b)
    return F.when(b != 0, a / b)


def clamp(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """x held within [lo, hi]; null if any argument is null (least/greatest alone would skip nulls)."""
    x, lo, hi = as_col(x), as_col(lo), as_col(hi)
    return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(x, lo), hi))


def rank_bin(rank: Column, n: Column, bins: int) -> Column:
    """ceil(rank * bins / n) in whole numbers, so that no rounding error can move a row to the next bin."""
    return F.floor((rank * bins + n - 1) / n).cast("int")


def erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function of values of 0 or more: its series below 2.5, its continued fraction above; NaN stays NaN."""
    z = np.asarray(z, dtype=float)
    low = np.minimum(z, 2.5)
    term, total = low.copy(), low.copy()
    for n in range(1, 60):
        term = -term * low * low / n
        total = total + term / (2 * n + 1)
    high = np.maximum(z, 2.5)
    k = high.copy()
    for n in range(60, 0, -1):
        k = high + n / 2 / k
    return np.where(z < 2.5, 1 - 2 / np.sqrt(np.pi) * total, np.exp(-high * high) / np.sqrt(np.pi) / k)
