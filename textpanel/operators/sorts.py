"""Quantile sorts, long-short series, double sorts, regional composites, costs and performance.

`store` (a checkpoint) keeps what the bins are made of, as they read it several times; it is narrowed to the columns in use first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, finite, is_finite, safe_div
from .panel import bins, demean, median_split, weighted_mean, with_period_stats


def bin_returns(binned: DataFrame, period: Sequence[str], ret: str, bin: str = "bin", weight: str | None = None) -> DataFrame:
    """(period, bin, ret, n): equal- or value-weighted mean of each bin; rows without a bin or a finite return don't count."""
    d = binned.filter(F.col(bin).isNotNull() & is_finite(ret))
    mean = F.avg(ret) if weight is None else weighted_mean(ret, weight)
    return d.groupBy(*period, bin).agg(mean.alias("ret"), F.count("*").alias("n"))


def long_short(returns: DataFrame, period: Sequence[str], n: int, bin: str = "bin") -> DataFrame:
    """(period, ret_1 ... ret_n, LS): bins side by side and top minus bottom. Bins are named, so no pass over the data looks for them."""
    cells = [F.max(F.when(F.col(bin) == i, F.col("ret"))).alias(f"ret_{i}") for i in range(1, n + 1)]
    return returns.groupBy(*period).agg(*cells).withColumn("LS", F.col(f"ret_{n}") - F.col("ret_1"))


Store = Callable[[DataFrame], DataFrame]


def _narrow(df: DataFrame, columns: Sequence[str | None], store: Store | None) -> DataFrame:
    d = df.select(*dict.fromkeys(c for c in columns if c))
    return store(d) if store else d


def quantile_sort(df: DataFrame, period: Sequence[str], measure: str, ret: str, by: str, n: int = 5, weight: str | None = None, ties: str = "first", store: Store | None = None) -> DataFrame:
    """Long-short series of a measure: rank among rows with a finite measure and return, then bin_returns and long_short."""
    ok = _narrow(df.filter(is_finite(measure) & is_finite(ret)), [*period, measure, ret, by, weight], store)
    return long_short(bin_returns(bins(ok, period, measure, n, ties, by), period, ret, weight=weight), period, n)


def size_neutral(df: DataFrame, period: Sequence[str], size: str, measure: str, ret: str, by: str, n: int = 5, store: Store | None = None) -> DataFrame:
    """Bins of size, bins of the measure within them, and the mean over size bins of top minus bottom, by period."""
    ok = _narrow(df.filter(is_finite(measure) & is_finite(ret) & is_finite(size)), [*period, size, measure, ret, by], store)
    outer = _narrow(bins(ok, period, size, n, "first", by, out="size_bin"), [*period, "size_bin", measure, ret, by], store)
    inner = bins(outer, [*period, "size_bin"], measure, n, "first", by)
    ls = long_short(bin_returns(inner, [*period, "size_bin"], ret), [*period, "size_bin"], n)
    return ls.groupBy(*period).agg(F.avg("LS").alias("LS"), F.count("LS").alias("n_size_bins"))


def double_sort(df: DataFrame, period: Sequence[str], char: str, measure: str, ret: str, by: str, n_char: int = 3, n: int = 5, store: Store | None = None) -> DataFrame:
    """Independent bins of a characteristic and of the measure; long-short within each bin of the characteristic."""
    ok = _narrow(df.filter(is_finite(measure) & is_finite(ret) & is_finite(char)), [*period, char, measure, ret, by], store)
    first = _narrow(bins(ok, period, char, n_char, "first", by, out="char_bin"), [*period, "char_bin", measure, ret, by], store)
    both = bins(first, period, measure, n, "first", by)
    return long_short(bin_returns(both, [*period, "char_bin"], ret), [*period, "char_bin"], n).select(*period, "char_bin", "LS")


def industry_neutral(df: DataFrame, period: Sequence[str], industry: str, measure: str, ret: str, by: str, n: int = 5, store: Store | None = None) -> DataFrame:
    """The measure minus its industry's mean in the period, then a quantile sort. Rows without an industry are dropped."""
    d = demean(df.filter(F.col(industry).isNotNull() & is_finite(measure)), [*period, industry], measure, "_m")
    return quantile_sort(d, period, "_m", ret, by, n, store=store)


def split_sample(df: DataFrame, period: Sequence[str], by_column: str, measure: str, ret: str, by: str, n: int = 5, store: Store | None = None) -> DataFrame:
    """Long-short of the rows above and of those at or below the period's median of a column."""
    ok = _narrow(df, [*period, by_column, measure, ret, by], store)
    d = median_split(ok, period, by_column, "above").filter("above IS NOT NULL")
    return quantile_sort(d, [*period, "above"], measure, ret, by, n, store=store).select(*period, "above", "LS")


def seed_averaged(df: DataFrame, period: Sequence[str], measure: str, ret: str, by: str, n: int = 5, seeds: int = 25, order: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """Long-short with random ties, averaged over seeds. order: the random order of a seed and an identifier, by default a hash.

    Only rows that share their value with others are looked at once per seed: what the others add to a bin is the same for every seed.
    """
    order = order or (lambda seed, name: F.xxhash64(seed, F.col(name)))
    ok = df.filter(is_finite(measure) & is_finite(ret)).select(*period, F.col(measure).alias("_x"), F.col(ret).alias("_y"), by)
    everyone = Window.partitionBy(*period)
    ranked = ok.withColumns({"_less": F.rank().over(everyone.orderBy("_x")) - 1, "_n": F.count("*").over(everyone), "_same": F.count("*").over(Window.partitionBy(*period, "_x"))})
    bin_of = lambda rank: F.floor((rank * n + F.col("_n") - 1) / F.col("_n")).cast("int")
    seed = F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed")
    alone = ranked.filter("_same = 1").withColumn("bin", bin_of(F.col("_less") + 1)).groupBy(*period, "bin").agg(F.sum("_y").alias("s"), F.count("*").alias("c")).select(*period, "bin", "s", "c", seed)
    tied = ranked.filter("_same > 1").select("*", seed)
    place = F.row_number().over(Window.partitionBy(*period, "seed", "_x").orderBy(order(F.col("seed"), by), F.col(by)))
    placed = tied.withColumn("bin", bin_of(F.col("_less") + place)).groupBy(*period, "seed", "bin").agg(F.sum("_y").alias("s"), F.count("*").alias("c"))
    cells = alone.unionByName(placed).groupBy(*period, "seed", "bin").agg((F.sum("s") / F.sum("c")).alias("ret"))
    return long_short(cells, [*period, "seed"], n).groupBy(*period).agg(F.avg("LS").alias("LS"))


def reversal(df: DataFrame, key: str, period: str, ret: str, n: int = 5, store: Store | None = None) -> DataFrame:
    """(period, REV): losers minus winners of the month before, equal weights; a gap in a key's months gives no last month. One row per key
    and month."""
    w = Window.partitionBy(key).orderBy(period)
    gap = F.months_between(F.trunc(F.col(period), "month"), F.trunc(F.lag(period).over(w), "month"))
    d = df.select(key, period, ret).withColumn("_prev", F.when(gap == 1, F.lag(ret).over(w)))
    return quantile_sort(d, [period], "_prev", ret, key, n, store=store).select(period, (-F.col("LS")).alias("REV")).filter("REV IS NOT NULL")


def reconcile(df: DataFrame, period: str, measure: str, first: str, second: str, by: str, n: int = 5, store: Store | None = None) -> DataFrame:
    """(period, first, second, gap): long-short of the same rows by two sources of the same return; rows need a finite measure and both."""
    ok = _narrow(df.filter(is_finite(measure) & is_finite(first) & is_finite(second)), [period, measure, first, second, by], store)
    b = bins(ok, [period], measure, n, "first", by)
    ls = lambda c: F.avg(F.when(F.col("bin") == n, F.col(c))) - F.avg(F.when(F.col("bin") == 1, F.col(c)))
    both = b.groupBy(period).agg(ls(first).alias("first"), ls(second).alias("second"), F.count("*").alias("n"))
    return both.withColumn("gap", F.col("first") - F.col("second"))


def composite(series: DataFrame, period: str, part: str, value: str, weight: str | None = None) -> DataFrame:
    """Mean over parts (regions) of a series in the periods in which every part has a value: the composition is fixed."""
    d = series.filter(is_finite(value))
    parts = d.select(part).distinct().count()  # a handful
    mean = F.avg(value) if weight is None else weighted_mean(value, weight)
    return d.groupBy(period).agg(mean.alias(value), F.countDistinct(part).alias("_k")).filter(F.col("_k") == parts).drop("_k")


def net_of_costs(series: DataFrame, gross: str, turnover: str, bps: Sequence[int] = (10, 25, 50)) -> DataFrame:
    """Adds net_<bps> = gross - 2 * turnover * bps / 10000 (both sides of the trade), and the break-even cost in bps."""
    cols = {f"net_{b}": F.col(gross) - 2 * F.col(turnover) * b / 10000.0 for b in bps}
    return series.withColumns(cols).withColumn("breakeven_bps", safe_div(F.col(gross) * 10000.0, 2 * F.col(turnover)))


def cap_costs(df: DataFrame, period: Sequence[str], cap: str, top: int = 500, base: float = 5.0, slope: float = 5.0, most: float = 150.0) -> DataFrame:
    """Cost in bps that falls with market value: min(base + slope * sqrt(ref / cap), most), ref the median of the period's `top` largest."""
    x = F.when(F.col(cap) > 0, finite(cap))
    w = Window.partitionBy(*period).orderBy(x.desc_nulls_last())
    large = df.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= top) & x.isNotNull())
    ref = large.groupBy(*period).agg(F.percentile(x, F.lit(0.5)).alias("ref_cap"))
    return df.join(ref, list(period), "left").withColumn("cost_bps", F.least(F.lit(base) + slope * F.sqrt(F.col("ref_cap") / x), F.lit(most)))


def performance(series: DataFrame, value: str, per_year: int = 12, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and volatility a year, Sharpe ratio, number of periods, share of positive ones."""
    x = finite(value)
    agg = series.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.avg((x > 0).cast("double")).alias("share_positive"))
    return agg.select(*groups, "n", (F.col("_m") * per_year).alias("mean_year"), (F.col("_s") * per_year**0.5).alias("vol_year"), safe_div(F.col("_m") * per_year**0.5, "_s").alias("sharpe"), "share_positive")


def growth_comparison(strategy: DataFrame, market: DataFrame, period: str, a: str, b: str) -> DataFrame:
    """Growth of 1 of two monthly series on their common months, with a base row of 1 one month before the first."""
    both = strategy.select(period, a).filter(is_finite(a)).join(market.select(period, b).filter(is_finite(b)), period)
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)  # a series has some hundred rows
    grown = both.select(F.col(period).cast("date").alias(period), F.exp(F.sum(F.log1p(a)).over(w)).alias(a), F.exp(F.sum(F.log1p(b)).over(w)).alias(b))
    base = both.agg(F.add_months(F.min(F.col(period).cast("date")), -1).alias(period)).filter(F.col(period).isNotNull()).select(period, F.lit(1.0).alias(a), F.lit(1.0).alias(b))
    return base.unionByName(grown)


def summary(df: DataFrame, measures: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """One row per measure (and group): n, mean, sd, p10, median, p90, share above 0."""
    out = None
    for m in measures:
        x = finite(m)
        part = df.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.1)).alias("p10"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.9)).alias("p90"), F.avg((x > 0).cast("double")).alias("share_positive")).withColumn("measure", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def binscatter(df: DataFrame, period: Sequence[str], x: str, y: str, by: str, n: int = 20, store: Store | None = None) -> DataFrame:
    """Means of x and y by rank bin of x within the period, over all periods."""
    ok = _narrow(df.filter(is_finite(x) & is_finite(y)), [*period, x, y, by], store)
    return bins(ok, period, x, n, "first", by).groupBy("bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def heatmap(df: DataFrame, row: Column, column: Column, value: str, scale: float = 1000.0) -> DataFrame:
    """Mean of a value by two keys, scaled."""
    return df.groupBy(row.alias("row"), column.alias("column")).agg((F.avg(finite(value)) * scale).alias("value"), F.count(finite(value)).alias("n"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], firm: str) -> DataFrame:
    """(step, label, rows, firms) after each filter in turn, in one pass."""
    alive = F.lit(True)
    parts = []
    for i, (label, cond) in enumerate(steps):
        alive = alive & F.coalesce(cond, F.lit(False))
        parts.append(F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), alive.alias("_in")))
    long = df.select(F.col(firm).alias("_f"), F.explode(F.array(*parts)).alias("s")).filter("s._in")
    return long.groupBy("s.step", "s.label").agg(F.count("*").alias("n_rows"), F.countDistinct("_f").alias("n_firms"))


def standardize(series: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """Whole series to mean 0 and sd 1, in long form (period, series, z)."""
    s = with_period_stats(series, [], {f"_m{i}": F.avg(finite(c)) for i, c in enumerate(columns)} | {f"_s{i}": F.stddev_samp(finite(c)) for i, c in enumerate(columns)})
    z = [F.struct(F.lit(c).alias("series"), F.when(F.col(f"_s{i}") > 0, (finite(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias("z")) for i, c in enumerate(columns)]
    return s.select(period, F.explode(F.array(*z)).alias("x")).select(period, "x.series", "x.z")


def interval(value: Column | str, t: Column | str) -> dict[str, Column]:
    """Back-out of the standard error from value and t: 95 % interval, whether it excludes 0, and stars."""
    v, t = as_col(value), as_col(t)
    se = F.abs(safe_div(v, t))
    lo, hi = v - 1.96 * se, v + 1.96 * se
    a = F.abs(t)
    return {"lo": lo, "hi": hi, "clears": lo * hi > 0, "stars": F.when(a >= 2.576, "***").when(a >= 1.96, "**").when(a >= 1.645, "*").otherwise("")}
