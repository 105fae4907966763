"""Panels: aggregates over time, period statistics, leads with a guard against gaps, rank bins.

Numbers that are null, NaN or infinite take no part in any statistic (finite); a row's own value stays as it is unless a function
says otherwise. A period may hold any share of the rows, so none is sorted in one task: quantiles and rank bins come from order
statistics that are narrowed down by approximate percentiles and settled by counting (order_statistics), and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, clamp, finite, is_finite, safe_div


def compound(c: Column | str) -> Column:
    """Aggregate: product of 1 + r over finite r, minus 1; null if there is none."""
    return F.product(1 + finite(c)) - 1


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Aggregate over rows with a finite value and a positive finite weight."""
    x, w = as_col(x), as_col(w)
    ok = is_finite(x) & is_finite(w) & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def with_period_stats(df: DataFrame, period: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """df with one column per aggregate over its period, by a partial aggregate and a join: a period with a third of all rows is no single
    task's. Null periods match themselves. Without a period the statistics are those of all rows, computed at once and put in as values."""
    if not period:
        row = df.agg(*[c.alias(n) for n, c in stats.items()]).first()
        value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v).cast("double")
        return df.withColumns({n: value(row[n]) for n in stats})
    keys = [F.col(p).alias(f"_g{i}") for i, p in enumerate(period)]
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    on = [F.col(p).eqNullSafe(F.col(f"_g{i}")) for i, p in enumerate(period)]
    return df.join(agg, on, "left").drop(*[f"_g{i}" for i in range(len(period))])


#: Steps of the approximate percentiles that order_statistics looks between, and their accuracy: an error well below a step. Groups up to
#: this number go to the driver and are broadcast (some hundred bytes each); more are joined.
STEPS, ACCURACY, GROUPS_MOST = 1000, 10_000, 5_000
#: Up to so many equal values at a rank are sorted by the second column in one task.
TIES_MOST = 100_000


def settled(small: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """A frame of a row per group, computed, and its rows: as a broadcast of checked size if there are few, as it is if there are many."""
    rows = small.limit(GROUPS_MOST + 1).collect()
    if len(rows) > GROUPS_MOST:
        return small, None
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema)), rows


def order_statistics(df: DataFrame, groups: Sequence[str], value: Column, ranks: Callable[[Column], Column], second: Column | None = None) -> DataFrame:
    """(_g0, _g1, ..., _n, _at): per group the number of values that aren't null and, for each rank of the ascending array ranks(number) that
    is at least 1, a struct (k: its index, rank, v: the value of that rank, less: values below v, same: values equal to it, s).

    With `second` (whole numbers, unique among equal values) s is its value in the row of that rank, rows being ordered by value, then by
    it; null where no other row has the value. One aggregate gives approximate percentiles; the next one counts rows that can't be at a rank
    by the rank they lie above, and the others by value. What is sorted are these counts, a few thousandths of a group's values. Equal
    values at a rank are settled in the same way by `second`, in another round that is left out if there are none.
    """
    keys = [f"_g{i}" for i in range(max(len(groups), 1))]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=False)] or [F.lit(0).alias("_g0")]
    base = df.select(*named, value.alias("_x"), *([second.cast("bigint").alias("_s")] if second is not None else [])).filter("_x IS NOT NULL")
    grid = F.expr(f"percentile_approx(_x, array({', '.join(f'{i / STEPS}D' for i in range(1, STEPS))}), {ACCURACY})")
    stats = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), grid.alias("_p"))

    def near(step: Column) -> Column:
        return F.when(step < 1, F.col("_lo")).when(step >= STEPS, F.col("_hi")).otherwise(F.get("_p", step.cast("int") - 1))

    asked = F.filter(F.transform(ranks(F.col("_n")), lambda r, i: F.struct(i.alias("k"), r.cast("bigint").alias("rank"))), lambda x: x["rank"] >= 1)
    at = lambda x, lo: near(F.floor(x["rank"] * STEPS / F.col("_n")) - 1 if lo else F.ceil(x["rank"] * STEPS / F.col("_n")) + 1)
    small, _ = settled(stats.select(*keys, "_n", F.transform(asked, lambda x: F.struct(x["k"].alias("k"), x["rank"].alias("rank"), at(x, True).alias("lo"), at(x, False).alias("hi"))).alias("_a")))

    def on(name: str) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"{name}{i}")) for i, k in enumerate(keys)]

    def other(frame: DataFrame, name: str = "_h") -> DataFrame:
        return frame.withColumnsRenamed({k: f"{name}{i}" for i, k in enumerate(keys)})

    x = F.col("_x")
    inside = F.exists("_a", lambda r: (r["lo"] <= x) & (x <= r["hi"]))
    cells = base.join(other(small), on("_h")).select(*keys, F.size(F.filter("_a", lambda r: r["lo"] <= x)).alias("_b"), F.when(inside, x).alias("_x")).groupBy(*keys, "_b", "_x").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_b", F.col("_x").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    hit = cells.withColumn("_upto", F.sum("_m").over(w)).filter("_x IS NOT NULL").join(other(small), on("_h"))
    here = F.filter("_a", lambda r: (F.col("_upto") - F.col("_m") < r["rank"]) & (r["rank"] <= F.col("_upto")))
    found = hit.select(*keys, "_x", (F.col("_upto") - F.col("_m")).alias("_less"), F.col("_m").alias("_same"), F.explode(here).alias("_r"))
    one = F.struct(F.col("_r.k").alias("k"), F.col("_r.rank").alias("rank"), F.col("_x").alias("v"), F.col("_less").alias("less"), F.col("_same").alias("same"), F.lit(None).cast("bigint").alias("s"))
    best = found.select(*keys, one.alias("_f")).groupBy(*keys).agg(F.array_sort(F.collect_list("_f")).alias("_at"))
    none = F.array().cast(best.schema["_at"].dataType)
    done, known = settled(small.join(other(best), on("_h"), "left").select(*keys, "_n", F.coalesce("_at", none).alias("_at")))  # a group may ask for no rank
    most = max((f["same"] for r in known for f in r["_at"]), default=1) if known is not None else None
    if second is None or most == 1:
        return done
    tied = base.join(other(done), on("_h")).select(*keys, "_s", F.explode(F.filter("_at", lambda f: (f["same"] > 1) & (f["v"] == x))).alias("_f")).select(*keys, F.col("_f.k").alias("_k"), (F.col("_f.rank") - F.col("_f.less")).alias("_w"), "_s")
    place = len(keys) + 1
    if most is not None and most <= TIES_MOST:
        rank = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_s"))
        lasts = tied.withColumn("_i", rank).filter("_i = _w").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_s"))).alias("_l"))
    else:
        by_rank = order_statistics(tied, [*keys, "_k", "_w"], F.col("_s"), lambda n: F.array(F.col(f"_g{place}")))
        lasts = by_rank.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(f"_g{place - 1}"), F.get("_at", F.lit(0))["v"]))).alias("_l"))
    full = done.join(other(lasts), on("_h"), "left").select(*keys, "_n", F.transform("_at", lambda f: F.struct(f["k"].alias("k"), f["rank"].alias("rank"), f["v"].alias("v"), f["less"].alias("less"), f["same"].alias("same"), F.try_element_at("_l", f["k"]).alias("s"))).alias("_at"))
    return settled(full)[0]


def with_quantiles(df: DataFrame, period: Sequence[str], value: Column, probs: Sequence[float], out: str) -> DataFrame:
    """df with the array `out` of the period's quantiles of a value (linear interpolation between order statistics, type 7), null if it has
    none. Without a period those of all rows."""
    spots = lambda n: F.array(*[x for p in probs for x in (F.floor((n - 1) * F.lit(float(p))) + 1, F.least(F.floor((n - 1) * F.lit(float(p))) + 2, n))])
    s = order_statistics(df, period, value.cast("double"), spots)
    h = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    v = lambda i: F.get("_at", F.lit(i))["v"]
    q = s.select(*[c for c in s.columns if c.startswith("_g")], F.array(*[v(2 * i) + (h(p) - F.floor(h(p))) * (v(2 * i + 1) - v(2 * i)) for i, p in enumerate(probs)]).alias(out))
    if not period:
        row = q.first()
        return df.withColumn(out, F.array(*[F.lit(x) for x in row[out]]) if row else F.lit(None).cast("array<double>"))
    on = [F.col(p).eqNullSafe(F.col(f"_g{i}")) for i, p in enumerate(period)]
    return df.join(q, on, "left").drop(*[f"_g{i}" for i in range(len(period))])


def winsorize(df: DataFrame, period: Sequence[str], column: str, lo: float = 0.005, hi: float = 0.995, out: str | None = None) -> DataFrame:
    """The column held within the period's own quantiles (linear interpolation); null for a value that isn't finite."""
    x = finite(column)
    s = with_quantiles(df, period, x, [lo, hi], "_q")
    return s.withColumn(out or f"{column}_w", clamp(x, F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_q")


def winsorize_upper(df: DataFrame, column: str, hi: float = 0.99, out: str | None = None) -> DataFrame:
    """The column held below the quantile of all rows; null for a value that isn't finite."""
    x = finite(column)
    return with_quantiles(df, [], x, [hi], "_q").withColumn(out or f"{column}_u", F.when(x.isNotNull(), F.least(x, F.get("_q", F.lit(0))))).drop("_q")


def zscore(df: DataFrame, period: Sequence[str], column: str, out: str | None = None) -> DataFrame:
    """(x - mean) / sd of the period (sd with n - 1); null where x isn't finite, or sd is null or 0."""
    x = finite(column)
    s = with_period_stats(df, period, {"_m": F.avg(x), "_s": F.stddev_samp(x)})
    return s.withColumn(out or f"{column}_z", F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def demean(df: DataFrame, groups: Sequence[str], column: str, out: str | None = None) -> DataFrame:
    """The column minus its group's mean."""
    x = finite(column)
    return with_period_stats(df, groups, {"_m": F.avg(x)}).withColumn(out or f"{column}_d", x - F.col("_m")).drop("_m")


def median_split(df: DataFrame, period: Sequence[str], column: str, out: str = "above") -> DataFrame:
    """1 above the period's median, 0 at or below, null where the value isn't finite."""
    x = finite(column)
    return with_quantiles(df, period, x, [0.5], "_m").withColumn(out, (x > F.get("_m", F.lit(0))).cast("int")).drop("_m")


def lead_guarded(df: DataFrame, key: str, date: str, column: str, days: int = 95, out: str | None = None) -> DataFrame:
    """The next row's value of the same key, if its date is at most `days` later. Rows of a key: one per period."""
    w = Window.partitionBy(key).orderBy(date)
    return df.withColumn(out or f"{column}_lead", F.when(F.datediff(F.lead(date).over(w), F.col(date)) <= days, F.lead(column).over(w)))


def diff_guarded(df: DataFrame, key: str, index: str, column: str, step: int = 1, out: str | None = None) -> DataFrame:
    """Value minus that `step` rows before, if the index differs by exactly `step`."""
    w = Window.partitionBy(key).orderBy(index)
    return df.withColumn(out or f"{column}_diff", F.when(F.col(index) - F.lag(index, step).over(w) == step, F.col(column) - F.lag(column, step).over(w)))


def bins(df: DataFrame, period: Sequence[str], column: str, n: int, ties: str = "first", by: str | None = None, seed: int = 42, out: str = "bin") -> DataFrame:
    """Rank bins 1 to n of a period's finite values: ceil(rank * n / count). Ties: 'first' and 'random' rank by `by` (an identifier;
    'random' by its hash with the seed), 'average' gives equal values their mean rank. Rows without a finite value have a null bin.

    With N = 7 and n = 5 the bins are 1, 2, 3, 3, 4, 5, 5, unlike ntile. A bin is told by the last row of each bin before it: the rows
    themselves are never sorted. Identifiers are whole numbers, unique among rows of a period with equal values, or else hashed.
    """
    x = finite(column) + F.lit(0.0)
    last = lambda count: F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.floor(k * count / n)) if n > 1 else F.array().cast("array<bigint>")
    if ties == "average":
        second = None
    elif by is None:
        raise ValueError("ties by rank need an identifier")
    else:
        whole = df.schema[by].dataType.typeName() in ("byte", "short", "integer", "long")
        second = F.col(by).cast("bigint") if ties == "first" and whole else F.xxhash64(F.lit(seed), F.col(by))
    if n == 1:
        return df.withColumn(out, F.when(x.isNotNull(), F.lit(1)))
    if not period:
        return bins(df.withColumn("_all", F.lit(0)), ["_all"], column, n, ties, by, seed, out).drop("_all")
    s = order_statistics(df, period, x, last, second)
    total = F.col("_n")
    # Bins whose last row doesn't exist (fewer rows than bins) lie below every row.
    none = F.size(F.filter(last(total), lambda r: r < 1))
    on = [F.col(p).eqNullSafe(F.col(f"_g{i}")) for i, p in enumerate(period)]
    if ties == "average":
        reaches = lambda b: F.floor(((2 * (b["less"] + 1) + b["same"] - 1) * n + 2 * total - 1) / (2 * total)) > b["k"] + 1
        above = lambda b: (x > b["v"]) | ((x == b["v"]) & reaches(b))
    else:
        above = lambda b: (x > b["v"]) | ((x == b["v"]) & F.coalesce(second > b["s"], F.lit(False)))
    joined = df.join(s, on, "left")
    binned = F.when(x.isNotNull(), 1 + none + F.when(F.col("_at").isNotNull(), F.size(F.filter("_at", above))).otherwise(0)).cast("int")
    return joined.withColumn(out, binned).drop("_n", "_at", *[f"_g{i}" for i in range(max(len(period), 1))])


def break_bins(df: DataFrame, period: Sequence[str], column: str, n: int, out: str = "bin", zero: bool = False) -> DataFrame:
    """Bins by quantile breaks of the period, right-closed; with `zero`, values of 0 have bin 0 and don't count for the breaks."""
    x = finite(column)
    y = F.when(x != 0, x) if zero else x
    probs = [i / n for i in range(1, n)]
    s = with_quantiles(df, period, y, probs, "_b")
    b = F.lit(1) + sum((y > F.get("_b", F.lit(i))).cast("int") for i in range(n - 1))
    return s.withColumn(out, F.when(y.isNotNull(), b).when(x.isNotNull(), 0) if zero else F.when(y.isNotNull(), b)).drop("_b")


def cumulative(df: DataFrame, key: Sequence[str], order: str, column: str, how: str = "sum", out: str | None = None) -> DataFrame:
    """Running sum, or running growth of 1 (product of 1 + r by logarithms; null from a return of -1 or less on)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = finite(column)
    if how == "sum":
        return df.withColumn(out or f"{column}_cum", F.sum(x).over(w))
    lost = F.max((x <= -1).cast("int")).over(w)
    return df.withColumn(out or f"{column}_growth", F.when(F.coalesce(lost, F.lit(0)) == 0, F.exp(F.sum(F.log1p(F.when(x > -1, x))).over(w))))


def quarterly(monthly: DataFrame, key: str, date: str, ret: str, cap: str, least: int = 2) -> DataFrame:
    """(key, Quarter, RetQ, MCap_QEnd, n): compounded over quarters with at least so many finite returns; market value at the last month that has one."""
    q = F.trunc(F.col(date).cast("date"), "quarter").alias("Quarter")
    c = finite(cap)
    out = monthly.groupBy(key, q).agg(compound(ret).alias("RetQ"), F.max_by(c, F.when(c.isNotNull(), F.col(date))).alias("MCap_QEnd"), F.count(finite(ret)).alias("n_months"))
    return out.filter(F.col("n_months") >= least)


def collapse(df: DataFrame, keys: Sequence[str], ret: str, cap: str) -> DataFrame:
    """Securities to firms: value-weighted return, summed market value, number of securities."""
    return df.groupBy(*keys).agg(weighted_mean(ret, cap).alias("ret"), F.sum(F.when(is_finite(cap) & (F.col(cap) > 0), F.col(cap))).alias("cap"), F.count("*").alias("n"))


def turnover(members: DataFrame, period: str, item: str, first: float | None = None) -> DataFrame:
    """(period, n, n_new, turnover): share of a period's members that weren't members in the previous listed period. The first period has
    `first` (null or 1 by convention). The list of periods is small; the members never meet in one task."""
    m = members.select(period, item).distinct()
    periods = m.select(period).distinct().withColumn("_prev", F.lag(period).over(Window.orderBy(period)))
    prev = m.select(F.col(period).alias("_prev"), F.col(item).alias("_i"), F.lit(1).alias("_was"))
    x = m.join(periods, period)
    x = x.join(prev, (x["_prev"] == prev["_prev"]) & (x[item] == prev["_i"]), "left").select(x[period], x["_prev"], "_was")
    per = x.groupBy(period).agg(F.count("*").alias("n"), F.count_if(F.col("_was").isNull()).alias("n_new"), F.max("_prev").alias("_p"))
    return per.select(period, "n", "n_new", F.when(F.col("_p").isNull(), F.lit(first).cast("double")).otherwise(safe_div(F.col("n_new").cast("double"), "n")).alias("turnover"))
