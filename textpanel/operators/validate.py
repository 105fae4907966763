"""Agreement, correlation, stratified samples, audit snippets, multiple testing, comparison of results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, erfc, is_finite, safe_div
from .panel import break_bins, settled


def confusion(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, tp, fp, fn, tn, precision, recall, agreement) of two 0/1 columns; rows with a null in either don't count."""
    t, p = F.col(truth), F.col(predicted)
    ok = df.filter(t.isNotNull() & p.isNotNull())
    cell = lambda a, b: F.count_if((t == a) & (p == b))
    s = ok.groupBy(*groups).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    d = lambda a, b: safe_div(a.cast("double"), b)
    return s.withColumns({"precision": d(F.col("tp"), F.col("tp") + F.col("fp")), "recall": d(F.col("tp"), F.col("tp") + F.col("fn")), "agreement": d(F.col("tp") + F.col("tn"), n)})


def pairwise_agreement(df: DataFrame, item: str, rater: str, value: str, tolerance: float = 0) -> DataFrame:
    """(rater_a, rater_b, n, agree): share of common items on which two raters differ by at most `tolerance`. An item has a few raters."""
    x = df.filter(F.col(value).isNotNull() & F.col(rater).isNotNull()).groupBy(item, rater).agg(F.min(value).alias("_v"))
    y = x.select(item, F.col(rater).alias("rater_b"), F.col("_v").alias("_w"))
    met = x.withColumnRenamed(rater, "rater_a").join(y, item).filter(F.col("rater_a") < F.col("rater_b"))
    return met.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("_v") - F.col("_w")) <= tolerance).cast("double")).alias("agree"))


def average_rank(df: DataFrame, column: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean ranks of a column, ties sharing theirs. Ranks come from counts of distinct values, and these are added up within 256 stretches of
    a group between approximate percentiles, each after what lies below it: neither rows nor values of a group are all in one task."""
    keys = [f"_r{i}" for i in range(len(groups) + 1)]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys[1:], strict=True)]
    base = df.select(F.lit(0).alias("_r0"), *named, F.col(column).alias("_v"))
    breaks, _ = settled(base.groupBy(*keys).agg(F.percentile_approx(F.col("_v").cast("double"), F.array(*[F.lit(i / 256) for i in range(1, 256)]), 2_000).alias("_p")))

    def on(name: str) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"{name}{i}")) for i, k in enumerate(keys)]

    per = base.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).join(breaks.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)}), on("_h"))
    per = per.select(*keys, "_v", "_n", F.coalesce(F.size(F.filter("_p", lambda p: p < F.col("_v"))), F.lit(0)).alias("_b"))
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stretches = per.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).withColumn("_o", F.coalesce(F.sum("_m").over(below), F.lit(0)))
    stretches = stretches.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_b").alias("_hb"), "_o")
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("_u", F.sum("_n").over(w)).join(stretches, [*on("_h"), F.col("_b") == F.col("_hb")]).select(*keys[1:], "_v", (F.col("_o") + F.col("_u") - (F.col("_n") - 1) / 2.0).alias(out))
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys[1:], strict=True)] + [F.col(column).eqNullSafe(F.col("_v"))]
    return df.join(ranked, same, "left").drop(*keys[1:], "_v")


def correlations(df: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, pearson, spearman) over rows with both finite."""
    ok = df.filter(is_finite(a) & is_finite(b)).select(*groups, a, b)
    r = average_rank(average_rank(ok, a, "_ka", groups), b, "_kb", groups)
    return r.groupBy(*groups).agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ka", "_kb").alias("spearman"))


def hash_order(key: Column | str, seed: int) -> Column:
    """A pseudo-random order of whole-number keys that other engines compute alike: a multiplicative hash modulo a prime."""
    k = as_col(key).cast("bigint")
    return F.pmod(F.pmod(k, F.lit(2147483647)) * F.lit(48271) + F.lit(seed), F.lit(2147483647))


def stratified(df: DataFrame, strata: Sequence[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each stratum in pseudo-random order, the same whenever the keys are the same; adds `draw`, from 1. A partial cut of each
    stratum to its k lowest per task is the optimiser's (window group limit)."""
    w = Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)
    return df.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k)


def deciles_with_zero(df: DataFrame, measure: str, n: int = 10, period: Sequence[str] = ()) -> DataFrame:
    """Bin 0 for a measure of 0, 1 to n by quantile breaks of the other values."""
    return break_bins(df, period, measure, n, "decile", zero=True)


def snippets(sentences: DataFrame, hits: DataFrame, key: str, sentence: str, text: str, width: int = 10) -> DataFrame:
    """(key, start, snippet): `width` sentences of each document around the sentence where its most frequent bigram is densest.

    hits: (key, sentence, bigram, n). Ties: the bigram first in the alphabet, the earliest sentence. Sentences are counted from 1 in their
    order, gaps in their numbers left out. The window begins half its width less one before the sentence; it is moved inside at either
    end and holds the whole of a shorter document.
    """
    tot = hits.groupBy(key, "bigram").agg(F.sum("n").alias("_n"))
    first = tot.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("_o"), "bigram")).alias("_b")).select(key, F.col("_b.bigram").alias("bigram"))
    dense = hits.join(first, [key, "bigram"]).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("_o"), F.col(sentence).alias("_s"))).alias("_b")).select(key, F.col("_b._s").alias("_c"))
    mine = sentences.join(dense, key).select(key, F.col(sentence).alias("_s"), text, "_c")
    near = mine.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.col("_s") <= F.col("_c")).alias("_at"))
    lo = F.greatest(F.lit(1), F.col("_at") - (width // 2 - 1))
    hi = F.least(F.col("_n"), lo + width - 1)
    span = near.select(key, F.greatest(F.lit(1), hi - width + 1).alias("start"), hi.alias("_hi"), "_at")
    ranks = Window.partitionBy(key).orderBy("_s")
    numbered = mine.withColumn("_i", F.row_number().over(ranks))
    rows = numbered.join(span, key).filter((F.col("_i") >= F.col("start")) & (F.col("_i") <= F.col("_hi")))
    return rows.groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", text))), lambda x: x[text]), " ").alias("snippet"))


def label(df: DataFrame, text: str, function: Callable[[pd.Series], pd.Series], schema: str = "string") -> DataFrame:
    """df with `reply`, from a model's function on batches of texts: the place to plug in a language model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(reply=function(b[text]))

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", reply {schema}")


def parse_reply(c: Column | str) -> Column:
    """(relevant, type, direction, confidence) of the JSON object in a model's reply; null fields where it has none."""
    j = F.from_json(F.regexp_extract(as_col(c), r"(?s)\{.*\}", 0), "relevant boolean, type string, direction string, confidence double")
    return F.when(as_col(c).isNotNull(), j)


def with_p(df: DataFrame, t: str, out: str = "p") -> DataFrame:
    """Adds the two-sided normal p of a t value."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(x.abs().to_numpy(float) / math.sqrt(2)))

    return df.withColumn(out, p(F.col(t).cast("double")))


def bh_fdr(df: DataFrame, p: str, key: Sequence[str], families: Sequence[str] = ()) -> DataFrame:
    """Adds q, the false discovery rate of Benjamini and Hochberg within families of tests: p * n / rank, and the least of it from the
    largest p down. Null p are left out. A family is a table of test results, small by nature."""
    fam = Window.partitionBy(*families) if families else Window.partitionBy(F.lit(1))
    d = df.filter(F.col(p).isNotNull())
    up = fam.orderBy(F.col(p).asc(), *key)
    raw = d.withColumn("_r", F.row_number().over(up)).withColumn("_q", F.col(p) * F.count("*").over(fam) / F.col("_r"))
    down = fam.orderBy(F.col(p).desc(), *[F.col(k).desc() for k in key]).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_r", "_q")


def tidy(df: DataFrame, question: str, measure: str, sample: str, freq: str, stats: dict[str, tuple[str, str | None]], n: str) -> DataFrame:
    """Rows of the results table (question, measure, sample, freq, stat, value, t, n) from one wide row per result: stats maps a stat's
    name to its value column and t column."""
    parts = [F.struct(F.lit(s).alias("stat"), F.col(v).cast("double").alias("value"), (F.col(t).cast("double") if t else F.lit(None).cast("double")).alias("t")) for s, (v, t) in stats.items()]
    return df.select(F.lit(question).alias("question"), F.lit(measure).alias("measure"), F.lit(sample).alias("sample"), F.lit(freq).alias("freq"), F.explode(F.array(*parts)).alias("s"), F.col(n).cast("double").alias("n")).select("question", "measure", "sample", "freq", "s.stat", "s.value", "s.t", "n")


def compare(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Full outer join of two results tables: (keys, old, new, diff, status: same, changed, added, removed)."""
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), list(keys), "full")
    d = F.col("new") - F.col("old")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.abs(d) <= tolerance, "same").otherwise("changed")
    return j.select(*keys, "old", "new", d.alias("diff"), status.alias("status"))


def blind(df: DataFrame, key: str, hidden: Sequence[str], seed: int = 42, store: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheet, answers): the rows in a pseudo-random order under a number rater_id, without the `hidden` columns; and (rater_id, key, hidden) to
    join them back. Keys are unique. Rows are numbered within 256 stretches of the order, each after what lies before it, so no task holds
    them all. `store` (a checkpoint) keeps the rows, which are read for the stretches, the sheet and the answers."""
    order = hash_order(key, seed)
    rows = df.withColumns({"_h": order, "_b": F.coalesce(F.shiftright(order, 23), F.lit(-1).cast("bigint"))})
    rows = store(rows) if store else rows
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy("_b").agg(F.count("*").alias("_m")).select("_b", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    numbered = rows.join(F.broadcast(stretches), "_b").withColumn("rater_id", F.col("_o") + within).drop("_h", "_b", "_o")
    return numbered.drop(key, *hidden), numbered.select("rater_id", key, *hidden)


def rate_by_bin(coded: DataFrame, bin: str, code: str, score: str) -> DataFrame:
    """(bin, n, n_pos, pos_rate, percentile): share of rows coded 1 in each bin, and the bin's middle; uncoded rows don't count."""
    ok = coded.filter(F.col(code).isNotNull())
    return ok.groupBy(bin).agg(F.count("*").alias("n"), F.count_if(F.col(code) == 1).alias("n_pos"), F.avg((F.col(code) == 1).cast("double")).alias("pos_rate"), F.avg(score).alias("mean_score")).withColumn("percentile", F.when(F.col(bin) == 0, 0).otherwise(F.col(bin) * 10 - 5))


def hit_strata(counts: DataFrame, dictionary: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_hits, stratum): many (two or more occurrences of found bigrams), one, seed (seeds only) or clean, of each sentence of counts."""
    d = dictionary.select("bigram").distinct().withColumn("_d", F.lit(1))
    s = seeds.select("bigram").distinct().withColumn("_s", F.lit(1))
    x = counts.join(d, "bigram", "left").join(s, "bigram", "left")
    hits = F.coalesce(F.sum(F.when(F.col("_d").isNotNull() & F.col("_s").isNull(), F.col("n"))), F.lit(0))
    per = x.groupBy(*keys).agg(hits.alias("n_hits"), F.count("_s").alias("_k"))
    return per.select(*keys, "n_hits", F.when(F.col("n_hits") >= 2, "many").when(F.col("n_hits") == 1, "one").when(F.col("_k") > 0, "seed").otherwise("clean").alias("stratum"))


def call_strata(hits: DataFrame, totals: DataFrame, document: str, least: int = 2) -> DataFrame:
    """(document, h, geo): 1 with at least `least` hits, 0 without any, null between. hits: (document, n) rows; totals: (document, ...)."""
    h = hits.groupBy(document).agg(F.sum("n").alias("h"))
    out = totals.select(document).distinct().join(h, document, "left").withColumn("h", F.coalesce("h", F.lit(0)))
    return out.withColumn("geo", F.when(F.col("h") >= least, 1).when(F.col("h") == 0, 0))


def excerpts(hits: DataFrame, sentences: DataFrame, keys: Sequence[str], text: str, top: int = 6, chars: int = 800) -> DataFrame:
    """(document, excerpt): the `top` sentences of a document with most hits, in order of the text, joined and cut to `chars` characters, which
    is what a rater is shown. keys: document and sentence; hits: (keys, n). The sentences are cut to the best before they are gathered."""
    document, sentence = keys
    per = hits.groupBy(*keys).agg(F.sum("n").alias("_n"))
    best = per.withColumn("_r", F.row_number().over(Window.partitionBy(document).orderBy(F.col("_n").desc(), sentence))).filter(F.col("_r") <= top)
    rows = best.join(sentences.select(*keys, text), list(keys))
    return rows.groupBy(document).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(sentence, text))), lambda x: x[text]), " "), 1, chars).alias("excerpt"))


def model_cost(tiers: DataFrame, items: float, instances: int) -> DataFrame:
    """tiers (tier, seconds per item, accelerators per model) with hours and days that `items` would take on `instances` accelerators."""
    side_by_side = F.greatest(F.lit(1), F.floor(F.lit(instances) / F.greatest(F.col("gpus"), F.lit(1))))
    hours = F.col("s_item") * items / 3600
    return tiers.withColumns({"instances": side_by_side.cast("int"), "gpu_hours": hours, "wall_days": hours / side_by_side / 24})
