"""Growing a dictionary from seeds: labels, samples, classifiers, keyness, locked and vintage dictionaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import erfc, safe_div
from .panel import break_bins
from .validate import average_rank, correlations, hash_order


def label_reference(counts: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, in_R): whether a sentence holds a seed bigram."""
    s = seeds.select("bigram").distinct().withColumn("_s", F.lit(1))
    return counts.join(s, "bigram", "left").groupBy(*keys).agg(F.coalesce(F.max("_s"), F.lit(0)).alias("in_R"))


def sample_search(labels: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k sentences without a seed in a pseudo-random order that depends on key and seed only; all if there are fewer."""
    return labels.filter("in_R = 0").orderBy(hash_order(key, seed), key).limit(k)


def model_vocabulary(counts: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k most frequent bigrams (ties by bigram) and the seeds."""
    top = counts.groupBy("bigram").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "bigram").limit(k).select("bigram")
    return top.unionByName(seeds.select("bigram")).distinct()


def naive_bayes(counts: DataFrame, labels: DataFrame, vocabulary: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """(keys, p_nb): multinomial naive Bayes probability of class 1, in the JVM. labels: (keys, y). Sentences without vocabulary have the
    prior. The scores are sums over joined log-odds: log P(w | 1) - log P(w | 0) by bigram.
    """
    x = counts.join(vocabulary.select("bigram").distinct(), "bigram", "left_semi")
    prior = labels.agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")).first()
    per = x.join(labels, list(keys)).groupBy("bigram").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    full = vocabulary.select("bigram").distinct().join(per, "bigram", "left").select("bigram", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"))
    t = full.agg(F.sum("n1"), F.sum("n0"), F.count("*")).first()
    n1, n0, v = (t[0] or 0), (t[1] or 0), t[2]
    odds = F.ln((F.col("n1") + alpha) / (n1 + alpha * v)) - F.ln((F.col("n0") + alpha) / (n0 + alpha * v)) if v else F.lit(0.0)
    base = math.log(prior["a"] / prior["b"]) if prior["a"] and prior["b"] else 0.0
    s = x.join(full.select("bigram", odds.alias("o")), "bigram").groupBy(*keys).agg(F.sum(F.col("n") * F.col("o")).alias("s"))
    return counts.select(*keys).distinct().join(s, list(keys), "left").select(*keys, (1 / (1 + F.exp(-(F.coalesce("s", F.lit(0.0)) + base)))).alias("p_nb"))


def in_folds(labels: DataFrame, keys: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """labels with `fold`, 0 to folds - 1, by a hash of the keys: the same whenever the keys are the same."""
    return labels.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int"))


def nb_search(counts: DataFrame, folded: DataFrame, vocabulary: DataFrame, keys: Sequence[str], alphas: Sequence[float] = (0.1, 0.5, 1.0)) -> DataFrame:
    """(alpha, auc): mean over folds of the area under the ROC curve of naive Bayes on the fold that it wasn't trained on. folded: (keys, y,
    fold). One plan: a fold's model is the sums of all folds less its own. Folds without both classes don't count."""
    voc = vocabulary.select("bigram").distinct()
    x = counts.join(voc, "bigram", "left_semi").join(folded, list(keys)).select(*keys, "bigram", "n", "y", "fold")
    one, zero = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    per = x.groupBy("fold", "bigram").agg(one.alias("f1"), zero.alias("f0"))
    folds = F.array(*[F.lit(r.fold) for r in folded.select("fold").distinct().orderBy("fold").collect()]).cast("array<int>")  # some folds
    every = voc.join(per.groupBy("bigram").agg(F.sum("f1").alias("a1"), F.sum("f0").alias("a0")), "bigram", "left").select("bigram", F.coalesce("a1", F.lit(0)).alias("a1"), F.coalesce("a0", F.lit(0)).alias("a0"), F.explode(folds).alias("fold"))
    rest = every.join(per, ["fold", "bigram"], "left").select("fold", "bigram", (F.col("a1") - F.coalesce("f1", F.lit(0))).alias("n1"), (F.col("a0") - F.coalesce("f0", F.lit(0))).alias("n0"))
    sizes = rest.groupBy("fold").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count("*").alias("v"))  # a row a fold
    tried = rest.join(F.broadcast(sizes), "fold").select("fold", "bigram", "n1", "n0", "t1", "t0", "v", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    odds = tried.select("fold", "bigram", "alpha", (F.ln((F.col("n1") + F.col("alpha")) / (F.col("t1") + F.col("alpha") * F.col("v"))) - F.ln((F.col("n0") + F.col("alpha")) / (F.col("t0") + F.col("alpha") * F.col("v")))).alias("o"))
    score = x.join(odds, ["fold", "bigram"]).groupBy(*keys, "alpha").agg(F.sum(F.col("n") * F.col("o")).alias("s"))
    all_rows = folded.select(*keys, "y", "fold", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    scored = all_rows.join(score, [*keys, "alpha"], "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)), 9) + F.lit(0.0))
    return auc(scored, "s", "y", ["alpha", "fold"]).filter("auc IS NOT NULL").groupBy("alpha").agg(F.avg("auc").alias("auc"))


def auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, auc): area under the ROC curve of a score for a 0/1 label, equal scores counting half; null without both classes."""
    r = average_rank(df.select(*groups, score, label), score, "_r", groups)
    s = r.groupBy(*groups).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"), F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    return s.select(*groups, safe_div(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q")).alias("auc"))


def ensemble(
    counts: DataFrame, labels: DataFrame, vocabulary: DataFrame, keys: Sequence[str], train: DataFrame, trees: int = 100, folds: int = 5, search: bool = True, seed: int = 42,
    alphas: Sequence[float] = (0.1, 0.5, 1.0), costs: Sequence[float] = (0.1, 1.0, 10.0), rounds: int = 50,
) -> DataFrame:
    """(keys, p_nb, p_c2, p_rf) for every sentence of counts: naive Bayes, a linear classifier and a random forest (pyspark.ml).

    labels: (keys, y); train: keys of the sentences to fit on. Features are exact counts of the vocabulary's bigrams, one column each; the
    vocabulary is bounded by the parameter that made it. With `search`, alpha and C are the ones with the best mean AUC over `folds` folds
    (the first of equal ones), and the linear classifier is a SVM whose margins become probabilities by a logistic fit on margins of
    sentences that the SVM wasn't fitted on (each fold's by the others' model). Without, alpha and C are 1 and it is a logistic regression.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    words = [r.bigram for r in vocabulary.select("bigram").distinct().orderBy("bigram").collect()]
    x = counts.join(vocabulary.select("bigram").distinct(), "bigram", "left_semi")
    terms = x.groupBy(*keys).agg(F.flatten(F.collect_list(F.array_repeat("bigram", F.col("n").cast("int")))).alias("terms"))
    rows = counts.select(*keys).distinct().join(terms, list(keys), "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    v = CountVectorizerModel.from_vocabulary(words or [""], "terms", "features").transform(rows).drop("terms")
    chosen = in_folds(labels.join(train.select(*keys).distinct(), list(keys), "left_semi").select(*keys, "y"), keys, folds, seed)
    fit = v.join(chosen, list(keys)).select("features", "fold", F.col("y").cast("double").alias("label")).persist()
    n = max(fit.count(), 1)
    margin = lambda model, df: model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction", "probability")
    one = VectorAssembler(inputCols=["margin"], outputCol="m")
    if search:
        score = BinaryClassificationEvaluator(rawPredictionCol="margin", metricName="areaUnderROC")
        made: dict[float, list[DataFrame]] = {}
        for c in costs:
            made[c] = [margin(LinearSVC(regParam=1.0 / (c * n), maxIter=rounds).fit(fit.filter(F.col("fold") != k)), fit.filter(F.col("fold") == k)) for k in range(folds)]
        best = max(costs, key=lambda c: (sum(score.evaluate(held) for held in made[c]) / folds, -costs.index(c)))
        out_of_fold = made[best][0]
        for held in made[best][1:]:
            out_of_fold = out_of_fold.unionByName(held)
        platt = LogisticRegression(featuresCol="m", maxIter=rounds).fit(one.transform(out_of_fold).select("m", "label"))
        linear = LinearSVC(regParam=1.0 / (best * n), maxIter=rounds).fit(fit)
        out = platt.transform(one.transform(margin(linear, v))).withColumn("p_c2", vector_to_array("probability")[1]).select(*keys, "features", "p_c2")
        found = nb_search(counts, chosen, vocabulary, keys, alphas).collect()  # a row for each alpha
        alpha = max(found, key=lambda r: (r.auc, -list(alphas).index(r.alpha))).alpha if found else 1.0
    else:
        linear = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=rounds).fit(fit)
        out = linear.transform(v).withColumn("p_c2", vector_to_array("probability")[1]).select(*keys, "features", "p_c2")
        alpha = 1.0
    forest = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=seed, maxDepth=8).fit(fit)
    fit.unpersist()
    out = forest.transform(out).withColumn("p_rf", vector_to_array("probability")[1]).select(*keys, "p_c2", "p_rf")
    return naive_bayes(counts, chosen.drop("fold"), vocabulary, keys, alpha).join(out, list(keys))


def vote(probabilities: DataFrame, columns: Sequence[str], labels: DataFrame, keys: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """(keys, in_T): a seed sentence, or any probability above the threshold."""
    above = F.greatest(*columns) > threshold if len(columns) > 1 else F.col(columns[0]) > threshold
    return probabilities.join(labels.select(*keys, "in_R"), list(keys)).select(*keys, ((F.col("in_R") == 1) | F.coalesce(above, F.lit(False))).cast("int").alias("in_T"))


def signed_g2(a: Column, c: Column, total_a: float, total_c: float) -> Column:
    """Log-likelihood statistic of a word with a of total_a in the target and c of total_c elsewhere; negative if it is rarer in the target."""
    n, ta, tc = total_a + total_c, float(total_a), float(total_c)
    w = a + c
    terms = []
    for o, row in ((a, ta), (c, tc)):
        terms.append((o, w * row / n))
        terms.append((row - o, (n - w) * row / n))
    g2 = 2 * sum((F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in terms), F.lit(0.0))
    return F.when(a * tc >= c * ta, g2).otherwise(-g2)


def keyness(counts: DataFrame, target: DataFrame, keys: Sequence[str], store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(bigram, G2, target_freq, nontarget_freq, target_docfreq, target_share) of bigrams that occur in the target; target: (keys, in_T). The
    totals are sums over the bigrams: with `store` (a checkpoint) the counts are joined with the target once, else twice."""
    x = counts.join(target.select(*keys, "in_T"), list(keys))
    per = x.groupBy("bigram").agg(F.sum(F.when(F.col("in_T") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("in_T") == 0, F.col("n")).otherwise(0)).alias("c"), F.count_if(F.col("in_T") == 1).alias("d"))
    if store:
        per = store(per)
    tot = per.agg(F.sum("a"), F.sum("c")).first()
    ta, tc = float(tot[0] or 0), float(tot[1] or 0)
    if ta + tc == 0:
        ta = tc = 1.0
    g = signed_g2(F.col("a").cast("double"), F.col("c").cast("double"), ta, tc)
    return per.filter("a > 0").select("bigram", g.alias("G2"), F.col("a").alias("target_freq"), F.col("c").alias("nontarget_freq"), F.col("d").alias("target_docfreq"), safe_div(F.col("a").cast("double"), F.col("a") + F.col("c")).alias("target_share"))


def chi2_critical(alpha: float) -> float:
    """The value that a chi-squared variable with one degree of freedom exceeds with probability alpha."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > alpha else (lo, mid)
    return hi


def with_p(key: DataFrame, out: str = "p") -> DataFrame:
    """Adds the p of |G2| (chi-squared, one degree of freedom)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(np.sqrt(x.abs().to_numpy(float) / 2)))

    return key.withColumn(out, tail("G2"))


def bonferroni(key: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds `significant` (p below alpha over the number of candidates, by the critical value, inside the JVM) and `target_only`."""
    n = key.count()
    crit = chi2_critical(alpha / max(n, 1))
    return key.withColumns({"significant": (F.abs("G2") > crit).cast("int"), "target_only": (F.col("nontarget_freq") == 0).cast("int")})


def locked_dictionary(key: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(bigram, origin, G2, target_freq, target_share): the seeds, and the k other bigrams with the highest G2 (ties by bigram)."""
    s = seeds.select("bigram").distinct()
    found = key.join(s, "bigram", "left_anti").orderBy(F.col("G2").desc(), "bigram").limit(k).withColumn("origin", F.lit("discovered"))
    seed = s.join(key, "bigram", "left").withColumn("origin", F.lit("seed"))
    cols = ["bigram", "origin", "G2", "target_freq", "target_share"]
    return seed.select(*cols).unionByName(found.select(*cols))


def significant_dictionary(key: DataFrame, seeds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(bigram): seeds and the bigrams over-represented in the target after Bonferroni's correction, the rule for vintages."""
    return bonferroni(key, alpha).filter("significant = 1 AND G2 > 0").select("bigram").unionByName(seeds.select("bigram")).distinct()


def vintage_counts(counts: DataFrame, labels: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """(year, bigram, a, c): counts in sentences with a seed and in the others."""
    x = counts.join(labels.select(*keys, F.col("in_R").alias("in_T")), list(keys))
    return x.groupBy(year, "bigram").agg(F.sum(F.when(F.col("in_T") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("in_T") == 0, F.col("n")).otherwise(0)).alias("c"))


def vintages(per: DataFrame, seeds: DataFrame, year: str, cutoffs: Sequence[int], alpha: float = 0.05) -> DataFrame:
    """(vintage, bigram): for each cutoff the significant_dictionary of text up to that year. per: vintage_counts, which should be stored, as
    it is read twice; each cutoff sums the years up to its own."""
    cut = F.explode(F.filter(F.array(*[F.lit(y) for y in cutoffs]).cast("array<int>"), lambda y: y >= F.col(year)))
    cum = per.select(cut.alias("vintage"), "bigram", "a", "c").groupBy("vintage", "bigram").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    tot = cum.groupBy("vintage").agg(F.sum("a").cast("double").alias("ta"), F.sum("c").cast("double").alias("tc"), F.count_if(F.col("a") > 0).alias("m")).collect()  # a row per cutoff
    known = per.sparkSession.createDataFrame([(r.vintage, r.ta, r.tc, chi2_critical(alpha / max(r.m, 1))) for r in tot], "vintage int, ta double, tc double, crit double")
    n, w = F.col("ta") + F.col("tc"), F.col("a") + F.col("c")
    terms = [(F.col("a"), w * F.col("ta") / n), (F.col("ta") - F.col("a"), (n - w) * F.col("ta") / n), (F.col("c"), w * F.col("tc") / n), (F.col("tc") - F.col("c"), (n - w) * F.col("tc") / n)]
    g2 = 2 * sum((F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in terms), F.lit(0.0))
    over = F.col("a") * F.col("tc") >= F.col("c") * F.col("ta")
    found = cum.filter("a > 0").join(F.broadcast(known), "vintage").filter(over & (F.round(g2, 6) > F.col("crit"))).select("vintage", "bigram")
    s = seeds.select("bigram").distinct()
    seeded = s.withColumn("vintage", F.explode(F.array(*[F.lit(y) for y in cutoffs]).cast("array<int>"))).select("vintage", "bigram")
    return found.join(s, "bigram", "left_anti").select("vintage", "bigram").unionByName(seeded)


def leave_one_out(counts: DataFrame, seeds: Sequence[str], keys: Sequence[str], k: int, spark) -> DataFrame:
    """(dropped, bigram): the k highest G2 found with each seed left out in turn, seeds not listed; one plan, a sentence counts as reference for
    `dropped` if it holds another seed. The counts are joined with the reference sentences once, however many seeds there are."""
    s = spark.createDataFrame([(x,) for x in seeds], "bigram string")
    held = counts.join(s, "bigram", "left_semi").groupBy(*keys).agg(F.min("bigram").alias("_one"), F.max("bigram").alias("_two"))
    # A sentence with one seed is lost when that one is dropped; the reference of all seeds less what is lost is that of each dropped seed.
    x = counts.join(held, list(keys)).select("bigram", "n", F.when(F.col("_one") == F.col("_two"), F.col("_one")).alias("lost"))
    of_all = x.groupBy("bigram").agg(F.sum("n").alias("r"))
    less = x.filter("lost IS NOT NULL").groupBy(F.col("lost").alias("dropped"), "bigram").agg(F.sum("n").alias("l"))
    total = counts.groupBy("bigram").agg(F.sum("n").alias("all"))
    grand = float(counts.agg(F.sum("n")).first()[0] or 0)
    each = of_all.select("bigram", "r", F.explode(F.array(*[F.lit(d) for d in seeds])).alias("dropped"))  # a row per bigram and seed: bounded by the list of seeds
    a = each.join(less, ["dropped", "bigram"], "left").select("dropped", "bigram", (F.col("r") - F.coalesce("l", F.lit(0))).alias("a")).filter("a > 0")
    ta = a.groupBy("dropped").agg(F.sum("a").cast("double").alias("ta"))  # a row per seed
    x = a.join(total, "bigram").join(F.broadcast(ta), "dropped").withColumn("c", F.col("all") - F.col("a")).withColumn("tc", F.lit(grand) - F.col("ta"))
    n, w = F.lit(grand), F.col("all")
    terms = [(F.col("a"), w * F.col("ta") / n), (F.col("ta") - F.col("a"), (n - w) * F.col("ta") / n), (F.col("c"), w * F.col("tc") / n), (F.col("tc") - F.col("c"), (n - w) * F.col("tc") / n)]
    g2 = 2 * sum((F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in terms), F.lit(0.0))
    from pyspark.sql import Window

    g = x.withColumn("G2", F.when(F.col("a") * F.col("tc") >= F.col("c") * F.col("ta"), g2).otherwise(-g2)).join(s, "bigram", "left_anti")
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("dropped").orderBy(F.round("G2", 6).desc(), "bigram"))).filter(F.col("_r") <= k).select("dropped", "bigram")


def overlap(a: DataFrame, b: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_a, n_b, n_both, overlap, jaccard) of two sets of bigrams; overlap: shared over the smaller."""
    x = a.select(*groups, "bigram").distinct().withColumn("_a", F.lit(1)).join(b.select(*groups, "bigram").distinct().withColumn("_b", F.lit(1)), [*groups, "bigram"], "full")
    s = x.groupBy(*groups).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    both = F.col("n_both").cast("double")
    return s.withColumns({"overlap": safe_div(both, F.least("n_a", "n_b")), "jaccard": safe_div(both, F.col("n_a") + F.col("n_b") - F.col("n_both"))})


def perturbed_measure(counts: DataFrame, dictionary: DataFrame, dropped: DataFrame, seeds: Sequence[str], document: str) -> DataFrame:
    """(dropped, n, pearson, spearman): every document scored with the dictionary found without a seed (its rows of `dropped`: (dropped, bigram))
    and the other seeds, against its score with `dictionary`. counts: (document, bigram, n). One plan; a row per document and seed.
    """
    each = F.explode(F.array(*[F.lit(x) for x in seeds])).alias("dropped")  # bounded by the list of seeds
    spark = counts.sparkSession
    others = spark.createDataFrame([(d, x) for d in seeds for x in seeds if x != d], "dropped string, bigram string")
    member = dropped.select("dropped", "bigram").unionByName(others).distinct()
    hits = counts.join(member, "bigram").groupBy(document, "dropped").agg(F.sum("n").alias("h"))
    full = counts.join(dictionary.select("bigram").distinct().withColumn("_d", F.lit(1)), "bigram", "left").groupBy(document).agg(F.sum("n").alias("B"), F.sum(F.when(F.col("_d") == 1, F.col("n")).otherwise(0)).alias("h0"))
    scored = full.select(document, "B", "h0", each).join(hits, [document, "dropped"], "left").select("dropped", (F.col("h0") / F.col("B")).alias("a"), (F.coalesce("h", F.lit(0)) / F.col("B")).alias("b"))
    return correlations(scored, "a", "b", ["dropped"])


def divergence(vintages: DataFrame, dictionary: DataFrame, top: int = 1000) -> DataFrame:
    """(vintage, n_terms, cover_full, cover_top, jaccard_full): how much of a dictionary (bigram, G2) and of its `top` terms by G2 each vintage
    holds. Terms without a G2 come last."""
    best = dictionary.orderBy(F.col("G2").desc_nulls_last(), "bigram").limit(top).select("bigram").withColumn("_t", F.lit(1))
    d = dictionary.select("bigram").distinct().join(best, "bigram", "left").withColumn("_f", F.lit(1))
    sizes = d.agg(F.count("*"), F.count("_t")).first()
    s = vintages.select("vintage", "bigram").distinct().join(d, "bigram", "left").groupBy("vintage").agg(F.count("*").alias("n_terms"), F.count("_f").alias("_f"), F.count("_t").alias("_t"))
    full, few = F.lit(float(sizes[0])), F.lit(float(sizes[1]))
    return s.select("vintage", "n_terms", safe_div("_f", full).alias("cover_full"), safe_div("_t", few).alias("cover_top"), safe_div("_f", F.col("n_terms") + full - F.col("_f")).alias("jaccard_full"))


def top_terms(key: DataFrame, k: int = 100, bins: int = 5) -> DataFrame:
    """(bigram, G2, size, bin): the k highest G2 (ties by bigram), the root that its size is drawn by, and its bin by quantile breaks."""
    best = key.orderBy(F.col("G2").desc(), "bigram").limit(k)
    return break_bins(best.withColumn("size", F.sqrt(F.greatest("G2", F.lit(0.0)))), [], "G2", bins).select("bigram", "G2", "size", "bin")


def classify(terms: DataFrame, themes: Mapping[str, Sequence[str]], generic: Sequence[str], filler: Sequence[str] = (), leads: Sequence[str] = ()) -> DataFrame:
    """(bigram, class, themes): domain, domain+generic, generic or noise. A word belongs to a theme if it equals a keyword, or holds one of more
    than four letters. Filler and bigrams that begin with a lead word are domain if they have a theme and no generic word, else noise."""
    toks = F.split("bigram", " ")

    def has(words: Sequence[str]) -> Column:
        exact = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in words]))
        part = F.lit(False)
        for w in words:
            if len(w) > 4:
                part = part | F.col("bigram").contains(w)
        return exact | part

    named = F.filter(F.array(*[F.when(has(ws), F.lit(t)) for t, ws in themes.items()]), lambda x: x.isNotNull())
    gen = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in generic])) if generic else F.lit(False)
    fill = F.col("bigram").isin(list(filler)) if filler else F.lit(False)
    lead = F.get(toks, F.lit(0)).isin(list(leads)) if leads else F.lit(False)
    th = F.size("themes") > 0
    return terms.select("bigram", named.alias("themes"), gen.alias("_g"), (fill | lead).alias("_f")).select(
        "bigram", F.when(F.col("_f"), F.when(th & ~F.col("_g"), "domain").otherwise("noise")).when(th & ~F.col("_g"), "domain").when(th, "domain+generic").when(F.col("_g"), "generic").otherwise("noise").alias("class"), F.array_join("themes", ",").alias("themes")
    )


def propose(classified: DataFrame) -> DataFrame:
    """Adds `decision`: keep for domain, review where a generic word comes with a theme, drop for the rest."""
    return classified.withColumn("decision", F.when(F.col("class") == "domain", "keep").when(F.col("class") == "domain+generic", "review").otherwise("drop"))


def finalise(proposed: DataFrame, decisions: DataFrame) -> DataFrame:
    """(bigram, decision): proposals after people's decisions (bigram, decision) on some of them; what is still under review is dropped."""
    said = decisions.filter("bigram IS NOT NULL AND decision IS NOT NULL").groupBy("bigram").agg(F.max("decision").alias("_d"))
    out = proposed.join(said, "bigram", "left").withColumn("decision", F.coalesce("_d", "decision"))
    return out.select("bigram", F.when(F.col("decision") == "keep", "keep").otherwise("drop").alias("decision"))
