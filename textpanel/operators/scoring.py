"""Dictionary measures of documents: exposure, risk, sentiment, TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, safe_div
from .tokens import words


def flags(sentences: DataFrame, keys: Sequence[str], text: str, lists: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, one 0/1 column per list): whether the sentence has any word of the list. An empty or missing list gives 0."""
    toks = sentences.select(*keys, words(text).alias("_t"))
    col = lambda ws: F.coalesce(F.arrays_overlap("_t", F.array(*[F.lit(w) for w in ws])).cast("int"), F.lit(0)) if ws else F.lit(0)
    return toks.select(*keys, *[col(ws).alias(name) for name, ws in lists.items()])


def exposure(counts: DataFrame, dictionary: DataFrame, sentence_flags: DataFrame, document: str, sentence: str) -> DataFrame:
    """Per document: B (bigrams), h (dictionary bigrams), hr / hpos / hneg (those in sentences with a risk, positive, negative word),
    exposure = h / B, risk = hr / B, pos, neg and sentiment = pos - neg; null where B is 0.

    counts has (document, sentence, bigram, n), dictionary (bigram), sentence_flags (document, sentence, risk, pos, neg). The dictionary is
    joined by the optimiser's choice; a document that has no dictionary bigram scores 0.
    """
    marked = counts.join(dictionary.select("bigram").distinct().withColumn("_d", F.lit(1)), "bigram", "left")
    per = marked.groupBy(document, sentence).agg(F.sum("n").alias("B"), F.sum(F.when(F.col("_d") == 1, F.col("n")).otherwise(0)).alias("h"))
    f = sentence_flags.select(document, sentence, "risk", "pos", "neg")
    s = per.join(f, [document, sentence], "left")
    agg = s.groupBy(document).agg(F.sum("B").alias("B"), F.sum("h").alias("h"), *[F.sum(F.when(F.col(c) == 1, F.col("h")).otherwise(0)).alias(f"h{c}") for c in ("risk", "pos", "neg")])
    out = agg.withColumns({"exposure": safe_div("h", "B"), "risk": safe_div("hrisk", "B"), "pos": safe_div("hpos", "B"), "neg": safe_div("hneg", "B")})
    return out.withColumn("sentiment", F.col("pos") - F.col("neg"))


def idf(counts: DataFrame, document: str) -> DataFrame:
    """(bigram, docfreq, w): w = ln(documents / docfreq), not smoothed. The number of documents is one row, computed from the same counts."""
    n = counts.select(document).distinct().count()
    per = counts.select(document, "bigram").distinct().groupBy("bigram").agg(F.count("*").alias("docfreq"))
    return per.withColumn("w", F.ln(F.lit(float(n)) / F.col("docfreq")))


def tfidf(counts: DataFrame, weights: DataFrame, dictionaries: DataFrame, document: str) -> DataFrame:
    """(document, dictionary, tfidf, exposure): sum of n * w over the dictionary's bigrams, by B. dictionaries: (dictionary, bigram), so all
    variants are scored in one pass over the counts. Documents without a hit have no row."""
    b = counts.groupBy(document).agg(F.sum("n").alias("B"))
    hits = counts.join(dictionaries, "bigram").join(weights.select("bigram", "w"), "bigram").groupBy(document, "dictionary").agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.sum("n").alias("h"))
    return hits.join(b, document).select(document, "dictionary", safe_div("s", "B").alias("tfidf"), safe_div("h", "B").alias("exposure"))


def variants(dictionary: DataFrame, classes: DataFrame, without: Sequence[str] = (), small: int = 0) -> DataFrame:
    """(dictionary, bigram): full; pruned, of class domain only; ex_<theme> for each theme in `without`; small, the `small` highest G2 (ties by
    bigram). dictionary: (bigram, origin, G2); classes: (bigram, class, themes). Seeds are in all of them."""
    d = dictionary.select("bigram", "origin", "G2").join(classes.select("bigram", "class", "themes"), "bigram", "left")
    seed = F.col("origin") == "seed"
    themes = F.split(F.coalesce("themes", F.lit("")), ",")
    names = [F.lit("full"), F.when(seed | (F.col("class") == "domain"), "pruned"), *[F.when(seed | ~F.array_contains(themes, t), f"ex_{t}") for t in without]]
    out = d.select("bigram", F.explode(F.array_compact(F.array(*names))).alias("dictionary")).select("dictionary", "bigram")
    if small:
        best = dictionary.filter("origin <> 'seed'").orderBy(F.col("G2").desc_nulls_last(), "bigram").limit(small).select("bigram").unionByName(dictionary.filter("origin = 'seed'").select("bigram"))
        out = out.unionByName(best.select(F.lit("small").alias("dictionary"), "bigram"))
    return out


def period_mean(scores: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means over finite values by firm and period, and n_calls; rows with a null first group are dropped."""
    return scores.filter(F.col(groups[0]).isNotNull()).groupBy(*groups).agg(*[F.avg(finite(m)).alias(m) for m in measures], F.count("*").alias("n_calls"))


def audit(scores: DataFrame, groups: Sequence[str], measure: str) -> DataFrame:
    """Mean, standard deviation, 99th percentile and share of rows above 0 of a measure."""
    x = finite(measure)
    return scores.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.99)).alias("p99"), F.avg((x > 0).cast("double")).alias("share_hit"))


def realtime(counts: DataFrame, vintages: DataFrame, document: str, year: str) -> DataFrame:
    """Scores documents of year Y with the dictionary of vintage Y - 1: vintages has (vintage, bigram). All years in one join; null where
    there is no such vintage."""
    v = vintages.select((F.col("vintage") + 1).alias(year), "bigram").distinct().withColumn("_d", F.lit(1))
    s = counts.join(v, [year, "bigram"], "left").groupBy(document, year).agg(safe_div(F.sum(F.when(F.col("_d") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("exposure"))
    known = v.select(year).distinct().withColumn("_k", F.lit(1))  # a row per vintage
    return s.join(F.broadcast(known), year, "left").select(document, year, F.when(F.col("_k") == 1, F.col("exposure")).alias("exposure"))
