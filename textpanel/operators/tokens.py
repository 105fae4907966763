"""Words, bigrams and document-feature counts in long form: one row per document and feature, with its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from ..functions.text import fold_accents

WORD = r"[\p{L}\p{N}_]{2,}"


def words(c: Column | str) -> Column:
    """Accents off, lower case, all runs of at least two letters, digits and underscores; null for a null text."""
    return F.regexp_extract_all(fold_accents(F.lower(as_col(c))), F.lit(WORD), F.lit(0))


def icu_like_words(c: Column | str) -> Column:
    """The older rule: tokens at white space, outer punctuation off, and only those that are letters, digits and underscores throughout
    and at least two long; a hyphenated word is dropped whole."""
    raw = F.transform(F.split(F.lower(as_col(c)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    return F.filter(raw, lambda w: w.rlike(rf"^{WORD}$"))


def without(tokens: Column | str, stop: Sequence[str]) -> Column:
    """Tokens that are not in the list, in order, repeats kept."""
    if not stop:
        return as_col(tokens)
    listed = F.array(*[F.lit(w) for w in stop])
    return F.filter(as_col(tokens), lambda w: ~F.array_contains(listed, w))


def bigrams(tokens: Column | str) -> Column:
    """Adjacent pairs joined by a blank; an empty array below two tokens. Removed stop words are bridged."""
    t = as_col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def dfm(docs: DataFrame, keys: Sequence[str], text: str, stop: Sequence[str] = ()) -> DataFrame:
    """(keys, bigram, n): counts of each bigram per document. The token array is materialised once, before positional work."""
    toks = docs.select(*keys, without(words(text), stop).alias("_t"))
    return toks.select(*keys, F.explode(bigrams("_t")).alias("bigram")).groupBy(*keys, "bigram").agg(F.count("*").alias("n"))


def totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of bigrams per document."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("B"))


def docfreq(counts: DataFrame) -> DataFrame:
    """(bigram, feat_freq, docfreq) of counts with one row per document and bigram."""
    return counts.groupBy("bigram").agg(F.sum("n").alias("feat_freq"), F.count("*").alias("docfreq"))


def trim(counts: DataFrame, least: int) -> DataFrame:
    """Counts of bigrams that occur in at least so many documents."""
    return counts.join(docfreq(counts).filter(F.col("docfreq") >= least).select("bigram"), "bigram", "left_semi")


def match(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of the vocabulary's bigrams; documents without any have no row."""
    return counts.join(vocabulary.select("bigram").distinct(), "bigram", "left_semi")


def group(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts summed to coarser documents."""
    return counts.groupBy(*keys, "bigram").agg(F.sum("n").alias("n"))


def check_seeds(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """(bigram, valid, present): whether each seed has exactly two words, and whether it occurs at all."""
    there = counts.select("bigram").distinct().withColumn("present", F.lit(True))
    return seeds.join(there, "bigram", "left").select("bigram", (F.size(F.split("bigram", " ")) == 2).alias("valid"), F.coalesce("present", F.lit(False)).alias("present"))
