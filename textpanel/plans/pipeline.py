"""The whole way from turns to scored calls and firm-quarters, under one Config. Every stage is a plain DataFrame plan; store what is
read more than once (counts, scores) where the session keeps its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SAFE_HARBOR_SENTENCE, Config
from ..functions.text import parse_date
from ..operators import corpus, discovery, scoring, tokens
from .storage import stored

CALL = ("companyTicker", "eventYear", "eventQuarter")


def build_calls(turns: DataFrame, config: Config, languages: Sequence[str] = ("en",)) -> DataFrame:
    """(Id, ticker, year, quarter, date, text) from (Id, companyTicker, eventYear, eventQuarter, expirationDate, secIdx, speakerGroup, speech):
    operator and empty turns off, stage directions and boilerplate off as configured, turns joined, calls of other languages dropped."""
    t = corpus.drop_empty(corpus.drop_operator(turns))
    text = F.col("speech")
    if config.boilerplate in ("once", "iter"):
        text = (corpus.boilerplate_once if config.boilerplate == "once" else corpus.boilerplate_iter)(text)
    if config.markers:
        text = corpus.strip_markers(text)
    c = corpus.concat_turns(t.withColumn("speech", text), "Id", "secIdx", "speech", [*CALL, "expirationDate"])
    kept = c.filter(corpus.detect_language("text").isin(list(languages))) if languages else c
    return kept.select("Id", F.col("companyTicker").alias("ticker"), F.col("eventYear").alias("year"), F.col("eventQuarter").alias("quarter"), parse_date(F.col("expirationDate")).alias("date"), "text")


def build_sentences(calls: DataFrame, config: Config) -> DataFrame:
    """(Id, year, sentence_id, text): sentences long enough, legal ones off if configured."""
    s = corpus.min_length(corpus.split_sentences(calls, "text", ["Id", "year"]), chars=config.min_chars)
    return corpus.drop_safe_harbor(s) if config.sentence_safe_harbor else s


def funnel(turns: DataFrame, year: str = "eventYear", key: str = "Id", text: str = "speech") -> DataFrame:
    """Per year: turns as they came, after the operator's and after empty ones are dropped, calls left, characters left. One pass."""
    spoken = F.col("speakerGroup").isNull() | (F.col("speakerGroup") != "Operator")
    full = spoken & F.col(key).isNotNull() & (F.length(text) > 0)
    return turns.groupBy(year).agg(
        F.count("*").alias("n_rows_raw"), F.countDistinct(key).alias("n_calls_raw"), F.count_if(spoken).alias("n_rows_after_operator_drop"), F.count_if(full).alias("n_rows_after_na_drop"),
        F.countDistinct(F.when(full, F.col(key))).alias("n_calls"), F.coalesce(F.sum(F.when(full, F.length(text))), F.lit(0)).cast("bigint").alias("n_chars"),
    )


def audit_funnel(turns: DataFrame, config: Config, year: str = "eventYear", key: str = "Id", text: str = "speech", language: str = "en") -> DataFrame:
    """Per year the fourteen counters of the way from turns to sentences: turns and calls as they came, turns after the operator's and after
    empty ones are dropped, characters stripped and their share in percent, calls joined, in the language and not, sentences, their mean by
    call, those long enough, those without a legal phrase, and those dropped for one. A turn without a key counts as raw only.

    Sentences are counted where they are split: no sentence is shuffled.
    """
    spoken = F.col("speakerGroup").isNull() | (F.col("speakerGroup") != "Operator")
    full = spoken & F.col(key).isNotNull() & (F.length(text) > 0)
    clean = corpus.strip_markers(text) if config.markers else F.col(text)
    t = turns.withColumns({"_full": full, "_clean": F.when(full, clean)})
    before, after = F.coalesce(F.sum(F.when(full, F.length(text))), F.lit(0)), F.coalesce(F.sum(F.length("_clean")), F.lit(0))
    rows = t.groupBy(year).agg(F.count("*").alias("n_rows_raw"), F.countDistinct(key).alias("n_calls_raw"), F.count_if(spoken).alias("n_rows_after_operator_drop"), F.count_if(F.col("_full")).alias("n_rows_after_na_drop"), (before - after).alias("chars_stripped"), F.round(100 * (before - after) / F.when(before > 0, before), 2).alias("chars_stripped_pct"))
    calls = corpus.concat_turns(t.filter("_full").select(key, "secIdx", year, F.col("_clean").alias(text)), key, "secIdx", text, [year]).withColumn("_in", F.coalesce(corpus.detect_language("text") == language, F.lit(False)))
    parts = F.when(F.col("_in"), corpus.sentence_array("text"))
    long = F.filter("_p", lambda x: F.char_length(x) >= config.min_chars)
    legal = F.filter("_l", lambda x: ~x.rlike(f"(?i){SAFE_HARBOR_SENTENCE}"))
    per = calls.select(year, "_in", parts.alias("_p")).withColumn("_l", long).withColumn("_s", legal if config.sentence_safe_harbor else F.col("_l"))
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("bigint")
    n = per.groupBy(year).agg(F.count("*").alias("n_calls_reconstructed"), F.count_if("_in").alias("n_calls_english"), size("_p").alias("n_sentences"), size("_l").alias("n_sentences_after_minlen"), size("_s").alias("n_sentences_after_safeharbor_filter"))
    out = rows.join(n.withColumnRenamed(year, "_y"), F.col(year).eqNullSafe(F.col("_y")), "left").drop("_y")
    zero = [c for c in n.columns if c != year]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in zero})
    return out.withColumns({
        "n_calls_dropped_nonenglish": F.col("n_calls_reconstructed") - F.col("n_calls_english"), "n_sentences_dropped_safeharbor": F.col("n_sentences_after_minlen") - F.col("n_sentences_after_safeharbor_filter"),
        "mean_sentences_per_call": F.round(F.col("n_sentences") / F.when(F.col("n_calls_english") > 0, F.col("n_calls_english")), 2),
    })


def find_dictionary(counts: DataFrame, config: Config, classify: bool = False) -> DataFrame:
    """The locked dictionary of counts (Id, sentence_id, bigram, n): seed sentences against the rest, or, with `classify`, the sentences that
    three classifiers call alike as well."""
    keys = ["Id", "sentence_id"]
    seeds = counts.sparkSession.createDataFrame([(s,) for s in config.seeds], "bigram string")
    labels = discovery.label_reference(counts, seeds, keys)
    if classify:
        labels = stored(labels)
        voc = discovery.model_vocabulary(counts, seeds, config.model_vocab)
        rest = discovery.sample_search(labels.withColumn("_k", F.xxhash64(*keys)), "_k", config.sample_size, config.seed).select(*keys)
        p = discovery.ensemble(counts, labels.withColumnRenamed("in_R", "y"), voc, keys, rest.unionByName(labels.filter("in_R = 1").select(*keys)), folds=config.folds, search=config.search, seed=config.seed)
        target = discovery.vote(p, ["p_nb", "p_c2", "p_rf"], labels, keys, config.p_threshold)
    else:
        target = labels.withColumnRenamed("in_R", "in_T")
    return discovery.locked_dictionary(discovery.keyness(tokens.trim(counts, config.min_docfreq), target, keys, stored), seeds, config.dictionary_top)


def score_calls(sentences: DataFrame, counts: DataFrame, dictionary: DataFrame, config: Config, positive: Sequence[str] = (), negative: Sequence[str] = ()) -> DataFrame:
    """Exposure, risk, sentiment and TF-IDF of each call. Without tone lists the sentiment is 0."""
    keys = ["Id", "sentence_id"]
    f = scoring.flags(sentences, keys, "text", {"risk": config.risk_words, "pos": positive, "neg": negative})
    base = scoring.exposure(counts, dictionary, f, "Id", "sentence_id")
    w = scoring.tfidf(tokens.group(counts, ["Id"]), scoring.idf(counts, "Id"), dictionary.select(F.lit("primary").alias("dictionary"), "bigram"), "Id").select("Id", "tfidf")
    return base.join(w, "Id", "left").withColumn("tfidf", F.coalesce("tfidf", F.when(F.col("B") > 0, F.lit(0.0))))


def firm_quarters(scores: DataFrame, calls: DataFrame, measures: Sequence[str] = ("exposure", "risk", "sentiment", "tfidf")) -> DataFrame:
    """Means of the measures by ticker, year and quarter."""
    return scoring.period_mean(scores.join(calls.select("Id", "ticker", "year", "quarter"), "Id"), ["ticker", "year", "quarter"], measures)
