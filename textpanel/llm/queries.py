"""The queries on this package's operators: each takes (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpanel.functions.dates import month_tick, tick_month_id
from textpanel.functions.numeric import is_finite
from textpanel.plans.panel import formation_date, return_records
from textpanel.sources.tables import table

from . import percentiles as P
from . import linkage, packing, reading, terms, tokenizer, topn
from textpanel.plans.storage import stored

RARE_BELOW, COMMON_ABOVE = 5, 50  # fewer records than this; more than one in this many records


# 1: frequency of every bigram


def distinct_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Id, sentence_id, text): one row per sentence; deliveries that differ in case or spacing count once, the least text stays."""
    s = table(spark, sf_dir, "sentences", "Id", "sentence_id", "text").filter("Id IS NOT NULL AND text IS NOT NULL")
    return s.groupBy("Id", "sentence_id").agg(F.min("text").alias("text"))


def earlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gram, n, records) from the yearly batches: each bigram once per year and batch, whatever its case and separators."""
    f = table(spark, sf_dir, "feat_freq", "year", "batch", "bigram", "feat_freq", "docfreq").filter("bigram IS NOT NULL")
    gram = F.trim(F.regexp_replace(F.lower("bigram"), r"[^\p{L}\p{N}\p{M}]+", " "))
    once = f.groupBy("year", "batch", gram.alias("gram")).agg(F.max("feat_freq").alias("n"), F.max("docfreq").alias("records")).filter(F.size(F.split("gram", " ")) == 2)
    return once.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


def sentence_total(spark: SparkSession, sf_dir: str) -> int:
    """Number of sentences of the text and of the earlier batches."""
    s = table(spark, sf_dir, "sentences", "Id", "sentence_id", "text").filter("Id IS NOT NULL AND text IS NOT NULL").select("Id", "sentence_id").distinct().agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "feat_freq", "year", "batch", "n_sentences").groupBy("year", "batch").agg(F.max("n_sentences").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    return sum(r["n"] for r in s.unionAll(b).collect())


def p1_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bigram: occurrences, sentences, mark (null if neither rare nor common)."""
    total = sentence_total(spark, sf_dir)
    g = terms.ngram_counts(distinct_sentences(spark, sf_dir), "text", 2, known=earlier_counts(spark, sf_dir), lengths=[2])
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") * COMMON_ABOVE > total, "common")
    return g.select(F.col("gram").alias("bigram"), F.col("n").alias("feat_freq"), F.col("records").alias("docfreq"), mark.alias("mark"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_bigrams(spark, sf_dir).filter("mark IS NOT NULL").select("bigram", "mark")


# 2: percentiles of returns by month

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
PROFILE = {"least": 0.0, "p01": 0.01, "p05": 0.05, "p10": 0.1, **QUARTILES, "p90": 0.9, "p95": 0.95, "p99": 0.99, "most": 1.0}
FAR = 10


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = return_records(table(spark, sf_dir, "crsp_returns_monthly", "permno", "Month", "RetM"), value=True)
    return P.percentiles(P.sketches(records, ["month_id"], "RetM"), ["month_id"], PROFILE)


def p2_rank_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each month and percentile whether the value's true ranks come within the promised error of the percentile; sketches of separate
    deliveries (here: by last digit of permno) are merged first."""
    records = return_records(table(spark, sf_dir, "crsp_returns_monthly", "permno", "Month", "RetM"), value=True)
    parts = P.sketches(records.withColumn("delivery", F.col("permno") % 10), ["month_id", "delivery"], "RetM")
    read = P.percentiles(P.merge_sketches(parts, ["month_id"]), ["month_id"], QUARTILES)
    long = read.select("month_id", "n", F.explode(F.create_map(*[x for name, p in QUARTILES.items() for x in (F.lit(p), F.col(name))])).alias("prob", "value"))
    near = records.join(F.broadcast(long), "month_id").groupBy("month_id", "prob", "n").agg(F.count_if(F.col("RetM") < F.col("value")).alias("below"), F.count_if(F.col("RetM") <= F.col("value")).alias("upto"))
    return near.select("month_id", "prob", ((F.col("below") <= (F.col("prob") + P.RANK_ERROR) * F.col("n") + 1) & (F.col("upto") >= (F.col("prob") - P.RANK_ERROR) * F.col("n") - 1)).alias("within"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = return_records(table(spark, sf_dir, "crsp_returns_monthly", "permno", "Month", "RetM"), value=True)
    read = P.percentiles(P.sketches(records, ["month_id"], "RetM"), ["month_id"], QUARTILES)
    # Broadcast: one row of four numbers a month, twelve rows a year of the calendar, whatever the size of the table.
    far = F.abs(F.col("RetM") - F.col("p50")) > FAR * (F.col("p75") - F.col("p25"))
    return records.join(F.broadcast(read), "month_id").filter(far).select("permno", "month_id")


# 3: share lines of two vendors


def p3_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its votes and the confidence."""
    t = {name: table(spark, sf_dir, name) for name in ("panel_ric", "crsp_returns_monthly", "crsp_names", "exchange_region")}
    return linkage.confident_pairs(stored(linkage.voted_pairs(t["panel_ric"], t["crsp_returns_monthly"], t["crsp_names"], t["exchange_region"])))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.matches(p3_votes(spark, sf_dir)).select("ticker", "permno", F.round("confidence", 6).alias("confidence"), "agree")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("ticker", "permno").distinct()


# 4: the three securities with the highest risk, by month and industry

HOLD_FROM, HOLD_MONTHS, BEST = 3, 3, 3


def risk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month_id, siccd, permno, GeoRisk): the last known version of each firm-quarter in the three months it stands for, if the
    security has a return then."""
    e = table(spark, sf_dir, "exposure_firmquarter_crsp", "fq_id", "permno", "year", "quarter", "form_q", "GeoRisk", "siccd", "known_ts")
    e = e.filter("permno IS NOT NULL AND known_ts IS NOT NULL").withColumn("form", formation_date()).filter("form IS NOT NULL")
    last = e.groupBy("permno", "form").agg(F.max(F.struct("known_ts", "fq_id", "GeoRisk", "siccd")).alias("v")).select("permno", "form", "v.GeoRisk", "v.siccd").filter(is_finite("GeoRisk") & F.col("siccd").isNotNull())
    held = last.select("permno", "siccd", "GeoRisk", F.explode(F.sequence(month_tick("form") + HOLD_FROM, month_tick("form") + HOLD_FROM + HOLD_MONTHS - 1)).alias("tick")).select(tick_month_id("tick").alias("month_id"), "siccd", "permno", "GeoRisk")
    return held.join(return_records(table(spark, sf_dir, "crsp_returns_monthly", "permno", "Month", "RetM")), ["permno", "month_id"], "left_semi").select("month_id", "siccd", "permno", "GeoRisk")


def p4_top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(risk_candidates(spark, sf_dir), ["month_id", "siccd"], "GeoRisk", ["permno"], BEST)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_top_risk(spark, sf_dir).select("month_id", "siccd", "permno")


# 6: token ids of every document


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids, decoded, give its text again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ids = tokenizer.encode_column(docs.select("doc_id", "text", F.col("text").alias("t")), ["doc_id", "text"], "t")
    back = tokenizer.decode_column(ids.select("doc_id", F.col("text").alias("was"), "ids"), ["doc_id", "was"], "ids")
    return back.select("doc_id", (F.coalesce("was", F.lit("")) == F.col("text")).alias("same"))


# 7: windows of 2,048 tokens

WINDOW = 2048


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", WINDOW)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows are: number, tokens, share of the room that is used, least and median fill, share of the tokens that aren't a seed's
    or a split document's which the index placed."""
    tokens = lambda how: F.coalesce(F.sum(F.when(F.col("how") == how, F.col("n_tokens"))), F.lit(0)).alias(how)
    w = p7_windows(spark, sf_dir).filter("window_id IS NOT NULL").groupBy("window_id").agg(F.sum("n_tokens").alias("t"), tokens(packing.NEIGHBOUR), tokens(packing.FIT))
    near, fit = F.sum(packing.NEIGHBOUR), F.sum(packing.FIT)
    return w.agg(F.count("*").alias("windows"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * WINDOW)).alias("used"), F.min("t").alias("least"), F.median("t").alias("median"), F.try_divide(near, near + fit).alias("retrieved"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing split."""
    return p7_windows(spark, sf_dir).filter("pieces > 1").select("doc_id").distinct()


# 8: reading level

DEMANDING = 13


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    models = reading.fit(docs, table(spark, sf_dir, "reading_labels", "doc_id", "rater_id", "grade"))
    return reading.levels(docs, models)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).filter(F.col("english") & (F.col("n_words") >= reading.PROSE_LEAST) & (F.col("grade") >= DEMANDING)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_bigrams, p1_found, p2_percentiles, p2_rank_bound, p2_found, p3_votes, p3_matches, p3_found, p4_top_risk, p4_found, p6_ids, p6_round_trip, p7_windows, p7_fill, p7_found, p8_levels, p8_found)}
