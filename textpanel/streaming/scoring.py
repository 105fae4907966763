"""Scoring of arriving sentences, as an extension: the batch operators are bounded, this keeps yearly totals up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokens import bigrams, without, words


def score_stream(sentences: DataFrame, dictionary: list[str], stop: tuple[str, ...] = (), window: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """(start, B, h, exposure) of each window of a stream of (ts, text): bigrams, dictionary bigrams, their ratio. Rows later than `late`
    are dropped. A timestamp without time zone is taken as UTC: watermarks need one with a zone."""
    listed = F.array(*[F.lit(x) for x in dictionary])
    s = sentences.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(ts, without(words("text"), stop).alias("_t")).select(ts, bigrams("_t").alias("_b"))
    scored = s.select(ts, F.size("_b").alias("B"), F.size(F.filter("_b", lambda x: F.array_contains(listed, x))).alias("h"))
    g = scored.groupBy(F.window(ts, window).alias("w")).agg(F.sum("B").alias("B"), F.sum("h").alias("h"))
    return g.select(F.col("w.start").alias("start"), "B", "h", F.when(F.col("B") > 0, F.col("h") / F.col("B")).alias("exposure"))
