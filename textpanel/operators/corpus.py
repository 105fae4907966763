"""From speaker turns to cleaned calls and sentences.

Nulls: a null text stays null in every cleaning step; a null speaker group counts as a speaker. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MARKERS, SAFE_HARBOR, SAFE_HARBOR_ENDS, SAFE_HARBOR_SENTENCE
from ..functions.numeric import as_col
from ..functions.text import squish

#: Frequent function words by language, for detect_language.
PROFILES = {
    "en": ("the", "of", "and", "to", "in", "is", "we", "our", "for", "that"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "wir", "von", "mit", "den"),
    "fr": ("le", "la", "les", "des", "et", "est", "nous", "pour", "dans", "du"),
    "es": ("el", "los", "las", "del", "y", "es", "para", "por", "con", "una"),
}


def drop_operator(turns: DataFrame, group: str = "speakerGroup", operator: str = "Operator") -> DataFrame:
    """Turns that are not the operator's."""
    return turns.filter(F.col(group).isNull() | (F.col(group) != operator))


def drop_empty(turns: DataFrame, key: str = "Id", text: str = "speech") -> DataFrame:
    """Turns with a key and a text of at least one character."""
    return turns.filter(F.col(key).isNotNull() & (F.length(text) > 0))


def strip_markers(c: Column | str) -> Column:
    """Stage directions to a blank, then white space squished."""
    return squish(F.regexp_replace(as_col(c), f"(?i){MARKERS}", " "))


def boilerplate_once(c: Column | str) -> Column:
    """Cuts a text at the end of its legal boilerplate.

    If the safe-harbour pattern occurs: from the match of the first end pattern that occurs (first in the list, wherever in the
    text else from one character after the begin of the next paragraph or sentence break; else the text as it is.
    """
    c = as_col(c)
    after = F.regexp_replace(c, rf"(?is)^.*?({SAFE_HARBOR})", "")
    tail = F.regexp_extract(after, r"(?s)(?:\n\n|\. [A-Z]).*$", 0)
    cut = F.when(tail != "", F.substring(tail, 2, 1 << 30)).otherwise(c)
    for p in reversed(SAFE_HARBOR_ENDS):
        found = F.regexp_extract(c, f"(?is)(?:{p}).*$", 0)
        cut = F.when(found != "", found).otherwise(cut)
    return F.when(c.rlike(f"(?i){SAFE_HARBOR}"), cut).otherwise(c)


def boilerplate_iter(c: Column | str, rounds: int = 20) -> Column:
    """boilerplate_once until nothing changes, at most `rounds` times; inside the JVM, as a fold over a sequence."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), as_col(c), lambda text, _: boilerplate_once(text))


def concat_turns(turns: DataFrame, key: str, order: str, text: str, first: Sequence[str] = ()) -> DataFrame:
    """One row per key: its turns in order, joined by a blank, and `first` columns of its first turn.

    Equal `order` values are ordered by text; null texts are left out. A call is a bounded number of turns; its text is what the
    result holds anyway.
    """
    turn = F.struct(F.col(order), F.col(text))
    heads = [F.min_by(F.col(c), F.struct(F.col(order), F.col(text))).alias(c) for c in first]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t[text]), " ")
    return turns.groupBy(key).agg(joined.alias("text"), *heads)


def detect_language(c: Column | str, chars: int | None = None) -> Column:
    """The language whose function words occur most in the text, or in its first `chars` characters; ties to the first in alphabetical order,
    null if none."""
    text = as_col(c) if chars is None else F.substring(as_col(c), 1, chars)
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def best(w: Column) -> Column:
        counted = [F.struct(F.size(F.filter(w, _member(profile))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, profile) in enumerate(sorted(PROFILES.items()))]
        return F.array_max(F.array(*counted))

    top = F.get(F.transform(F.array(words), best), F.lit(0))  # so that the text is split once
    return F.when(top["n"] > 0, top["lang"])


def _member(words: Sequence[str]):
    listed = F.array(*[F.lit(w) for w in words])
    return lambda w: F.array_contains(listed, w)


def sentence_array(c: Column | str) -> Column:
    """The sentences of a text, in order, without outer blanks."""
    return F.transform(F.split(as_col(c), r"(?<=[.!?])\s+(?=\p{Lu})|\n+"), lambda x: F.trim(x))


def split_sentences(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """(keep, sentence_id, text): a sentence ends at . ! or ? before white space and an upper-case letter, or at a line end; ids count
    from 1. A null text has no sentences."""
    return df.select(*keep, F.posexplode(sentence_array(text)).alias("_p", "text")).select(*keep, (F.col("_p") + 1).alias("sentence_id"), "text")


def min_length(df: DataFrame, text: str = "text", chars: int = 5) -> DataFrame:
    """Rows whose text has that many characters; ids keep their gaps."""
    return df.filter(F.char_length(text) >= chars)


def drop_safe_harbor(df: DataFrame, text: str = "text") -> DataFrame:
    """Sentences without a legal phrase; null texts are dropped too."""
    return df.filter(~F.col(text).rlike(f"(?i){SAFE_HARBOR_SENTENCE}"))


def call_counts(calls: DataFrame, sentences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """calls with n_sentences (0 if none) and n_chars of the cleaned text (null for a null text)."""
    n = sentences.groupBy(key).agg(F.count("*").alias("n_sentences"))
    return calls.join(n, key, "left").withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0).cast("bigint"))).withColumn("n_chars", F.char_length(text))


def audit(df: DataFrame, groups: Sequence[str], text: str, key: str) -> DataFrame:
    """Per group: rows, distinct keys, null and empty texts, mean and median characters."""
    n = F.char_length(text)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(text).isNull()).alias("n_null"), F.count_if(n == 0).alias("n_empty"),
        F.avg(n).alias("mean_chars"), F.percentile(n, F.lit(0.5)).alias("median_chars"),
    )
