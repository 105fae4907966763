"""Column expressions on text and identifiers."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numeric import as_col


def squish(c: Column | str) -> Column:
    """Runs of white space (Unicode's separators too) to one blank, outer white space off."""
    return F.trim(F.regexp_replace(as_col(c), r"[\s\u0085\p{Z}]+", " "))


def _decomposed(code: int) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))


@cache
def _accent_table(top: int = 0x10000) -> tuple[str, str]:
    """Characters below `top` that decompose into one character and combining marks, and those characters."""
    pairs = [(chr(code), d) for code in range(0x80, top) if not 0xD800 <= code < 0xE000 and len(d := _decomposed(code)) == 1 and d != chr(code)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _ligatures() -> dict[str, str]:
    """Latin characters that decompose into several letters."""
    codes = [*range(0x130, 0x250), *range(0xFB00, 0xFB07)]
    return {chr(c): d for c in codes if len(d := _decomposed(c)) > 1 and d.isalpha()}


def fold_accents(c: Column | str) -> Column:
    """NFKD without combining marks, inside the JVM: accents off, wide and other forms of a character to its plain one, Latin ligatures to
    their letters. Characters beyond the basic plane, and others that decompose into several ones, stay: fold_nfkd does all of Unicode."""
    src, dst = _accent_table()
    one = F.regexp_replace(F.translate(as_col(c), src, dst), r"\p{Mn}", "")
    many = one
    for whole, letters in _ligatures().items():
        many = F.replace(many, F.lit(whole), F.lit(letters))
    return F.when(one.rlike("[" + "".join(_ligatures()) + "]"), many).otherwise(one)


@F.pandas_udf(StringType())
def fold_nfkd(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, for all of Unicode (Arrow batches); null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def clean_ric(c: Column | str) -> Column:
    """Upper case, trimmed, cut at the first ^; null if nothing is left. Keeps the exchange suffix."""
    t = F.trim(F.substring_index(F.upper(F.trim(as_col(c))), "^", 1))
    return F.when(t != "", t)


def clean_ticker(c: Column | str) -> Column:
    """Upper case, trimmed, without exchange suffix (from the first dot) and status marks (from the first of * ^ ~)."""
    t = F.trim(F.regexp_replace(F.substring_index(F.upper(F.trim(as_col(c))), ".", 1), r"[*^~].*$", ""))
    return F.when(t != "", t)


def ric_base(c: Column | str) -> Column:
    return F.substring_index(as_col(c), ".", 1)


def ric_suffix(c: Column | str) -> Column:
    """From the first dot on, the empty string if there is none."""
    c = as_col(c)
    return F.when(F.instr(c, ".") > 0, F.substring(c, F.instr(c, "."), F.length(c))).otherwise(F.lit(""))


def parse_flag(c: Column | str) -> Column:
    """0 or 1 from a free-text answer that holds yes or no as a word; null if it holds neither or both."""
    low = F.lower(as_col(c))
    yes, no = low.rlike(r"\byes\b"), low.rlike(r"\bno\b")
    return F.when(yes & ~no, 1).when(no & ~yes, 0)


def parse_date(c: Column) -> Column:
    """A date from epoch seconds or from a date string; null if it is neither."""
    s = c.cast("string")
    day = F.to_date(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)))
    seconds = F.when(s.rlike(r"^-?\d+(\.\d+)?([eE]\+?\d+)?$"), s).cast("double")
    return F.coalesce(day, F.to_date(F.timestamp_seconds(seconds)))
