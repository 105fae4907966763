"""Sources and sinks besides the Parquet tables: CSV with headers to skip, word lists, JDBC, spreadsheets, yearly folders; JSON, CSV, Parquet."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_MOST = 100_000


def factor_csv(spark: SparkSession, path: str, names: Sequence[str], key: str = "ym", pattern: str = r"^\s*[0-9]{6}\s*,", scale: float = 100.0) -> DataFrame:
    """Rows of a text file that begin with a period and a comma: (key, names) with values divided by `scale`. Headers, footers and
    sections with other periods don't match the pattern. Values that aren't numbers are null."""
    cells = F.split("value", ",")
    num = lambda i: (F.expr(f"try_cast(trim(get(split(value, ','), {i})) AS double)") / scale)
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.trim(F.get(cells, F.lit(0))).cast("int").alias(key), *[num(i + 1).alias(n) for i, n in enumerate(names)])


def tone_lists(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Positive and negative words, lower case, of a CSV with Word, Positive and Negative (a member where above 0); a missing file gives
    two empty lists, and sentiment is 0. A list goes to the driver: more than WORDS_MOST words are an error."""
    try:
        df = spark.read.csv(path, header=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return [], []
        raise

    def pick(c: str) -> list[str]:
        rows = df.filter(F.expr(f"try_cast({c} AS double) > 0")).select(F.lower("Word")).distinct().limit(WORDS_MOST + 1).collect()
        if len(rows) > WORDS_MOST:
            raise ValueError(f"more than {WORDS_MOST} words: not a word list")
        return sorted(r[0] for r in rows)

    return pick("Positive"), pick("Negative")


def word_list(path: str, key: str | None = None) -> list[str]:
    """Strings of a YAML list: the top one, or the one under `key`, which may be a path of nested keys with dots between. A list may be in
    lines or in brackets. Unquoted on, off, yes and no are words here, not booleans."""
    plain = lambda x: x.strip().strip("\"'")
    out: list[str] = []
    above: list[tuple[int, str]] = []  # keys that the line lies under, with their indentation
    for line in open(path, encoding="utf-8"):
        text = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not text.strip():
            continue
        deep = len(text) - len(text.lstrip())
        item = re.match(r"^\s*-\s+(.+)$", text)
        if item:
            while above and above[-1][0] > deep:
                above.pop()
            if (key or "") == ".".join(k for _, k in above):
                out.append(plain(item[1]))
            continue
        pair = re.match(r"^\s*([^:]+):\s*(.*)$", text)
        if pair:
            while above and above[-1][0] >= deep:
                above.pop()
            above.append((deep, plain(pair[1])))
            if pair[2].startswith("[") and (key or "") == ".".join(k for _, k in above):
                out += [plain(x) for x in pair[2].strip("[] ").split(",") if x.strip()]
    return out


def dictionary(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(dictionary, bigram) of several CSV files with a bigram column, so that all variants are scored in one pass."""
    out = None
    for name, path in paths.items():
        part = spark.read.csv(path, header=True).select(F.lit(name).alias("dictionary"), F.lower(F.trim("bigram")).alias("bigram")).filter("bigram <> ''").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def dictionary_variant(spark: SparkSession, files: dict[str, str], variant: str = "primary", override: str | None = None) -> DataFrame:
    """The dictionary of one variant: the file that `files` gives its name, or the file `override` whatever the variant. An unknown name is an
    error."""
    if override is None and variant not in files:
        raise ValueError(f"no variant {variant}; there are {', '.join(sorted(files))}")
    return dictionary(spark, {variant: override or files[variant]})


def yearly(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a glob, columns united by name, with file_year from the four digits before the extension."""
    return spark.read.option("mergeSchema", True).parquet(pattern).withColumn("file_year", F.regexp_extract(F.input_file_name(), r"(\d{4})[^/]*$", 1).cast("int"))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A pushed-down query of a database; the driver's jar has to be on the class path. Give partitionColumn, lowerBound, upperBound and
    numPartitions to read large tables in parallel (then with dbtable)."""
    r = spark.read.format("jdbc").option("url", url)
    r = r.option("dbtable", f"({query}) q") if "partitionColumn" in options else r.option("query", query)
    return r.options(**options).load()


def spreadsheet(spark: SparkSession, path: str, sheet: str | int = 0, skip: int = 0) -> DataFrame:
    """A sheet of a workbook, read on the driver (needs pandas' Excel reader)."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, skiprows=skip))


def in_list(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is among keys: a left semi join, which Spark turns into a scan filter where the key side is small."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def write(df: DataFrame, path: str, format: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite", compression: str | None = None) -> None:
    """Parquet (zstd by default), CSV with a header, or JSON, in folders by the columns of `by`."""
    w = df.write.mode(mode).format(format)
    if by:
        w = w.partitionBy(*by)
    if format == "csv":
        w = w.option("header", True)
    c = compression or ("zstd" if format == "parquet" else None)
    (w.option("compression", c) if c else w).save(path)


def rename_all(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns renamed by literal replacements, applied in order to every name."""
    new = {}
    for c in df.columns:
        n = c
        for a, b in rules:
            n = n.replace(a, b)
        new[c] = n
    return df.withColumnsRenamed(new)


def percent(c: Column) -> Column:
    return c / 100.0
