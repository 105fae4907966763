"""Frequency of every n-gram by suffix sorting.

Each position of a record gives one suffix, cut after `size` words: it stands for all n-grams that begin there. Suffixes are routed by
their first word, sorted in reverse lexicographic order within partitions, and one pass with a stack of `size` + 1 levels adds up the
counts of all prefixes: a level is popped, and its n-gram written, as soon as a suffix no longer shares it.

The set of records of an n-gram need not be kept: a suffix carries, for each of its prefixes, whether it is the prefix's first
occurrence in its record. The number of records is then a sum like the number of occurrences, and suffixes can be added up before the
shuffle and in any order. Counts of n-grams whose text is gone join them as suffixes that count at their own length only. The root of the stack (the empty n-gram) counts words and records of the whole collection.

A first word that holds much of the collection doesn't end in one task: suffixes are routed by the first word and one of `spread`
classes of the second, so only its own total, one row per class, is added up afterwards.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w\w+")
#: Separates words in a routed suffix: sorts below every word character, and is none.
SEP = "\x01"


def words(text: str) -> list[str]:
    """Lower case, NFKD without combining marks, runs of at least two letters, digits and underscores."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return WORD.findall(text)


def _suffixes(batches: Iterator[pa.RecordBatch], size: int, most: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Column 0 of the batches is text. Suffix counts (see _batch), added up until `most` different ones are held."""
    held: dict[tuple[str, ...], list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            values = [held[k] for k in part]
            yield pa.record_batch(
                [
                    pa.array([k[0] if k else "" for k in part], pa.string()),
                    pa.array([crc32(k[1].encode()) % spread if len(k) > 1 else 0 for k in part], pa.int32()),
                    pa.array([SEP.join(k) for k in part], pa.string()),
                    *[pa.array([v[i] for v in values], pa.int64()) for i in range(size + 2)],
                    pa.array([0] * len(part), pa.int64()),
                ],
                names=["head", "part", "suffix", "n", *[f"r{k}" for k in range(size + 1)], "own"],
            )
        held.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            row = words(text or "")
            root = held.get(())
            if root is None:
                root = held[()] = [0] * (size + 2)
            root[1] += 1
            seen: set[tuple[str, ...]] = set()
            for i in range(len(row)):
                suffix = tuple(row[i : i + size])
                v = held.get(suffix)
                if v is None:
                    v = held[suffix] = [0] * (size + 2)
                v[0] += 1
                for k in range(1, len(suffix) + 1):
                    prefix = suffix[:k]
                    if prefix not in seen:
                        seen.add(prefix)
                        v[k + 1] += 1
            if len(held) >= most:
                yield from flush()
    yield from flush()


def _stack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Suffixes (suffix, n, r0 ... r<size>, own), sorted downwards, to n-grams (gram, length, n, records). n counts for all prefixes, r<k> for the
    prefix of k words, own for the whole suffix alone."""
    open_words: list[str] = []
    counts = [[0, 0, 0] for _ in range(size + 1)]  # of the open prefix of each length: occurrences, records, occurrences of its own
    rows: list[tuple[str, int, int, int]] = []

    def pop(to: int) -> None:
        """Closes the open prefixes longer than `to`."""
        while len(open_words) > to:
            k = len(open_words)
            n, r, own = counts[k]
            if n or own or r:  # else it is only the begin of a known n-gram
                rows.append((" ".join(open_words), k, n + own, r))
            counts[k - 1][0] += n
            counts[k] = [0, 0, 0]
            open_words.pop()

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["gram", "length", "n", "records"])

    for batch in batches:
        suffixes, n, *records, own = (c.to_pylist() for c in batch.columns)
        for i, suffix in enumerate(suffixes):
            new = suffix.split(SEP) if suffix else []
            shared = 0
            while shared < len(open_words) and shared < len(new) and open_words[shared] == new[shared]:
                shared += 1
            pop(shared)
            open_words.extend(new[shared:])
            counts[len(new)][0] += n[i]
            counts[len(new)][2] += own[i]
            for k in range(len(new) + 1):
                counts[k][1] += records[k][i]
        if len(rows) >= 20_000:
            yield out()
    pop(0)
    if counts[0][1]:
        rows.append(("", 0, counts[0][0], counts[0][1]))
    if rows:
        yield out()


def ngram_counts(texts: DataFrame, text: str, size: int = 2, known: DataFrame | None = None, lengths: Sequence[int] | None = None, hold: int = 100_000, spread: int = 16) -> DataFrame:
    """Every n-gram of up to `size` words, with its number of occurrences and of records; each row of `texts` is a record.

    Out: gram (words joined by one blank), length, n, records, for the `lengths` asked for (by default 1 to size). Length 0 is the
    empty gram: n is the number of words, records the number of rows of `texts`. Null and empty texts are records without words. An
    empty table gives no row. `known` may add counts of text that is gone: rows (gram, n, records) with grams of 1 to `size` words
    joined by one blank; they count at their own length only, null grams and counts as nothing. A task holds about `hold` different
    suffixes before it passes them on; that doesn't change the result.
    """
    asked = list(range(1, size + 1)) if lengths is None else list(lengths)
    counts = ["n", *[f"r{k}" for k in range(size + 1)], "own"]
    schema = f"head string, part int, suffix string, {', '.join(f'{c} bigint' for c in counts)}"
    routed = texts.select(F.col(text).alias("text")).mapInArrow(lambda it: _suffixes(it, size, hold, spread), schema)
    if known is not None:
        w = F.split("gram", " ")
        given = known.filter("gram IS NOT NULL AND gram <> ''").withColumn("_w", w).filter(F.size("_w") <= size)
        zero = F.lit(0).cast("bigint")
        records = [F.when(F.size("_w") == k, F.coalesce(F.col("records"), zero)).otherwise(zero).alias(f"r{k}") for k in range(size + 1)]
        part = F.when(F.size("_w") > 1, F.crc32(F.get("_w", F.lit(1))) % spread).otherwise(0).cast("int")
        routed = routed.unionByName(given.select(F.get("_w", F.lit(0)).alias("head"), part.alias("part"), F.array_join("_w", SEP).alias("suffix"), zero.alias("n"), *records, F.coalesce(F.col("n"), zero).cast("bigint").alias("own")))
    ordered = routed.repartition("head", "part").sortWithinPartitions(F.col("suffix").desc())
    counted = ordered.select("suffix", *counts).mapInArrow(lambda it: _stack(it, size), "gram string, length int, n bigint, records bigint")
    long, short = [k for k in asked if k > 1], [k for k in asked if k < 2]
    parts = []
    if long:
        parts.append(counted.filter(F.col("length").isin(long)))
    if short:  # a first word has one row for each class of second words
        parts.append(counted.filter(F.col("length").isin(short)).groupBy("gram", "length").agg(F.sum("n").alias("n"), F.sum("records").alias("records")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
