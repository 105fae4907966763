"""Pairs that one exact word, or a market value, would have kept apart: each failed while candidates hung on it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from textpanel.llm import linkage

NAN = float("nan")


def lines(spark, rows, key, kind):
    """rows (line, q, name, ret, cap) as lines of the linkage."""
    by = {}
    for line, q, name, r, c in rows:
        quarters, firsts = by.setdefault(line, ({}, set()))
        quarters[q] = (q, NAN if r is None else r, NAN if c is None else c)
        firsts.add(name)
    data = [(line, [v for _, v in sorted(quarters.items())], list(firsts), [1]) for line, (quarters, firsts) in by.items()]
    df = spark.createDataFrame(data, f"{key} {kind}, s array<struct<q:int,r:float,c:float>>, names array<string>, sic array<int>")
    return df.withColumn("firsts", F.array_distinct(F.transform("names", lambda n: F.get(linkage.name_words(n), F.lit(0)))))


def pairs(spark, a, b, names):
    named = dict(names)
    right = lines(spark, [(p, q, named[p], r, c) for p, q, r, c in b], "permno", "long")
    got = linkage.candidates(lines(spark, [(t, q, n, r, c) for t, q, n, r, c in a], "ticker", "string"), right).collect()
    return {(r.ticker, r.permno) for r in got}


def test_a_letter_more_less_or_swapped(spark):
    a = [("X", 1, "KACCOR Inc", None, 2.0), ("Y", 1, "KAOR Inc", None, 2.0), ("Z", 1, "KAOCR Inc", None, 2.0), ("W", 1, "MERION Inc", None, 2.0)]
    assert pairs(spark, a, [(1, 1, None, 2.0)], [(1, "KACOR")]) == {("X", 1), ("Y", 1), ("Z", 1)}


def test_returns_stand_in_for_missing_market_values(spark):
    a = [("X", 1, "KACOR Inc", 0.12, None), ("Y", 1, "TRILO Inc", 0.12, 2.0), ("Z", 1, "KACOR Inc", 0.9, None)]
    assert pairs(spark, a, [(1, 1, 0.13, 2.0), (2, 1, 0.13, None)], [(1, "KACOR"), (2, "TRILO")]) == {("X", 1), ("Y", 2)}


def test_a_run_of_values_pairs_named_lines(spark):
    a = [(t, q, n, 0.11 * q, 2.0 + q) for q in (1, 2, 3) for t, n in (("X", "OTHER Inc"),)]
    b = [(p, q, 0.11 * q * s, 2.0 + q) for q in (1, 2, 3) for p, s in ((1, 1), (2, -1))]
    assert pairs(spark, a, b, [(1, "KACOR"), (2, "TRILO")]) == {("X", 1)}


def test_blocking_finds_planted_pairs(spark):
    """Lines with misspelt names, market values off by some percent and returns off by some thousandths: the share that become candidates."""
    rng = random.Random(11)
    a, b, names = [], [], []
    for k in range(150):
        name = "".join(rng.choice("BDKLMNRST") + rng.choice("AEIOU") for _ in range(3)) + " Energy Inc"
        quarters = range(8000, 8000 + rng.choice((3, 4, 6, 10, 20)))
        cap = rng.uniform(2, 9)
        for q in quarters:
            r = rng.gauss(0, 0.15)
            cap += r
            spelt = name if rng.random() < 0.8 else name[:2] + name[3:]
            a.append((f"T{k}", q, spelt, None if rng.random() < 0.1 else r + rng.gauss(0, 0.003), None if rng.random() < 0.05 else cap + rng.gauss(0, 0.01)))
            b.append((k, q, None if rng.random() < 0.08 else r, cap))
        names.append((k, name))
    got = pairs(spark, a, b, names)
    planted = {(f"T{k}", k) for k in range(150)}
    assert len(got & planted) >= 0.99 * len(planted)
    assert len(got) < 2 * len(planted)
