"""Percentiles of very large numeric columns from mergeable compactor sketches (KLL).

A sketch is a hierarchy of compactors: a full level is sorted and every other value, from a random start, moves up with twice the
weight; sketches merge level by level. A percentile read from it is off in rank by at most `rank_error` of the group's size, with
probability of about 99 % for each percentile. Spark's own KLL aggregate does the compaction inside the JVM, with partial sketches
before the shuffle: what crosses the network is one sketch of some kB per group and map task, however many rows a group has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpanel.functions.numeric import finite

#: The published fit of the rank error of a KLL sketch with parameter k, for one-sided queries at 99 %: 2.296 / k**0.9021.
ERROR_SCALE, ERROR_POWER, K_LEAST, K_MOST = 2.296, 0.9021, 8, 65535
#: By default two in a thousand rows.
RANK_ERROR = 0.002


def sketch_size(rank_error: float) -> int:
    """The compactor parameter k with which the rank error stays within the bound; an error if the sketch can't promise it."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error is a share of the rows, between 0 and 1")
    k = math.ceil((ERROR_SCALE / rank_error) ** (1 / ERROR_POWER))
    if k > K_MOST:
        raise ValueError(f"rank_error {rank_error} is too small for a sketch; the least is about {ERROR_SCALE / K_MOST**ERROR_POWER:.3g}")
    return max(K_LEAST, k)


def sketches(df: DataFrame, groups: Sequence[str], value: Column | str, rank_error: float = RANK_ERROR) -> DataFrame:
    """One row per group: the group columns, `n` (values counted), `least`, `most` (exact) and `sketch` (binary, may be stored).

    Null, NaN and infinite values are not counted; a group that has no other values has n = 0 and a null sketch. A null group is a
    group. Add a day or a delivery to `groups` to get sketches that merge_sketches can combine later.
    """
    x = df.select(*groups, finite(value).alias("_x"))
    return x.groupBy(*groups).agg(F.count("_x").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.when(F.count("_x") > 0, F.kll_sketch_agg_double("_x", F.lit(sketch_size(rank_error)))).alias("sketch"))


def merge_sketches(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of separate deliveries, combined by `groups`; same columns as `sketches`. The error bound stays the same."""
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.when(F.sum("n") > 0, F.kll_merge_agg_double("sketch")).alias("sketch"))


def percentiles(sk: DataFrame, groups: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """The group columns, n, and one column per entry of probs (name: share of the rows, 0 to 1); null for a group without values.
    0 and 1 give the exact least and most."""
    for p in probs.values():
        if not 0 <= p <= 1:
            raise ValueError("a percentile is a share between 0 and 1")

    def read(p: float) -> Column:
        if p in (0, 1):
            return F.col("least" if p == 0 else "most")
        return F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))

    return sk.select(*groups, "n", *[read(p).alias(name) for name, p in probs.items()])
