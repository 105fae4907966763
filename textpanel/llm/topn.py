"""The N best rows of every group by secondary sort, in one streaming pass over Arrow batches.

Rows are sorted within partitions by group, score and identifier; a pass over the sorted batches keeps the first N rows of each run
of equal groups and carries only the last group and a counter from one batch to the next. No group is ever held in memory. The pass
runs twice: first over the partitions as they are, without a shuffle, where it cuts each group to N rows per partition; then, after
a hash partition by group, over what is left. So a group that holds a third of all rows sends N rows per map task to its reducer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before; null equals null, NaN equals NaN. The first is held against `last`."""
    n = len(column)
    out = np.zeros(n, dtype=bool)

    def differ(a: pa.Array, b: pa.Array) -> np.ndarray:
        unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        one_null = np.not_equal(pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False))
        if pa.types.is_floating(a.type):
            both_nan = pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
            unequal &= ~both_nan
        return unequal | one_null

    if n > 1:
        out[1:] = differ(column.slice(1), column.slice(0, n - 1))
    if n:
        out[0] = last is None or differ(column.slice(0, 1), pa.array([last.as_py()], type=column.type))[0]
    return out


def first_rows(batches: Iterator[pa.RecordBatch], groups: int, n: int) -> Iterator[pa.RecordBatch]:
    """The first n rows of each run of equal values in the first `groups` columns."""
    last: list[pa.Scalar] | None = None
    seen = 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        begins = np.zeros(rows, dtype=bool)
        for i in range(groups):
            begins |= _changes(batch.column(i), None if last is None else last[i])
        if not groups:
            begins[0] = last is None
        at = np.arange(rows)
        start = np.maximum.accumulate(np.where(begins, at, -1))
        rank = np.where(start >= 0, at - start, at + seen)
        seen = int(rank[-1]) + 1
        last = [batch.column(i)[rows - 1] for i in range(groups)]
        kept = batch.filter(pa.array(rank < n))
        if kept.num_rows:
            yield kept


def top_n(df: DataFrame, groups: Sequence[str], score: str, ids: Sequence[str], n: int) -> DataFrame:
    """The rows of df with the n highest scores of each group, ties to the smaller `ids` (in their order, nulls last).

    A null or NaN score ranks below every number, negative infinity included. A null group is a group. Rows that agree in groups,
    score and ids are told apart by no rule: as many of them are kept as fit; make ids unique for a fixed result. n = 0 or an empty
    table give an empty result. All columns of df come out, in order; names that df repeats are an error of Spark's.
    """
    if n < 0:
        raise ValueError("n is not negative")
    rest = [c for c in df.columns if c not in groups]
    missing = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    order = [*[F.col(g).asc() for g in groups], missing.asc(), F.col(score).desc(), *[F.col(i).asc_nulls_last() for i in ids]]
    shaped = df.select(*groups, *rest)
    k = len(groups)

    def cut(part: DataFrame) -> DataFrame:
        return part.sortWithinPartitions(*order).mapInArrow(lambda it: first_rows(it, k, n), shaped.schema)

    local = cut(shaped)
    return cut(local.repartition(*groups) if groups else local.repartition(1)).select(*df.columns)
