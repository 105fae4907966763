"""Joins that Spark has no operator for: nearest later row, relative offsets, held periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(events: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, event_id: str, values: Sequence[str], days: int) -> DataFrame:
    """Each event with the row of its key on the first date from its own date to `days` later; none later, no row.

    at is a date column of both. The window is opened into days + 1 equi-join keys on the side of the events (bounded by the
    parameter), so the join hashes; the nearest row is a partial aggregate. Several rows of one key and date: the smallest values.
    """
    offsets = F.sequence(F.lit(0), F.lit(days))
    opened = events.select(event_id, *keys, F.explode(offsets).alias("_k"), F.col(at).alias("_d")).withColumn("_at", F.date_add("_d", F.col("_k")))
    right = rows.select(*keys, F.col(at).cast("date").alias("_at"), *values)
    met = opened.join(right, [*keys, "_at"], "inner")
    best = met.groupBy(event_id, *keys).agg(F.min(F.struct("_at", *values)).alias("_b"))
    return best.select(event_id, *keys, F.col("_b._at").alias("matched"), *[F.col(f"_b.{v}").alias(v) for v in values])


def asof_forward_unbounded(events: DataFrame, rows: DataFrame, key: str, at: str, event_id: str, value: str) -> DataFrame:
    """The same without a limit: the next date's value, however late, by a union and one reverse window. One key's rows sort in one task."""
    e = events.select(F.col(key), F.col(at).cast("date").alias("_at"), F.col(event_id).alias("_e"), F.lit(None).alias("_v"), F.lit(0).alias("_s"))
    r = rows.select(F.col(key), F.col(at).cast("date").alias("_at"), F.lit(None).alias("_e"), F.struct(F.col(at).cast("date").alias("d"), F.col(value).alias("v")).alias("_v"), F.lit(1).alias("_s"))
    w = Window.partitionBy(key).orderBy(F.col("_at").desc(), F.col("_s").desc(), F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = e.withColumn("_v", F.col("_v").cast(r.schema["_v"].dataType)).withColumn("_e", F.col("_e")).unionByName(r.withColumn("_e", F.col("_e").cast(e.schema["_e"].dataType)))
    return both.withColumn("_n", F.last("_v", ignorenulls=True).over(w)).filter("_s = 0 AND _n IS NOT NULL").select(F.col("_e").alias(event_id), key, F.col("_n.d").alias("matched"), F.col("_n.v").alias(value))


def offset_window(anchors: DataFrame, rows: DataFrame, key: str, index: str, lo: int, hi: int) -> DataFrame:
    """Each anchor with the rows of its key whose index is its own plus k, for k from lo to hi; adds `k`. An equi-join on key and index:
    the anchors are opened, since a range join would compare all pairs of a key."""
    if "k" in {*anchors.columns, *rows.columns}:
        raise ValueError("k is the name of the offset: rename the column")
    opened = anchors.withColumn("k", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("_i", F.col(index) + F.col("k")).drop(index)
    return opened.join(rows.withColumnRenamed(index, "_i"), [key, "_i"], "inner").drop("_i")


def hold_forward(rows: DataFrame, formed: str, months: Sequence[int] = (3, 4, 5), name: str = "Month") -> DataFrame:
    """Each row once for each month that it is held, counted from the month of formation."""
    return rows.withColumn(name, F.explode(F.array(*[F.add_months(F.col(formed), m) for m in months])))


def peer_weighted(edges: DataFrame, values: DataFrame, src: str, dst: str, weight: str, node: str, value: str) -> DataFrame:
    """Per source node, the weighted mean of its neighbours' values; null weights and values take no part."""
    v = values.select(F.col(node).alias("_n"), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    met = edges.filter(F.col(weight).isNotNull()).join(v, F.col(dst) == F.col("_n"))
    return met.groupBy(src).agg((F.sum(F.col(weight) * F.col("_v")) / F.when(F.sum(weight) != 0, F.sum(weight))).alias("peer_value"), F.count("*").alias("n_peers"))
