"""Attributes as known at event time, by dyadic decomposition of validity intervals.

Time is a whole number (a tick: a day, a month). A version is valid in a half-open interval [from, to) of ticks. The interval is
cut into nodes of a binary tree over time (aligned blocks of 2**level ticks); an event asks for the nodes that enclose its tick, one of each
level. Only every `step`-th level is used: an event makes fewer rows, an interval at most 2 * (2**step - 1) of a level. Both sides carry the node as one number, so the match is a plain
equi-join on (keys, node): no range predicate, no nested loop, no sort of an entity's whole history in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A node is (tick >> level) + level * SPAN: ticks are below SPAN in absolute value, so nodes of different levels never coincide.
SPAN = 1 << 40


def _node(level: int, index: Column) -> Column:
    return index.cast("long") + F.lit(level * SPAN)


def interval_nodes(lo: Column, hi: Column, top: int, step: int = 1) -> Column:
    """The array of nodes of levels 0, step, ... up to top that exactly cover [lo, hi), empty if it is empty. The last level takes what is
    left."""
    parts = []
    ups = 1 << step
    none = F.array().cast("array<bigint>")
    for level in (levels := range(0, top + 1, step)):
        size = 1 << level
        a = F.floor((lo.cast("long") + (size - 1)) / size)
        b = F.floor(hi.cast("long") / size)
        run = lambda x, y, level=level: F.when(x < y, F.transform(F.sequence(x, F.greatest(x, y - 1)), lambda i: _node(level, i))).otherwise(none)
        if level == levels[-1]:
            parts.append(run(a, b))
        else:
            # What the next level's blocks leave over on either side; all if no such block lies inside.
            up, down = F.ceil(a / ups) * ups, F.floor(b / ups) * ups
            parts += [run(a, F.least(F.greatest(up, a), b)), F.when(up <= down, run(down, b)).otherwise(none)]
    return F.concat(*parts)


def enclosing_nodes(tick: Column, top: int, step: int = 1) -> Column:
    """The array of the nodes that hold the tick, one of each of the levels 0, step, ... up to top."""
    return F.array(*[_node(level, F.floor(tick.cast("long") / (1 << level))) for level in range(0, top + 1, step)])


def supersede(versions: DataFrame, keys: Sequence[str], start: str, precedence: Sequence[str]) -> DataFrame:
    """Turns versions that are known from `start` on and are outranked by others into disjoint half-open intervals.

    At any tick the version in force is the one with the highest `precedence` (descending, nulls lowest) among those that have
    started. Adds `valid_from` and `valid_to` (null: still in force) and drops versions that are never in force. Versions with a
    null key or start are dropped. Of versions with the same keys and start only the highest stays, in a first aggregate with a
    map-side combine: after it an entity has no more rows than there are ticks, however many versions were delivered, so the
    window over its history is bounded by the calendar and not by the data.
    """
    rest = [c for c in versions.columns if c not in {*keys, start, *precedence}]
    known = versions.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, start])))
    best = known.groupBy(*keys, F.col(start).alias("valid_from")).agg(F.max(F.struct(*precedence, *rest)).alias("_v"))
    later = Window.partitionBy(*keys).orderBy(*[F.col(f"_v.{c}").desc() for c in precedence], F.col("valid_from")).rowsBetween(Window.unboundedPreceding, -1)
    cut = best.withColumn("valid_to", F.min("valid_from").over(later)).filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    return cut.select(*keys, "valid_from", "valid_to", *[F.col(f"_v.{c}").alias(c) for c in [*precedence, *rest]])


def asof_versions(
    events: DataFrame, versions: DataFrame, keys: Sequence[str], tick: str, attributes: Sequence[str], start: str = "valid_from", end: str = "valid_to",
    precedence: Sequence[str] = (), event_id: Sequence[str] | None = None, top: int | None = None, step: int = 2, span: tuple[int, int] | None = None, how: str = "inner",
) -> DataFrame:
    """Each event with `attributes` of the version with the same `keys` whose [start, end) holds the event's tick.

    A null `start` means from ever, a null `end` for ever; an empty or reversed interval holds nothing. A null key or tick matches
    nothing: such an event is dropped, or kept with null attributes if `how` is 'left'. If intervals of an entity may overlap, give
    `precedence` (columns of versions, descending, nulls lowest; further ties go to the highest attributes) and `event_id` (columns
    that identify an event, by default all of them): then exactly one version is kept for each distinct event. Without `precedence`
    intervals must be disjoint, and repeated events stay repeated. Columns of both sides with the same name don't clash: only
    `attributes` are taken from versions, and one that events has too is an error.

    `span` is the first and last tick of the events, by default computed (one aggregate over that column). Intervals are cut at it, so they
    make no nodes that no event can ask for. `top` is the highest level, by default the binary logarithm of the span's length, so the
    number of rows that an interval makes grows with the logarithm of its length; of the levels every `step`-th is used.
    """
    clash = set(attributes) & set(events.columns)
    if clash:
        raise ValueError(f"attributes that events already has: {sorted(clash)}")
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    ids = list(event_id or events.columns)
    first, last = span or events.agg(F.min(tick), F.max(tick)).first()
    if last is None:  # no event has a tick
        first = last = 0
    if top is None:
        top = (last - first + 1).bit_length()
    lo = F.greatest(F.coalesce(F.col(start), F.lit(first)).cast("long"), F.lit(first).cast("long"))
    hi = F.least(F.coalesce(F.col(end), F.lit(last + 1)).cast("long"), F.lit(last + 1).cast("long"))
    has_keys = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    right = (
        versions.filter(has_keys).withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo < _hi")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_p{i}") for i, c in enumerate(precedence)], *[F.col(c).alias(f"_a{i}") for i, c in enumerate(attributes)], "_lo", "_hi")
        .withColumn("_n", F.explode(interval_nodes(F.col("_lo"), F.col("_hi"), top, step)))
    )
    left = events.filter(has_keys & F.col(tick).isNotNull()).withColumn("_node", F.explode(enclosing_nodes(F.col(tick), top, step)))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_node") == F.col("_n")]
    met = left.join(right, on, "inner").filter((F.col("_lo") <= F.col(tick)) & (F.col(tick) < F.col("_hi")))
    if precedence:
        chosen = F.struct(*[f"_p{i}" for i in range(len(precedence))], *[f"_a{i}" for i in range(len(attributes))])
        met = met.groupBy(*ids).agg(F.max(chosen).alias("_c")).select(*ids, *[F.col(f"_c._a{i}").alias(c) for i, c in enumerate(attributes)])
    else:
        met = met.select(*events.columns, *[F.col(f"_a{i}").alias(c) for i, c in enumerate(attributes)])
    if how == "inner":
        return met
    found = met.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(ids)], *attributes).distinct()
    return events.join(found, [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(ids)], "left").select(*events.columns, *attributes)
