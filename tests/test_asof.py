"""Attributes as known at event time: dyadic nodes against brute force, and the dirty cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textpanel.operators.asof_versions import SPAN, asof_versions, enclosing_nodes, interval_nodes, supersede


def cover(lo, hi, top, rows):
    out = set()
    for n in rows:
        level = round(n / SPAN)
        index = n - level * SPAN
        assert 0 <= level <= top
        out |= {*range(index << level, (index + 1) << level)}
    assert sum(1 << round(n / SPAN) for n in rows) == max(0, hi - lo)  # no tick twice
    return out == set(range(lo, hi))


def test_long_intervals_make_few_nodes(spark):
    got = spark.createDataFrame([(1, 3601)], "a long, b long").select(interval_nodes(F.col("a"), F.col("b"), 12, 2).alias("n")).first().n
    assert len(got) <= 2 * 3 * 7 and cover(1, 3601, 12, got)


@pytest.mark.parametrize("top,step", [(0, 1), (1, 1), (3, 1), (6, 1), (0, 2), (4, 2), (6, 2), (6, 3)])
def test_nodes_cover_exactly(spark, top, step):
    pairs = [(a, b) for a in range(-9, 20, 3) for b in range(-9, 41, 4)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("n", interval_nodes(F.col("a"), F.col("b"), top, step))
    for r in df.collect():
        assert cover(r.a, r.b, top, r.n), (r.a, r.b, r.n)


def test_enclosing(spark):
    got = spark.createDataFrame([(13,), (-3,)], "t long").select(enclosing_nodes(F.col("t"), 2).alias("n")).collect()
    assert got[0].n == [13, SPAN + 6, 2 * SPAN + 3]
    assert got[1].n == [-3, SPAN - 2, 2 * SPAN - 1]


def test_against_brute_force(spark):
    rng = random.Random(3)
    versions = [(rng.randrange(4), rng.randrange(40), rng.randrange(6), i) for i in range(120)] + [(None, 3, 3, 900), (1, None, 3, 901)]
    events = [(rng.randrange(5), rng.randrange(-3, 50), i) for i in range(200)] + [(None, 4, 900), (2, None, 901), (2, 7, 3)]
    v = supersede(spark.createDataFrame(versions, "k int, start int, rank int, id int"), ["k"], "start", ["rank", "id"])
    e = spark.createDataFrame(events, "k int, t int, e int")
    got = {(r.k, r.t, r.e): r.id for r in asof_versions(e, v, ["k"], "t", ["id"]).collect()}
    want = {}
    for k, t, i in events:
        known = [(rank, vid) for vk, s, rank, vid in versions if None not in (vk, s, k, t) and vk == k and s <= t]
        if known:
            want[(k, t, i)] = max(known)[1]
    assert got == want


def test_overlap_precedence_left_and_clashes(spark):
    v = spark.createDataFrame([(1, 0, 10, 1, "a"), (1, 5, 8, 2, "b"), (1, 7, None, 1, "c"), (1, 9, 9, 9, "empty"), (2, None, 4, 1, "d")], "k int, valid_from int, valid_to int, p int, x string").withColumn("note", F.lit("v"))
    e = spark.createDataFrame([(1, 0, "n"), (1, 6, "n"), (1, 9, "n"), (1, 30, "n"), (2, 3, "n"), (2, 4, "n"), (None, 1, "n")], "k int, t int, note string")
    got = {(r.k, r.t): r.x for r in asof_versions(e, v, ["k"], "t", ["x"], precedence=["p"], how="left").collect()}
    assert got == {(1, 0): "a", (1, 6): "b", (1, 9): "c", (1, 30): "c", (2, 3): "d", (2, 4): None, (None, 1): None}
    with pytest.raises(ValueError):
        asof_versions(e, v, ["k"], "t", ["note"])


def test_empty(spark):
    v = spark.createDataFrame([], "k int, valid_from int, valid_to int, x string")
    e = spark.createDataFrame([], "k int, t int")
    assert asof_versions(e, v, ["k"], "t", ["x"]).count() == 0
    assert asof_versions(spark.createDataFrame([(1, 1)], "k int, t int"), v, ["k"], "t", ["x"], how="left").collect()[0].x is None


def test_known_strictly_before_the_month(spark, tmp_path):
    from textpanel.plans.known_exposure import p5_found

    r = spark.sql("SELECT * FROM VALUES (1, DATE'2020-07-01', 0.1D), (1, DATE'2020-08-15', 0.1D), (1, DATE'2020-08-01', 0.1D), (1, DATE'2020-09-01', CAST('NaN' AS DOUBLE)), (2, DATE'2020-07-01', 0.1D) AS t(permno, Month, RetM)")
    x = spark.sql("SELECT * FROM VALUES (1, 2020, 1, DATE'2020-01-01', TIMESTAMP'2020-08-01 00:00:00', 11L), (1, 2020, 1, CAST(NULL AS DATE), TIMESTAMP'2020-06-30 23:59:59', 10L), (2, 2020, 2, DATE'2020-04-01', TIMESTAMP'2020-06-30 00:00:00', 20L), (2, 2020, 2, DATE'2020-04-01', CAST(NULL AS TIMESTAMP), 21L) AS t(permno, year, quarter, form_q, known_ts, fq_id)")
    r.write.parquet(f"{tmp_path}/crsp_returns_monthly.parquet")
    x.write.parquet(f"{tmp_path}/exposure_firmquarter_crsp.parquet")
    got = {(a.permno, a.month_id, a.fq_id) for a in p5_found(spark, str(tmp_path)).collect()}
    assert got == {(1, 202007, 10), (1, 202008, 10), (2, 202007, 20)}


def test_query_on_empty_tables(spark, tmp_path):
    from textpanel.plans.known_exposure import p5_found

    spark.createDataFrame([], "permno int, Month date, RetM double").write.parquet(f"{tmp_path}/crsp_returns_monthly.parquet")
    spark.createDataFrame([], "permno int, year int, quarter int, form_q date, known_ts timestamp, fq_id long").write.parquet(f"{tmp_path}/exposure_firmquarter_crsp.parquet")
    assert p5_found(spark, str(tmp_path)).count() == 0
