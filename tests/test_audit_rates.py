"""The blind audit on keys that whole numbers of 32 bits don't hold once they are multiplied, and its numbers given by more than one task."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from textpanel.operators import validate
from textpanel.plans import econ_queries


def test_audit_rates_of_large_permnos(spark, tmp_path):
    known, quarter, later = datetime(2020, 6, 1), date(2020, 1, 1), date(2020, 2, 15)
    rows = [(i, 2_147_483_647 - 200_000_000 * i, quarter, float(i), 0.001 * (i % 2)) for i in range(1, 11)]
    rows += [(11, 2_147_484, quarter, 0.0, 0.001), (12, 2_147_484, later, 0.0, 0.0), (13, -2_147_484, quarter, 0.0, 0.001), (14, 10_001, quarter, 0.0, float("nan"))]
    full = [(i, p, 2020, 1, f, e, r, 0.0, 1, 1, 3000, known) for i, p, f, e, r in rows]
    kinds = "fq_id long, permno int, year int, quarter int, form_q date, GeoExposure double, GeoRisk double, GeoSentiment double, n_calls int, gvkey int, siccd int, known_ts timestamp"
    spark.createDataFrame(full, kinds).write.parquet(str(tmp_path / "exposure_firmquarter_crsp.parquet"))
    got = {r.decile: (r.n, r.n_pos, r.pos_rate, r.mean_score, r.percentile) for r in econ_queries.audit_rates(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 2, 0.666667, 0.0, 0)} | {i: (1, i % 2, float(i % 2), float(i), i * 10 - 5) for i in range(1, 11)}


def test_blind_numbers_in_several_tasks(spark):
    keys = [None, *range(-50, 2000), *range(10**14, 10**14 + 500), 2147483647, 2 * 2147483647]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sheet, answers = validate.blind(spark.createDataFrame([(k, str(k), i) for i, k in enumerate(keys)], "key long, text string, score int"), "key", ["score"])
        order = sorted(keys, key=lambda k: (-1, 0) if k is None else (((k % 2147483647) * 48271 + 42) % 2147483647, k))
        assert [r.key for r in answers.orderBy("rater_id").collect()] == order
        assert sheet.columns == ["text", "rater_id"] and [(r.rater_id, r.text) for r in sheet.orderBy("rater_id").collect()] == [(i, str(k)) for i, k in enumerate(order, 1)]
        assert len({r[1] for r in sheet.select("rater_id", F.spark_partition_id()).collect()}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
