"""Results that a cut would change: each of these failed while the cut was there."""

from __future__ import annotations

from textpanel.operators import discovery, scoring
from textpanel.plans import panel_queries, text_queries


def test_every_year_has_its_vintage(spark, tmp_path):
    rows = [(y, f"T{y}", i, t) for y in (2011, 2012, 2014, 2015) for i, t in enumerate(("import quota came", "steel price rose"))]
    spark.createDataFrame(rows, "year int, Id string, sentence_id int, text string").write.parquet(str(tmp_path / "sentences.parquet"))
    assert {r.vintage for r in text_queries.vintage_dictionaries(spark, str(tmp_path)).select("vintage").distinct().collect()} == {2011, 2012, 2013, 2014, 2015}
    got = {r.year: r.exposure for r in text_queries.realtime_scores(spark, str(tmp_path)).collect()}
    assert got[2011] is None and all(got[y] > 0 for y in (2012, 2014, 2015))
    assert {r.vintage for r in text_queries.vintage_overlap(spark, str(tmp_path)).collect()} == {2012, 2013, 2014, 2015}


def test_no_vintage_is_null_and_no_hit_is_zero(spark):
    c = spark.createDataFrame([("a", 2014, "x y", 1), ("b", 2014, "p q", 1), ("c", 2015, "x y", 1)], "Id string, year int, bigram string, n long")
    v = spark.createDataFrame([(2013, "x y")], "vintage int, bigram string")
    assert {r.Id: r.exposure for r in scoring.realtime(c, v, "Id", "year").collect()} == {"a": 1.0, "b": 0.0, "c": None}


def test_vintages_are_all_significant_bigrams(spark):
    rows = [(f"t{i}", 2012 + i % 2, b, 2) for i in range(20) for b in ("import quota", *(f"told {k}" for k in range(80)), "mixed word")]
    rows += [(f"o{i}", 2012 + i % 2, b, 30) for i in range(200) for b in ("mixed word", "other word")]
    c = spark.createDataFrame(rows, "Id string, year int, bigram string, n long")
    seeds = spark.createDataFrame([("import quota",), ("never seen",)], "bigram string")
    labels = discovery.label_reference(c, seeds, ["Id"])
    got = discovery.vintages(discovery.vintage_counts(c, labels, ["Id"], "year"), seeds, "year", [2012, 2013]).collect()
    for y in (2012, 2013):
        key = discovery.keyness(c.filter(c.year <= y), labels.withColumnRenamed("in_R", "in_T"), ["Id"])
        want = {r.bigram for r in discovery.significant_dictionary(key, seeds).collect()}
        assert sorted(r.bigram for r in got if r.vintage == y) == sorted(want) and len(want) == 82 and "mixed word" not in want


def test_every_day_is_an_anchor(spark, tmp_path):
    spark.sql("SELECT i AS event_id, 1 AS user_id, 'view' AS event_type, TIMESTAMP'2020-01-01 10:00:00' + make_interval(0, 0, 0, i) AS ts, CAST(i AS DOUBLE) AS value FROM (SELECT explode(sequence(1, 9)) AS i)").write.parquet(str(tmp_path / "events.parquet"))
    got = panel_queries.offset_window(spark, str(tmp_path)).collect()
    assert sorted((r.anchor, r.k) for r in got) == [(i, k) for i in range(1, 10) for k in range(-3, 4) if 1 <= i + k <= 9]
