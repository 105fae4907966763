from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textpanel.sources import connectors
from textpanel.streaming.scoring import score_stream


def test_factor_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Header\n,Mkt,SMB\n202001, 1.50, x\n202002,-2.00,0.5\n 2020 , 9, 9\nend\n")
    got = [(r.ym, r.mkt, r.smb) for r in connectors.factor_csv(spark, str(tmp_path / "f.csv"), ["mkt", "smb"]).orderBy("ym").collect()]
    assert got == [(202001, 0.015, None), (202002, -0.02, 0.005)]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.yml").write_text("# note\nstop:\n  - on\n  - 'no'\n  - the # article\nother:\n  - x\n")
    assert connectors.word_list(str(tmp_path / "w.yml"), "stop") == ["on", "no", "the"]
    (tmp_path / "t.csv").write_text("Word,Positive,Negative\nGOOD,2009,0\nBAD,0,2009\n")
    assert connectors.tone_lists(spark, str(tmp_path / "t.csv")) == (["good"], ["bad"])
    assert connectors.tone_lists(spark, str(tmp_path / "none.csv")) == ([], [])


def test_yearly_and_sinks(spark, tmp_path):
    connectors.write(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/x_2019.parquet")
    connectors.write(spark.createDataFrame([(2, 3)], "a int, b int"), f"{tmp_path}/x_2020.parquet")
    got = {(r.a, r.b) for r in connectors.yearly(spark, f"{tmp_path}/x_*.parquet").collect()}
    assert got == {(1, None), (2, 3)}
    df = spark.createDataFrame([(1, "y")], "cc_a int, b string")
    assert connectors.rename_all(df, [("cc_", "geo_")]).columns == ["geo_a", "b"]
    connectors.write(df, f"{tmp_path}/j", "json")
    connectors.write(df, f"{tmp_path}/c", "csv", by=["b"])
    assert spark.read.json(f"{tmp_path}/j").count() == 1
    assert connectors.in_list(df, "b", spark.createDataFrame([("y",), ("y",)], "k string"), "k").count() == 1


def test_stream(spark, tmp_path):
    src = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 10:00:00', 'an import quota rose'), (TIMESTAMP'2024-01-01 12:00:00', 'nothing here') AS t(ts, text)")
    src.write.parquet(f"{tmp_path}/in")
    q = score_stream(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), ["import quota"]).writeStream.outputMode("complete").format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("scored").select(F.sum("B").alias("b"), F.sum("h").alias("h")).first()
    assert (r.b, r.h) == (4, 1)


def test_nested_and_inline_lists(spark, tmp_path):
    p = tmp_path / "w.yml"
    p.write_text("top: [on, 'two words']\nouter:\n  inner:\n    - a\n    - no  # a word\n  other:\n    - b\n")
    assert connectors.word_list(str(p), "top") == ["on", "two words"]
    assert connectors.word_list(str(p), "outer.inner") == ["a", "no"] and connectors.word_list(str(p), "outer.other") == ["b"]
    assert connectors.word_list(str(p), "none") == []
    (tmp_path / "d.csv").write_text("bigram\nTrade War\n\n")
    got = connectors.dictionary_variant(spark, {"primary": str(tmp_path / "d.csv")})
    assert [tuple(r) for r in got.collect()] == [("primary", "trade war")]
    with pytest.raises(ValueError):
        connectors.dictionary_variant(spark, {"primary": "x"}, "small")
