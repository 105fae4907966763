"""Every query of a problem on empty tables, and on tables of nulls."""

from __future__ import annotations

from pathlib import Path

import pytest

from textpanel.llm import tokenizer

SCHEMAS = {
    "crsp_returns_monthly": "permno int, Month timestamp_ntz, RetM double, MCap_MEnd double",
    "exposure_firmquarter_crsp": "fq_id long, permno int, year int, quarter int, form_q timestamp_ntz, GeoExposure double, GeoRisk double, GeoSentiment double, GeoExposureTFIDF double, n_calls int, gvkey int, siccd int, known_ts timestamp_ntz",
    "panel_ric": "Ticker string, Quarter timestamp_ntz, companyName string, us_can boolean, siccd int, QuarterlyRet double, MCap_QEnd double, Size double, Momentum double, BM double, Beta_CAPM double",
    "crsp_names": "permno int, comnam string, siccd int, primaryexch string, namedt timestamp_ntz, nameendt timestamp_ntz",
    "exchange_region": "suffix string, Region string, Country_Clean string, primaryexch string",
    "sentences": "year int, Id string, sentence_id int, text string",
    "feat_freq": "year int, batch int, bigram string, feat_freq long, docfreq long, n_sentences long",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, companyTicker string, eventYear int, eventQuarter int",
    "reading_labels": "doc_id long, rater_id string, grade int",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        d = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            n = len(schema.split(","))
            spark.createDataFrame([] if kind == "empty" else [(None,) * n] * 3, schema).write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.skipif(not Path(tokenizer.VOCABULARY).exists(), reason="no vocabulary file")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_problem_queries(spark, folders, kind):
    from textpanel.llm import queries

    for name, f in queries.queries().items():
        rows = f(spark, folders[kind]).collect()
        if name.endswith("_found"):
            assert rows == [], name
        if name == "p6_ids":
            assert [r.ids for r in rows] == [[]] * (0 if kind == "empty" else 3)
