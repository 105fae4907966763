"""The whole way on a handful of turns, and the contract's functions."""

from __future__ import annotations

import importlib.util

import pytest

from textpanel.config import Config
from textpanel.operators import tokens
from textpanel.plans import pipeline

TURNS = [
    ("c1", "A.N", 2020, 1, "2020-02-01", 1, "Operator", "Welcome to the call"),
    ("c1", "A.N", 2020, 1, "2020-02-01", 3, None, "The export ban is a risk for our supply. We trade in the market."),
    ("c1", "A.N", 2020, 1, "2020-02-01", 2, "CEO", "[Inaudible] Thank you for the question. The export ban came in May."),
    ("c2", "A.N", 2020, 1, "1580515200", 1, "CEO", "We had the same steel and the same price. The market is good for the team."),
    ("c3", None, 2020, 1, None, 1, "CEO", "Der Vorstand und die Bank sind nicht mit der Prognose zufrieden."),
    ("c4", "B.N", 2021, 2, None, 1, "CEO", ""),
    (None, "B.N", 2021, 2, None, 1, "CEO", "no key"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "Id string, companyTicker string, eventYear int, eventQuarter int, expirationDate string, secIdx int, speakerGroup string, speech string")


def test_way_through(spark, turns):
    config = Config(seeds=("export ban",), min_docfreq=1, dictionary_top=5)
    calls = pipeline.build_calls(turns, config)
    got = {r.Id: r for r in calls.collect()}
    assert set(got) == {"c1", "c2"} and str(got["c2"].date) == "2020-02-01"
    assert got["c1"].text.startswith("Thank you") and "Welcome" not in got["c1"].text
    s = pipeline.build_sentences(calls, config)
    counts = tokens.dfm(s, ["Id", "sentence_id"], "text", config.stopwords)
    dic = pipeline.find_dictionary(counts, config)
    assert ("export ban", "seed") in {(r.bigram, r.origin) for r in dic.collect()}
    scores = {r.Id: r for r in pipeline.score_calls(s, counts, dic.filter("origin = 'seed'"), config).collect()}
    assert scores["c1"].h == 2 and scores["c1"].hrisk == 1 and scores["c2"].exposure == 0 and scores["c2"].tfidf == 0
    fq = pipeline.firm_quarters(pipeline.score_calls(s, counts, dic, config), calls).collect()
    assert [(r.ticker, r.year, r.quarter, r.n_calls) for r in fq] == [("A.N", 2020, 1, 2)]


def test_funnel(turns):
    got = {r.eventYear: r for r in pipeline.funnel(turns).collect()}
    assert (got[2020].n_rows_raw, got[2020].n_rows_after_operator_drop, got[2020].n_calls) == (5, 4, 3)
    assert (got[2021].n_rows_raw, got[2021].n_rows_after_na_drop, got[2021].n_calls) == (2, 0, 0)


def test_contract():
    import __spark_entry__ as e

    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 90
    if importlib.util.find_spec("textpanel.llm"):
        assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} | {"p6_ids"} <= set(known)
