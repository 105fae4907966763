"""Hand-checked fixtures for the library's operators."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textpanel.functions.numeric import finite, is_finite
from textpanel.functions.text import clean_ric, clean_ticker, fold_accents, fold_nfkd, parse_date, parse_flag
from textpanel.operators import corpus, discovery, events, identity, joins, panel, regress, scoring, series, sorts, tokens, validate

NAN, INF = float("nan"), float("inf")


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


def test_finite(spark):
    got = [r[0] for r in spark.createDataFrame([(None,), (NAN,), (INF,), (-INF,), (1.0,)], "x double").select(is_finite("x")).collect()]
    assert got == [False, False, False, False, True]


def test_words(spark):
    assert one(spark, "Supply-chain, China's Été x a_b 42", tokens.words("x")) == ["supply", "chain", "china", "ete", "a_b", "42"]
    assert one(spark, "supply-chain (trade) China's war", tokens.icu_like_words("x")) == ["trade", "war"]
    assert one(spark, None, tokens.words("x")) is None
    assert one(spark, "ﬁx straße", fold_nfkd("x")) == "fix straße"
    assert one(spark, "é ł ñ", fold_accents("x")) == "e ł n"


def test_bigrams_bridge_stop_words(spark):
    assert one(spark, "trade and war", tokens.bigrams(tokens.without(tokens.words("x"), ["and"]))) == ["trade war"]
    assert one(spark, "trade", tokens.bigrams(tokens.words("x"))) == []
    assert one(spark, "", tokens.bigrams(tokens.words("x"))) == []


def test_identifiers(spark):
    assert [one(spark, x, clean_ric("x")) for x in (" mdp.n^L21 ", "^x", None)] == ["MDP.N", None, None]
    assert [one(spark, x, clean_ticker("x")) for x in ("aapl.o", "X*1", "~")] == ["AAPL", "X", None]
    assert [one(spark, x, parse_flag("x")) for x in ("Yes.", "no", "yes and no", "maybe")] == [1, 0, None, None]
    assert [str(one(spark, x, parse_date(F.col("x")))) for x in ("2020-02-03", "86400", "soon")] == ["2020-02-03", "1970-01-02", "None"]


def test_boilerplate(spark):
    f = corpus.boilerplate_once("x")
    assert one(spark, "We make forward-looking statements. And now the results.", f) == "And now the results."
    assert one(spark, "A safe harbor note. Sales rose.", f) == " Sales rose."
    assert one(spark, "Nothing legal. At all.", f) == "Nothing legal. At all."
    assert one(spark, "safe harbor", f) == "safe harbor"
    assert one(spark, "safe harbor x. Now safe harbor y. Sales", corpus.boilerplate_iter("x")) == " Sales"
    assert one(spark, "a [Inaudible] b  (foreign language) c", corpus.strip_markers("x")) == "a b c"


def test_corpus(spark):
    t = spark.createDataFrame([("a", 2, "world", "x"), ("a", 1, "hello", "y"), ("b", 1, None, "z")], "Id string, k int, s string, t string")
    got = {r.Id: (r.text, r.t) for r in corpus.concat_turns(t, "Id", "k", "s", ["t"]).collect()}
    assert got["a"] == ("hello world", "y")
    s = corpus.split_sentences(spark.createDataFrame([("a", "One. Two! three? Four\nFive"), ("b", None)], "Id string, x string"), "x", ["Id"])
    assert [(r.sentence_id, r.text) for r in s.orderBy("sentence_id").collect()] == [(1, "One."), (2, "Two! three?"), (3, "Four"), (4, "Five")]
    assert one(spark, "wir sind nicht die firma und der markt", corpus.detect_language("x")) == "de"
    assert one(spark, "12345", corpus.detect_language("x")) is None


def test_keyness_by_hand(spark):
    c = spark.createDataFrame([(1, "in", 10), (1, "rest", 90), (2, "in", 5), (2, "rest", 895)], "Id int, bigram string, n long")
    t = spark.createDataFrame([(1, 1), (2, 0)], "Id int, in_T int")
    got = {r.bigram: r.G2 for r in discovery.keyness(c, t, ["Id"]).collect()}
    e = [15 * 100 / 1000, 985 * 100 / 1000, 15 * 900 / 1000, 985 * 900 / 1000]
    want = 2 * sum(o * math.log(o / x) for o, x in zip((10, 90, 5, 895), e, strict=True))
    assert got["in"] == pytest.approx(want) and got["rest"] == pytest.approx(-want)
    assert discovery.chi2_critical(0.05) == pytest.approx(3.841459, abs=1e-5)


def test_tfidf_of_a_bigram_in_every_document_is_zero(spark):
    c = spark.createDataFrame([(d, b, 1) for d in (1, 2, 3) for b in ("all", f"only {d}")], "Id int, bigram string, n long")
    w = {r.bigram: r.w for r in scoring.idf(c, "Id").collect()}
    assert w["all"] == 0 and w["only 1"] == pytest.approx(math.log(3))
    d = spark.createDataFrame([("x", "all"), ("x", "only 1")], "dictionary string, bigram string")
    assert {r.Id: r.tfidf for r in scoring.tfidf(c, scoring.idf(c, "Id"), d, "Id").collect()}[1] == pytest.approx(math.log(3) / 2)


def test_rank_bins(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(7)] + [(2, i, 5.0) for i in range(5)] + [(1, 99, NAN), (1, 98, None)], "p int, id int, x double")
    got = panel.bins(df, ["p"], "x", 5, "first", "id").collect()
    assert [r.bin for r in sorted((r for r in got if r.p == 1 and r.id < 50), key=lambda r: r.id)] == [1, 2, 3, 3, 4, 5, 5]
    assert [r.bin for r in sorted((r for r in got if r.p == 2), key=lambda r: r.id)] == [1, 2, 3, 4, 5]
    assert {r.bin for r in got if r.id > 50} == {None}
    assert {r.bin for r in panel.bins(df.filter("p = 2"), ["p"], "x", 5, "average").collect()} == {3}


def test_gap_guard(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01', 1.0D), (1, DATE'2020-04-01', 2.0D), (1, DATE'2020-10-01', 3.0D) AS t(k, d, x)")
    assert [r.x_lead for r in panel.lead_guarded(df, "k", "d", "x").orderBy("d").collect()] == [2.0, None, None]


def test_period_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 1001)] + [("b", 7.0)] * 3 + [("b", INF), ("c", None)], "p string, x double")
    w = panel.winsorize(df, ["p"], "x", 0.01, 0.99).collect()
    a = [r.x_w for r in w if r.p == "a"]
    assert min(a) == pytest.approx(10.99) and max(a) == pytest.approx(990.01)
    assert sorted((r.x_w for r in w if r.p == "b"), key=str) == [7.0, 7.0, 7.0, None]
    z = panel.zscore(df, ["p"], "x").collect()
    za = np.array([r.x_z for r in z if r.p == "a"])
    assert abs(za.mean()) < 1e-12 and za.std(ddof=1) == pytest.approx(1)
    assert {r.x_z for r in z if r.p != "a"} == {None}


def test_asof_forward(spark):
    e = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2020-01-03'), (2, 'a', DATE'2020-01-04'), (3, 'a', DATE'2019-12-26'), (4, 'b', DATE'2020-01-03') AS t(e, k, d)")
    r = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-03', 1), ('a', DATE'2020-01-06', 2) AS t(k, d, ti)")
    assert {x.e: x.ti for x in joins.asof_forward(e, r, ["k"], "d", "e", ["ti"], 7).collect()} == {1: 1, 2: 2}
    assert {x.e: x.ti for x in joins.asof_forward_unbounded(e, r, "k", "d", "e", "ti").collect()} == {1: 1, 2: 2, 3: 1}


def test_resolve_ric(spark):
    p = spark.createDataFrame([("MDP.N",), ("SU.TO",), ("XX.N",), ("XX.O",)], "p string")
    e = spark.createDataFrame([("MDP",), ("SU.PA",), ("SU.TO",), ("XX",), (None,)], "ric string")
    assert {r.ric: r.resolved for r in identity.resolve_ric(e, "ric", p, "p").collect()} == {"MDP": "MDP.N", "SU.PA": None, "SU.TO": "SU.TO", "XX": None, None: None}


def test_keep_first_and_registry(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", None, "n")], "k string, o int, v string")
    assert {r.k: r.v for r in identity.keep_first(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "n"}
    v = spark.createDataFrame([("e", "B", 2021), ("e", "A", 2020), ("e", None, 2019), ("f", None, 2020)], "Id string, t string, y int")
    got = {r.Id: (r.event_time_ticker, r.all_tickers, r.n_versions) for r in identity.event_registry(v, "Id", "t", "y").collect()}
    assert got == {"e": ("A", "A;B", 3), "f": (None, "", 1)}


def test_newey_west():
    e = np.array([1.0, -2.0, 0.5, 1.5, -1.0])
    x = np.ones((5, 1))
    assert series.newey_west(x, e, 0)[0, 0] == pytest.approx((e @ e) / 25 * 5 / 4)
    assert series.newey_west(x, e, 1)[0, 0] == pytest.approx((e @ e + 2 * 0.5 * (e[1:] @ e[:-1])) / 25 * 5 / 4)


def test_mean_newey_west_matches_matrix_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).cumsum() * 0.1 + 1
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double")
    r = series.mean_newey_west(df, [], "t", "x", 4).first()
    v = series.newey_west(np.ones((60, 1)), x - x.mean(), 4)[0, 0]
    assert r.mean == pytest.approx(x.mean()) and r.t == pytest.approx(x.mean() / math.sqrt(v))


def test_grouped_ols(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(3):
        a = rng.normal(size=(40, 2))
        y = 1 + g * a[:, 0] - 2 * a[:, 1] + rng.normal(size=40) * 0.01
        rows += [(g, float(p), float(q), float(z)) for (p, q), z in zip(a, y, strict=True)]
    rows += [(9, 1.0, 2.0, float(i)) for i in range(40)]
    out = {r.g: r.coef for r in regress.grouped_ols(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    for g in range(3):
        d = np.array([(1, r[1], r[2], r[3]) for r in rows if r[0] == g])
        assert out[g] == pytest.approx(list(np.linalg.lstsq(d[:, :3], d[:, 3], rcond=None)[0]), abs=1e-9)
    assert out[9] is None


def test_two_way_fixed_effects_match_dummies(spark):
    rng = np.random.default_rng(4)
    rows = [(f, p, float(rng.normal()), 0.0) for f in range(12) for p in range(8) if rng.random() < 0.8]
    rows = [(f, p, x, 0.7 * x + f * 0.3 - p * 0.2 + float(rng.normal()) * 0.1) for f, p, x, _ in rows]
    got = regress.two_way_fe(spark.createDataFrame(rows, "f int, p int, x double, y double"), "f", "p", "y", ["x"])["x"]
    d = pd.DataFrame(rows, columns=["f", "p", "x", "y"])
    m = np.column_stack([d.x, pd.get_dummies(d.f).to_numpy(float), pd.get_dummies(d.p).to_numpy(float)[:, 1:]])
    assert got["b"] == pytest.approx(np.linalg.lstsq(m, d.y.to_numpy(), rcond=None)[0][0], abs=1e-8) and got["n"] == len(d)


def test_market_model_without_noise(spark):
    m = [0.01, -0.02, 0.03, 0.0, 0.02, -0.01, 0.01, 0.04, -0.03, 0.02, 0.0, 0.01]
    rows = [("a", f"2020-01-{i + 1:02d}", 0.001 + 1.5 * x, x) for i, x in enumerate(m)]
    d = spark.createDataFrame(rows, "firm string, s string, r double, m double").withColumn("d", F.to_date("s"))
    ix = events.trading_index(d, "firm", "d")
    e = spark.createDataFrame([(1, "a", "2020-01-10")], "e int, firm string, s string").withColumn("d", F.to_date("s"))
    a = events.anchors(e, ix, "firm", "d", "e", 7, 8, 2)
    mm = events.market_model(a, ix, "firm", "e", "r", "m", -8, -3)
    got = mm.first()
    assert got.alpha == pytest.approx(0.001) and got.beta == pytest.approx(1.5)
    ar = events.abnormal(a, ix, mm, "firm", "e", "r", "m", -2, 2)
    assert max(abs(r.ar_model) for r in ar.collect()) < 1e-12


def test_turnover_costs_and_growth(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (3, "b"), (3, "c")], "t int, x string")
    got = {r.t: r.turnover for r in panel.turnover(m, "t", "x").collect()}
    assert got == {1: None, 3: 0.5}
    s = sorts.net_of_costs(spark.createDataFrame([(0.01, 0.5)], "LS double, turnover double"), "LS", "turnover").first()
    assert s.net_10 == pytest.approx(0.009) and s.breakeven_bps == pytest.approx(100)
    c = panel.cumulative(spark.createDataFrame([(1, 1, 0.1), (1, 2, -1.0), (1, 3, 0.5)], "g int, t int, x double"), ["g"], "t", "x", "growth", "g1")
    assert [r.g1 for r in c.orderBy("t").collect()] == [pytest.approx(1.1), None, None]


def test_bh_fdr_and_compare(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    assert {r.k: round(r.q, 6) for r in validate.bh_fdr(p, "p", ["k"]).collect()} == {1: 0.03, 2: 0.04, 3: 0.04}
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, v double")
    assert {r.k: r.status for r in validate.compare(a, b, ["k"], "v", 1e-9).collect()} == {1: "same", 2: "removed", 3: "added"}


def test_spearman(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 1.0), (NAN, 3.0)]
    r = validate.correlations(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    d = pd.DataFrame(rows[:4]).rank()
    assert r.n == 4 and r.spearman == pytest.approx(d[0].corr(d[1]))


def test_reply_and_snippet(spark):
    r = one(spark, 'Sure: {"relevant": true, "type": "tariff", "confidence": 0.5} ok', validate.parse_reply("x"))
    assert (r.relevant, r.type, r.confidence, r.direction) == (True, "tariff", 0.5, None)
    s = spark.createDataFrame([("a", i, f"s{i}") for i in range(1, 31)], "Id string, k int, text string")
    h = spark.createDataFrame([("a", 2, "x y", 1), ("a", 20, "x y", 2), ("a", 22, "x y", 1)], "Id string, k int, bigram string, n long")
    got = validate.snippets(s, h, "Id", "k", "text").first()
    assert got.start == 16 and got.snippet == " ".join(f"s{i}" for i in range(16, 26))  # four before the densest sentence, five after
    for k, lo, hi in ((2, 1, 10), (29, 21, 30)):  # moved inside at either end
        got = validate.snippets(s, spark.createDataFrame([("a", k, "x y", 1)], "Id string, k int, bigram string, n long"), "Id", "k", "text").first()
        assert got.start == lo and got.snippet == " ".join(f"s{i}" for i in range(lo, hi + 1))


def test_empty_tables(spark):
    e = spark.createDataFrame([], "p int, id int, x double, y double")
    assert panel.bins(e, ["p"], "x", 5, "first", "id").count() == 0
    assert panel.winsorize(e, ["p"], "x").count() == 0
    assert regress.slopes(e, ["p"], "y", "x").count() == 0
    assert regress.grouped_ols(e, ["p"], "y", ["x", "id"]).count() == 0
    assert math.isnan(regress.two_way_fe(e, "id", "p", "y", ["x"])["x"]["b"])
    assert sorts.quantile_sort(e, ["p"], "x", "y", "id").count() == 0


def test_bins_and_quantiles_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for g, n in (("a", 1), ("b", 3), ("c", 7), ("d", 900), (None, 50), ("e", 600)):
        for i in range(n):
            v = rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), 0.0, None, float("nan")]) if g != "e" else rng.choice([0.0, 0.0, 1.0, rng.random()])
            rows.append((g, v, i * 7 % 100003))
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(3)
    known = {g: sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]) for g in {r[0] for r in rows}}
    for few, n, ties in ((5000, 5, "first"), (2, 5, "first"), (5000, 10, "average")):  # broadcasts, and joins where groups are many
        monkeypatch.setattr(panel, "GROUPS_MOST", few)
        monkeypatch.setattr(panel, "TIES_MOST", 100_000 if few > 2 else 3)
        got = {(r.g, r.id): r.bin for r in panel.bins(df, ["g"], "x", n, ties, "id").collect()}
        for g, ok in known.items():
            values = [v for v, _ in ok]
            for i, (v, k) in enumerate(ok):
                twice = 2 * (i + 1) if ties == "first" else bisect.bisect_left(values, v) + 1 + bisect.bisect_right(values, v)
                assert got[g, k] == -(-twice * n // (2 * len(ok)))
        assert all(got[r[0], r[2]] is None for r in rows if r[1] is None or r[1] != r[1])
    for r in panel.with_quantiles(df, ["g"], finite("x"), [0.0, 0.005, 0.5, 0.995, 1.0], "q").select("g", "q").distinct().collect():
        if known[r.g]:
            assert np.allclose(r.q, np.quantile([v for v, _ in known[r.g]], [0, 0.005, 0.5, 0.995, 1]), atol=1e-12)
        else:
            assert r.q is None


def test_downside_beta_and_time_effects(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=60)
    rows = [(f, t, float((1 + f) * m[t] + (m[t] < 0) * f * m[t] + rng.normal() * 0.01), float(m[t])) for f in (0, 1) for t in range(60)]
    df = spark.createDataFrame(rows, "f int, t int, r double, m double")
    mean = np.mean([x[3] for x in rows])
    for got in regress.downside_beta(df, ["f"], "r", "m", 12).collect():
        x, y = np.array([r[3] for r in rows if r[0] == got.f]), np.array([r[2] for r in rows if r[0] == got.f])
        low = x < mean
        assert got.downside_beta == pytest.approx(np.cov(y[low], x[low])[0, 1] / np.var(x[low], ddof=1))
        assert got.coskew == pytest.approx(np.mean((y - y.mean()) * (x - x.mean()) ** 2) / np.std(y, ddof=1) / np.var(x, ddof=1))
    assert regress.downside_beta(df, ["f"], "r", "m", 12, 40).filter("downside_beta IS NOT NULL").isEmpty()
    x = df.withColumn("x", F.col("r") * 2 + F.col("f"))
    got = regress.time_fe(x, "f", "t", "x", ["r"]).first()
    y, z = np.array([2 * r[2] + r[0] for r in rows]), np.array([r[2] for r in rows])
    t = np.array([r[1] for r in rows])
    dy, dz = (v - np.array([v[t == k].mean() for k in t]) for v in (y, z))
    assert got.b == pytest.approx((dy @ dz) / (dz @ dz)) and got.n == 120
    assert regress.time_fe(x.limit(0), "f", "t", "x", ["r"]).count() == 0


def test_standardised_on_own_rows(spark):
    """Each regressor is standardised over its own finite rows, before rows that lack another are dropped."""
    rng = np.random.default_rng(5)
    rows = [(t, float(rng.normal()), float(rng.normal()), None if i % 3 == 0 else float(rng.normal())) for t in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, y double, a double, b double")
    slopes = []
    for t in range(6):
        d = np.array([[r[1], r[2], np.nan if r[3] is None else r[3]] for r in rows if r[0] == t])
        z = (d - np.nanmean(d, axis=0)) / np.nanstd(d, axis=0, ddof=1)
        ok = ~np.isnan(d[:, 2])
        slopes.append(np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), z[ok, 1], z[ok, 2]]), d[ok, 0], rcond=None)[0][1:])
    got = {r.regressor: r["mean"] for r in regress.fama_macbeth(df, "t", "y", ["a", "b"], 1, 30).collect()}
    assert [got["a"], got["b"]] == pytest.approx(np.mean(slopes, axis=0))


def test_regions(spark):
    df = spark.createDataFrame([("NorthAmerica", "US"), ("AsiaPacific_DM", "Japan"), ("AsiaPacific_DM", None), ("Africa", "ZA"), ("EM", "Brazil"), (None, "US")], "r string, c string")
    assert [x[0] for x in df.select(identity.region("r", "c")).collect()] == ["NorthAmerica", "Japan", "AsiaPacExJapan", None, "Emerging", None]


def test_ensemble_searches_and_calibrates(spark):
    rng = random.Random(6)
    docs = [(f"d{i}", [rng.choice(["good one", "good two", "plain"] if i % 2 else ["bad one", "bad two", "plain"]) for _ in range(4)]) for i in range(80)]
    counts = spark.createDataFrame([(d, b, 1) for d, bs in docs for b in bs], "Id string, bigram string, n long").groupBy("Id", "bigram").agg(F.sum("n").alias("n"))
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)], "Id string, y int")
    voc = counts.select("bigram").distinct()
    folded = discovery.in_folds(labels, ["Id"], 4)
    auc = {r.alpha: r.auc for r in discovery.nb_search(counts, folded, voc, ["Id"]).collect()}
    assert set(auc) == {0.1, 0.5, 1.0} and min(auc.values()) > 0.95
    for search in (True, False):
        p = discovery.ensemble(counts, labels, voc, ["Id"], labels.select("Id"), trees=5, folds=2, search=search, costs=(1.0,), rounds=5).collect()
        right = [((r.p_nb > 0.5) == (int(r.Id[1:]) % 2 == 1)) + ((r.p_c2 > 0.5) == (int(r.Id[1:]) % 2 == 1)) + ((r.p_rf > 0.5) == (int(r.Id[1:]) % 2 == 1)) for r in p]
        assert len(p) == 80 and sum(right) > 0.9 * 240
