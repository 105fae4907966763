"""SQL with the same results as the queries, where SQL can express them."""

from __future__ import annotations

RECORDS = """(SELECT permno, CAST(year(Month) * 100 + month(Month) AS INTEGER) AS month_id, min(RetM) AS RetM FROM crsp_returns_monthly
 WHERE permno IS NOT NULL AND Month IS NOT NULL AND RetM IS NOT NULL AND isfinite(RetM) GROUP BY 1, 2)"""

BIGRAMS = r"""
WITH s AS (SELECT Id, sentence_id, min(text) AS text FROM sentences WHERE Id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
w AS (SELECT Id, sentence_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}_]{2,}') AS t FROM s),
b AS (SELECT Id, sentence_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM w WHERE len(t) > 1),
a AS (SELECT bigram, count(*) AS n, count(DISTINCT (Id, sentence_id)) AS d FROM b GROUP BY 1),
f AS (SELECT year, batch, trim(regexp_replace(lower(bigram), '[^\p{L}\p{N}]+', ' ', 'g')) AS bigram, max(feat_freq) AS n, max(docfreq) AS d FROM feat_freq WHERE bigram IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT bigram, CAST(sum(n) AS BIGINT) AS feat_freq, CAST(sum(d) AS BIGINT) AS docfreq FROM (SELECT bigram, n, d FROM a UNION ALL SELECT bigram, n, d FROM f) GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM s) + (SELECT sum(m) FROM (SELECT max(n_sentences) AS m FROM feat_freq GROUP BY year, batch)) AS total)
SELECT bigram, feat_freq, docfreq, CASE WHEN docfreq < 5 THEN 'rare' WHEN docfreq * 50 > total THEN 'common' END AS mark FROM u, t
"""

TOP = f"""
WITH e AS (SELECT *, coalesce(CAST(form_q AS DATE), CASE WHEN quarter BETWEEN 1 AND 4 THEN make_date(year, quarter * 3 - 2, 1) END) AS form FROM exposure_firmquarter_crsp WHERE permno IS NOT NULL AND known_ts IS NOT NULL),
l AS (SELECT * FROM e WHERE form IS NOT NULL QUALIFY row_number() OVER (PARTITION BY permno, form ORDER BY known_ts DESC, fq_id DESC) = 1),
h AS (SELECT permno, siccd, GeoRisk, form + to_months(CAST(k AS INTEGER)) AS m FROM l, range(3, 6) AS r(k) WHERE GeoRisk IS NOT NULL AND isfinite(GeoRisk) AND siccd IS NOT NULL),
c AS (SELECT CAST(year(m) * 100 + month(m) AS INTEGER) AS month_id, siccd, permno, GeoRisk FROM h)
SELECT month_id, siccd, permno, GeoRisk FROM c SEMI JOIN {RECORDS} r USING (permno, month_id)
QUALIFY row_number() OVER (PARTITION BY month_id, siccd ORDER BY GeoRisk DESC, permno) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_bigrams": BIGRAMS,
        "p1_found": f"SELECT bigram, mark FROM ({BIGRAMS}) WHERE mark IS NOT NULL",
        "p2_rank_bound": f"SELECT DISTINCT month_id, CAST(prob AS DOUBLE) AS prob, true AS within FROM {RECORDS}, (VALUES (0.25), (0.5), (0.75)) AS q(prob)",
        "p2_found": f"WITH r AS {RECORDS}, q AS (SELECT month_id, quantile_cont(RetM, 0.25) AS p25, quantile_cont(RetM, 0.5) AS p50, quantile_cont(RetM, 0.75) AS p75 FROM r GROUP BY 1) SELECT permno, month_id FROM r JOIN q USING (month_id) WHERE abs(RetM - p50) > 10 * (p75 - p25)",
        "p4_top_risk": TOP,
        "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
        "p4_found": f"SELECT month_id, siccd, permno FROM ({TOP})",
    }
