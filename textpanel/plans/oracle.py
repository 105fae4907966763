"""SQL with the same results as the queries, where SQL can express them."""

from __future__ import annotations

P5 = """
WITH r AS (SELECT DISTINCT permno, CAST(date_trunc('month', Month) AS DATE) AS m FROM crsp_returns_monthly WHERE permno IS NOT NULL AND Month IS NOT NULL AND RetM IS NOT NULL AND isfinite(RetM)),
e AS (SELECT permno, fq_id, known_ts, coalesce(CAST(form_q AS DATE), CASE WHEN quarter BETWEEN 1 AND 4 THEN make_date(year, quarter * 3 - 2, 1) END) AS form FROM exposure_firmquarter_crsp WHERE permno IS NOT NULL AND known_ts IS NOT NULL)
SELECT permno, CAST(year(m) * 100 + month(m) AS INTEGER) AS month_id, fq_id FROM r JOIN e USING (permno) WHERE form + INTERVAL 3 MONTH <= m AND known_ts < CAST(m AS TIMESTAMP)
QUALIFY row_number() OVER (PARTITION BY permno, m ORDER BY form DESC, known_ts DESC, fq_id DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    from . import queries  # noqa: F401
    from .registry import SQL

    return {"p5_found": P5, **SQL}
