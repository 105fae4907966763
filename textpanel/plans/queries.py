"""All queries of the library itself: each takes (spark, folder of tables)."""

from __future__ import annotations

from . import econ_queries, identity_queries, known_exposure, panel_queries, text_queries  # noqa: F401
from .registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return {"p5_found": known_exposure.p5_found, **QUERIES}
