"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from . import bibliography, documents, exports, formulas, forms, glyphs, graphs, library, markers, reader, reconstruction, records, sidecars, states, tables, vectors  # noqa: F401  they register their queries
from .book import ORACLES, QUERIES, Query

FLAGSHIP = "search_bm25_term"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
