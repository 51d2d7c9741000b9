"""All registered queries and their SQL twins."""

from __future__ import annotations

from quire.plans import article_q, catalog_q, chunk_q, extract_q, search_q

_MODULES = [catalog_q, chunk_q, search_q, extract_q, article_q]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
