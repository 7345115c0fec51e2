"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quire.llm import corpus_queries

MODULES = [corpus_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
