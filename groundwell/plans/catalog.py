"""All registered queries of the engine and their oracles."""

from __future__ import annotations

from groundwell.plans import relational_queries, search_queries, source_queries, storage_queries, text_queries, verify_queries
from groundwell.plans.common import Query

_MODULES = (text_queries, search_queries, verify_queries, storage_queries, relational_queries, source_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.reg.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.reg.oracles.items()}
