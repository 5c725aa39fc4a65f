"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from .plans import fold_queries, routing_queries, store_queries

_PARTS = (store_queries, routing_queries, fold_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
