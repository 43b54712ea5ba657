"""All core queries and the SQL that checks them."""

from __future__ import annotations

from gleanery.plans import deal_queries, general_queries, source_queries, text_queries

_MODULES = (general_queries, deal_queries, text_queries, source_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
