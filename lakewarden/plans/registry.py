"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from lakewarden.plans import (
    customer_queries,
    decision_queries,
    history_queries,
    stream_queries,
    trust_queries,
)

MODULES = [customer_queries, trust_queries, decision_queries, history_queries, stream_queries]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
