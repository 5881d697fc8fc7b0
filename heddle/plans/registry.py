"""The registered queries over the driver's tables, and the SQL that checks each."""

from __future__ import annotations

from . import text_queries, trade_graph

_MODULES = (trade_graph, text_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
