"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import change_queries, graph_queries, search_queries, tool_queries

MODULES = (graph_queries, search_queries, change_queries, tool_queries)
QUERIES = {k: f for m in MODULES for k, (f, _) in m.REGISTERED.items()}
ORACLES = {k: sql for m in MODULES for k, (_, sql) in m.REGISTERED.items() if sql}
