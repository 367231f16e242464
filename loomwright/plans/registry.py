"""All queries of the engine's own operators, with the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

from . import build_queries, mcq_queries, record_queries, reward_queries, set_queries, source_queries, stream_queries

_MODULES = (reward_queries, mcq_queries, record_queries, build_queries, set_queries, source_queries, stream_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text.strip() for module in _MODULES for name, text in module.SQL.items()}
