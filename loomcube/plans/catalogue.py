"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from loomcube.plans import assoc_queries, cube_queries, graph_queries, index_queries, lifecycle_queries, model_queries, reader_queries, source_queries, text_queries, update_queries

_MODULES = (cube_queries, text_queries, graph_queries, assoc_queries, source_queries, reader_queries, lifecycle_queries, index_queries, model_queries, update_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
