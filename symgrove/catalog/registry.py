"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from symgrove.catalog import (
    context_queries, file_queries, node_queries, run_queries, search_queries, stream_queries,
    symbol_queries)

_AREAS = [file_queries, symbol_queries, node_queries, search_queries, context_queries,
          run_queries, stream_queries]

QUERIES = {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
