"""All registered queries and their DuckDB oracles, gathered from the per-area modules."""

from __future__ import annotations

from tessera.plans import (cluster_queries, nested_queries, prep_queries, rec_queries, source_queries,
                           sparse_queries, stream_queries)

_MODULES = [prep_queries, rec_queries, cluster_queries, sparse_queries, source_queries, nested_queries, stream_queries]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracles():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
