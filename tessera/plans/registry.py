"""All registered queries of the core, by name."""

from __future__ import annotations

from tessera.plans import code_queries, graph_queries, snapshot_queries

QUERIES = {**snapshot_queries.QUERIES, **code_queries.Q, **graph_queries.Q}
ORACLE = {**snapshot_queries.ORACLE, **code_queries.SQL, **graph_queries.SQL}
