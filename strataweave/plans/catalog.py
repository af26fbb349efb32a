"""All registered queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from . import q_analytics, q_compaction, q_compiler, q_graph, q_ledger, q_lifecycle, q_policies, q_replica, q_services, q_sessions, q_syntax, q_text  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "r13_search_hints"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
