"""Collects queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable[..., DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _sha(*parts: str) -> str:
    return "sha256(" + "||".join(f"{p}||chr(0)" for p in parts) + ")"


def ent(kind: str, qn: str) -> str:
    return "'ent:'||substr(" + _sha("'star'", "'snap-1'", f"'{kind}'", qn, "'1'", "'1'") + ",1,12)"


def rel(kind: str, a: str, b: str) -> str:
    return "'rel:'||substr(" + _sha("'build-2'", f"'{kind}'", a, b) + ",1,12)"


def _node(kind, name, qn, file, frm):
    return f"SELECT {ent(kind, qn)} AS entity_id, '{kind}' AS kind, {name} AS name, {qn} AS qualified_name, {file} AS file, lower({name}) AS name_fold, lower({qn}) AS qn_fold FROM {frm}"


NODES = " UNION ALL ".join(
    [
        _node("module", "r_name", "'region::'||r_name", "'geo/'||r_name||'.md'", "region"),
        _node("module", "n_name", "'nation::'||n_name", "'geo/'||r_name||'/'||n_name||'.md'", "nation JOIN region ON n_regionkey=r_regionkey"),
        _node("symbol", "c_name", "'customer::'||c_custkey", "'crm/'||c_mktsegment||'/'||n_name||'.rs'", "customer JOIN nation ON c_nationkey=n_nationkey"),
        _node("symbol", "s_name", "'supplier::'||s_suppkey", "'supply/'||n_name||'/suppliers.rs'", "supplier JOIN nation ON s_nationkey=n_nationkey"),
        _node("definition", "p_name", "'part::'||p_partkey", "'catalog/'||p_brand||'/'||p_type||'.rs'", "part"),
        _node("definition", "'order-'||o_orderkey", "'order::'||o_orderkey", "'crm/'||o_orderpriority||'/orders.rs'", "orders"),
    ]
)


def _edge(kind, a, b, frm, cls="'extracted'"):
    return f"SELECT {rel(kind, 'f', 't')} AS rel_id, '{kind}' AS rel_type, f AS from_id, t AS to_id, class FROM (SELECT {a} AS f, {b} AS t, {cls} AS class FROM {frm})"


def edges_sql(build: int = 2) -> str:
    orders = "orders" if build == 2 else "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')"
    lines = "lineitem" if build == 2 else f"(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {orders}))"
    worst = "CASE max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'ambiguous' WHEN 1 THEN 'inferred' ELSE 'extracted' END"
    pairs = lambda key: f"(SELECT {key}, l_partkey, {worst} AS c FROM {lines} GROUP BY ALL)"
    return " UNION ALL ".join(
        [
            _edge("contains", ent("module", "'region::'||r_name"), ent("module", "'nation::'||n_name"), "nation JOIN region ON n_regionkey=r_regionkey"),
            _edge("contains", ent("module", "'nation::'||n_name"), ent("symbol", "'customer::'||c_custkey"), "customer JOIN nation ON c_nationkey=n_nationkey"),
            _edge("contains", ent("module", "'nation::'||n_name"), ent("symbol", "'supplier::'||s_suppkey"), "supplier JOIN nation ON s_nationkey=n_nationkey"),
            _edge("calls", ent("symbol", "'customer::'||o_custkey"), ent("definition", "'order::'||o_orderkey"), orders),
            _edge("references", ent("definition", "'order::'||l_orderkey"), ent("definition", "'part::'||l_partkey"), pairs("l_orderkey"), "c"),
            _edge("implements", ent("symbol", "'supplier::'||l_suppkey"), ent("definition", "'part::'||l_partkey"), pairs("l_suppkey"), "c"),
        ]
    )


GRAPH = f"nodes AS ({NODES}), edges AS ({edges_sql()})"
