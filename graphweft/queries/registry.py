"""Where queries and their SQL are collected, and the graph as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.graph import EDGE_TABLES, NODE_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that DuckDB runs for it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _nodes() -> str:
    return " union all ".join(f"select '{label}:' || {key}::varchar as id, '{label}' as label, {name or 'null::varchar'} as name from {table}" for label, table, key, name, _ in NODE_TABLES)


def _props() -> str:
    parts = []
    for label, table, key, name, more in NODE_TABLES:
        for p, c, kind in ((("name", name, "String"),) if name else ()) + more:
            parts.append(f"select '{label}:' || {key}::varchar as id, '{label}' as label, '{p}' as key, {c}::varchar as value, '{kind}' as type from {table}")
    return " union all ".join(parts)


def _edges() -> str:
    parts = []
    for kind, s, sk, t, tk, table, fold in EDGE_TABLES:
        source = f"select {sk} as s, min({tk}) as t from {table} group by 1" if fold == "least" else f"select {'distinct ' if fold == 'distinct' else ''}{sk} as s, {tk} as t from {table}"
        parts.append(f"select '{s}:' || s::varchar as source_id, '{s}' as source_label, '{kind}' as rel_type, '{t}:' || t::varchar as target_id, '{t}' as target_label from ({source})")
    return " union all ".join(parts)


NODES, PROPS, EDGES = f"nodes as ({_nodes()})", f"props as ({_props()})", f"edges as ({_edges()})"
BOTH = "both_ways as (select * from edges union all select target_id, target_label, rel_type, source_id, source_label from edges where source_id <> target_id)"
