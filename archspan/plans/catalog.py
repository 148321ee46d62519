"""What the registered queries share: the list of them, and SQL for the projected graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import classify
from ..sources import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CTES = {
    "edges": P.EDGES_SQL,
    "neighbors": P.NEIGHBORS_SQL,
    "modules": P.MODULES_SQL,
    "calls": P.CALLS_SQL,
    "entities": P.ENTITIES_SQL,
    "layered": f"select module, purpose, {classify.layer_by_path_sql('module')} as layer from modules",
    "ends": "select etype, source, target, split_part(source,'::',1) as src_mod, split_part(target,'::',1) as dst_mod, nullif(split_part(source,'::',2),'') as src_ent, nullif(split_part(target,'::',2),'') as dst_ent from edges",
    "deny": "select * from (values " + ",".join(f"('{a}','{b}','{c}')" for a, b, c in classify.DENY_RULES) + ") t(src_layer, dst_layer, reason)",
    "lines": "select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) + 1 as line_no from documents",
    "sids": "select module, concat(case lang when 'java' then 'ja' when 'tsx' then 'ts' when 'ts' then 'ts2_' when 'rb' then 'rb' when 'go' then 'go' else 'py' end, row_number() over (partition by lang order by module)-1) as sid, lang as pkg from modules",
}
NEEDS = {"neighbors": ("edges",), "layered": ("modules",), "ends": ("edges",), "sids": ("modules",)}


def with_sql(*names: str, recursive: str = "") -> str:
    """WITH clause of the named pieces and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    body = ", ".join(f"{n} as ({CTES[n]})" for n in order)
    return f"with recursive {body}{', ' + recursive if recursive else ''} " if body or recursive else ""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL for the same rows where SQL can express them."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep
