"""Queries over whole projections against plain Python."""

import os
from collections import Counter, defaultdict

import pytest

from archspan.plans import registry
from archspan.sources import factmap
from archspan.sources import projection as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_every_line_is_looked_up(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((f"d{r['doc_id']}", i + 1, f"fn{i // 10 * 10 + 1}") for r in texts for i in range(len(r["text"].split("\n"))))
    got = sorted((r["path"], r["ref_line"], r["name"]) for r in registry.queries()["enclosing_entity_asof"](spark, SF).collect())
    assert got == want


def test_every_module_has_its_short_id(spark):
    modules = {r["module"]: r["pkg"] for r in P.modules(spark, SF).collect()}
    got = registry.queries()["short_ids_all"](spark, SF).collect()
    assert {r["module"]: r["pkg"] for r in got} == modules and len({r["sid"] for r in got}) == len(got) == len(modules)
    by = defaultdict(list)
    for r in got:
        by[r["pkg"]].append((r["module"], r["sid"]))
    for rows in by.values():
        rows.sort()
        prefix = rows[0][1].removesuffix("0")
        assert [sid for _, sid in rows] == [f"{prefix}{i}" for i in range(len(rows))]


def test_facts_hold_the_whole_graph(spark):
    graph = P.graph(spark, SF)
    lines = registry.queries()["fact_lines_all"](spark, SF).collect()
    n = {name: getattr(graph, name).count() for name in ("modules", "entities", "edges")}
    assert all(n.values())
    assert Counter(r["part"] for r in lines) == {0: 1, 1: n["modules"], 2: n["modules"], 3: n["entities"], 4: n["edges"]}
    _, facts = factmap.parse("\n".join(r["fact"] for r in sorted(lines)))
    ends = Counter((kind, *args[:2]) for _, kind, args, _, _ in facts if kind in factmap._EDGE_KINDS)
    assert ends == Counter((r["etype"], r["source"], r["target"]) for r in graph.edges.collect())
    assert {args[0] for _, kind, args, _, _ in facts if kind == "node"} == {r["module"] for r in graph.modules.collect()}
