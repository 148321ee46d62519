"""The architecture graph and traversal operators.

Every operator takes and returns lazy DataFrames. Traversal comes in two modes:
``hop`` gives each reached module its least distance, ``strict`` gives the rows of a
depth-limited depth-first walk whose visited set is global, in which a module
first met at the limit is never expanded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes of a frontier that is sent to all executors once it is counted; a row takes about ``FRONTIER_ROW``.
FRONTIER_BYTES, FRONTIER_ROW = 8 << 20, 256


def module_of(entity: str | Column) -> Column:
    """Module part of an id: text before the first ``::``."""
    return F.substring_index(entity, "::", 1)


def bare_name(entity: str | Column) -> Column:
    """Text after the first ``::`` (entity names may hold ``::``); null for a module."""
    column = F.col(entity) if isinstance(entity, str) else entity
    return F.when(column.contains("::"), column.substr(F.locate("::", column) + 2, F.length(column)))


@dataclass
class Graph:
    """modules, entities, edges and calls as in ``archspan.schema``."""

    modules: DataFrame
    entities: DataFrame
    edges: DataFrame

    def cached(self) -> Graph:
        """The same graph with its edges kept by the executors, for edges that are computed and read many times."""
        return Graph(self.modules, self.entities, self.edges.persist())

    @cached_property
    def ends(self) -> DataFrame:
        """Edges with the modules and bare entity names of both ends."""
        return self.edges.withColumns({"src_mod": module_of("source"), "dst_mod": module_of("target"), "src_ent": bare_name("source"), "dst_ent": bare_name("target")})

    @cached_property
    def neighbors(self) -> DataFrame:
        """(src_mod, dst_mod, via): one row for each pair of different modules."""
        pairs = self.edges.select(module_of("source").alias("src_mod"), module_of("target").alias("dst_mod"), "etype")
        return pairs.filter("src_mod <> dst_mod").groupBy("src_mod", "dst_mod").agg(F.min("etype").alias("via"))

    def steps(self, reverse: bool = False) -> DataFrame:
        """(here, there, via) of every edge between modules, pairs repeated as edges are."""
        here, there = ("target", "source") if reverse else ("source", "target")
        pairs = self.edges.select(module_of(here).alias("here"), module_of(there).alias("there"), F.col("etype").alias("via"))
        return pairs.filter("here <> there")

    def around(self, reverse: bool = False) -> DataFrame:
        """(here, there, via) along the edges, or against them."""
        here, there = ("dst_mod", "src_mod") if reverse else ("src_mod", "dst_mod")
        return self.neighbors.select(F.col(here).alias("here"), F.col(there).alias("there"), "via")


def hops(graph: Graph, roots: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(root, module, depth, via) for modules at least distance 1..depth from each root.

    ``roots`` has a column module. via is the least edge type among the edges
    that reach the module at that distance. Frontiers are expanded together for all roots.
    Every level but the last is a written table, so that a level is planned once; a small
    frontier goes to the edges, a large one is joined with them by shuffle.
    """
    # The least type over all edges needs no least type of each pair before it.
    near = graph.steps(reverse)
    scratch = Scratch(roots.sparkSession)
    seen = roots.select(F.col("module").alias("root"), "module", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct()
    if depth > 1:
        seen = scratch.write(seen, "level0")
    frontier = seen
    for level in range(1, depth + 1):
        here = frontier.select("root", F.col("module").alias("here"))
        if depth > 1 and frontier.count() * FRONTIER_ROW <= FRONTIER_BYTES:
            here = F.broadcast(here)
        reached = near.join(here, "here").groupBy("root", "there").agg(F.min("via").alias("via"))
        fresh = reached.join(seen.select(F.col("root"), F.col("module").alias("there")), ["root", "there"], "left_anti").select("root", F.col("there").alias("module"), F.lit(level).alias("depth"), "via")
        if level < depth:
            fresh = scratch.write(fresh, f"level{level}")
            if not fresh.take(1):
                break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen.filter("depth > 0")


def walk(graph: Graph, roots: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(root, step, depth, via, module, cycle): rows of the strict walk of each root.

    Children are visited by id. The walk runs on the part of the graph within
    ``depth`` hops of its root, which holds every module it can reach. The order of such a walk is
    sequential by definition, so each root is one task's group: about 100 bytes of memory for each edge
    within reach. ``hops`` is the operator for reaches beyond that.
    """
    near = graph.steps(reverse)
    inside = hops(graph, roots, max(depth - 1, 0), reverse).select("root", "module") if depth > 1 else None
    starts = roots.select(F.col("module").alias("root"), "module").distinct()
    nodes = starts if inside is None else starts.unionByName(inside).distinct()
    parts = nodes.select("root", F.col("module").alias("here")).join(near, "here").groupBy("root", "here", "there").agg(F.min("via").alias("via"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].iloc[0]
        children: dict[str, list[tuple[str, str]]] = {}
        for here, there, via in zip(pdf["here"], pdf["there"], pdf["via"], strict=True):
            children.setdefault(here, []).append((there, via))
        seen, rows = {root}, []
        stack = [(1, iter(sorted(children.get(root, []))))]
        while stack:
            level, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                continue
            there, via = child
            again = there in seen
            rows.append((root, len(rows), level, via, there, again))
            if not again:
                seen.add(there)
                if level < depth:
                    stack.append((level + 1, iter(sorted(children.get(there, [])))))
        return pd.DataFrame(rows, columns=["root", "step", "depth", "via", "module", "cycle"])

    if depth < 1:
        return roots.sparkSession.createDataFrame([], "root string, step int, depth int, via string, module string, cycle boolean")
    return parts.groupBy("root").applyInPandas(run, "root string, step int, depth int, via string, module string, cycle boolean")


def boundary(graph: Graph, module: str) -> DataFrame:
    """(role, module, via): the module itself and its neighbors in both directions."""
    out = graph.neighbors.filter(F.col("src_mod") == module).select(F.lit("out").alias("role"), F.col("dst_mod").alias("module"), "via")
    into = graph.neighbors.filter(F.col("dst_mod") == module).select(F.lit("in").alias("role"), F.col("src_mod").alias("module"), "via")
    own = graph.modules.filter(F.col("module") == module).select(F.lit("self").alias("role"), "module", F.lit("").alias("via"))
    return own.unionByName(out).unionByName(into)


def boundary_files(graph: Graph, module: str) -> DataFrame:
    """(rank, path): distinct files of the boundary, the module's own first, then out, then in."""
    ranked = boundary(graph, module).withColumn("rank", F.when(F.col("role") == "self", 0).when(F.col("role") == "out", 1).otherwise(2))
    return ranked.join(graph.modules.select("module", "path"), "module").groupBy("path").agg(F.min("rank").alias("rank"))


def flow(graph: Graph, module: str, entity: str, depth: int = 5) -> DataFrame:
    """(depth, source, target, via, module_level): edges followed from an entity.

    From an entity both its own edges and the edges of its module are followed,
    to ``depth`` levels; each node is expanded once, at its least depth.
    """
    edges = graph.edges.select("source", "target", "etype")
    spark = edges.sparkSession
    scratch = Scratch(spark)
    edges = scratch.write(edges, "edges")
    frontier = spark.createDataFrame([(f"{module}::{entity}",)], "node string")
    seen, out = frontier, None
    for level in range(depth + 1):
        own = frontier.join(edges, frontier.node == edges.source).select("node", "target", "etype", F.lit(False).alias("module_level"))
        plain = edges.filter("source not like '%::%'")
        wide = frontier.filter("node like '%::%'").join(plain, module_of("node") == plain.source).select("node", "target", "etype", F.lit(True).alias("module_level"))
        step = scratch.write(own.unionByName(wide).select(F.lit(level).alias("depth"), F.col("node").alias("source"), "target", F.col("etype").alias("via"), "module_level").distinct(), f"flow{level}")
        out = step if out is None else out.unionByName(step)
        frontier = scratch.write(step.select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"), f"front{level}")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return out


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): everything reachable from roots (node) over (parent, child), roots excluded unless on a cycle.

    A frontier loop to the fixpoint; each level is a written table.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.write(links.select("parent", "child").filter("parent is not null").distinct(), "links")
    frontier, seen, level = roots.select("node").distinct(), None, 0
    while True:
        level += 1
        fresh = frontier.join(links, frontier.node == links.parent).select(F.col("child").alias("node")).distinct()
        if seen is not None:
            fresh = fresh.join(seen.select("node"), "node", "left_anti")
        fresh = scratch.write(fresh.withColumn("depth", F.lit(level)), f"level{level}")
        seen = fresh if seen is None else seen.unionByName(fresh)
        if not fresh.take(1):
            return seen
        frontier = fresh.select("node")


def call_chain(calls: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """(hops, path): shortest path of calls from any source to any target node, least path among equals.

    A frontier loop that keeps one least path for every reached node.
    """
    scratch = Scratch(calls.sparkSession)
    calls = scratch.write(calls.select("source", "target").distinct(), "calls")
    targets = scratch.write(targets.select("node").distinct(), "targets")
    front = scratch.write(sources.select("node", F.array("node").alias("path")).groupBy("node").agg(F.min("path").alias("path")), "front0")
    seen = front.select("node")
    for level in range(depth + 1):
        found = front.join(targets, "node", "left_semi")
        if found.take(1):
            return found.select(F.lit(level).alias("hops"), "path").orderBy("path").limit(1)
        if level == depth:
            break
        ahead = front.join(calls, front.node == calls.source).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        front = scratch.write(ahead.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"), f"front{level + 1}")
        seen = seen.unionByName(front.select("node"))
    return front.limit(0).select(F.lit(0).alias("hops"), "path")
