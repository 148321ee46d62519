"""Set-query language: S-expressions compiled to one lazy DataFrame plan.

``(files (intersect (deps "a" 2) (rdeps "b" 1)))`` becomes a single plan; the caller's action
runs it, but for walks deeper than one level, whose levels are written tables. Ids resolve to
a few modules through ``lookup.resolve``, whose result stays lazy as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.pattern import QueryError, depth_of, matches
from ..operators import graph as G
from ..operators import lookup, policy, ranges
from ..operators.graph import Graph


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) with kinds ( ) text and word; a backslash escapes inside quotes."""
    out, at = [], 0
    while at < len(text):
        char = text[at]
        if char.isspace():
            at += 1
        elif char in "()":
            out.append((char, char))
            at += 1
        elif char == '"':
            value, at = "", at + 1
            while at < len(text) and text[at] != '"':
                if text[at] == "\\" and at + 1 < len(text):
                    at += 1
                value += text[at]
                at += 1
            out.append(("text", value))
            at += 1
        else:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] not in '()"':
                end += 1
            out.append(("word", text[at:end]))
            at = end
    return out


def parse(text: str):
    """First form of the text: nested lists of strings and whole numbers."""
    rest = tokens(text)
    if not rest:
        raise QueryError("empty-query", text)

    def form(at: int):
        kind, value = rest[at]
        if kind == ")":
            raise QueryError("syntax", "unexpected )")
        if kind != "(":
            return (int(value) if value.lstrip("-").isdigit() else value), at + 1
        items, at = [], at + 1
        while at < len(rest) and rest[at][0] != ")":
            item, at = form(at)
            items.append(item)
        if at >= len(rest):
            raise QueryError("syntax", "missing )")
        return items, at + 1

    return form(0)[0]


class Compiler:
    """Turns a form into a DataFrame with a column ``module`` (or ``path``, ``n``, ``layer``)."""

    def __init__(self, graph: Graph, diff: Callable[[str], DataFrame] | None = None):
        self.graph, self.diff = graph, diff

    def run(self, text: str) -> DataFrame:
        return self.eval(parse(text))

    def eval(self, form) -> DataFrame:
        if not isinstance(form, list):
            return self._ids(str(form))
        if not form:
            return self._none()
        name = str(form[0]).replace("_", "-")
        found: Callable | None = getattr(self, "_do_" + name.replace("-", "_"), None)
        return self._none() if found is None else found(*form[1:])

    def _none(self) -> DataFrame:
        return self.graph.modules.select("module").limit(0)

    def _set(self, form) -> DataFrame:
        got = self.eval(form)
        return got if got.columns == ["module"] else got.select(F.col(got.columns[0]).cast("string").alias("module"))

    def _ids(self, pattern) -> DataFrame:
        return lookup.resolve(self.graph.modules, str(pattern)).select("module")

    def _do_resolve(self, pattern=""):
        return self._ids(pattern)

    def _reach(self, pattern, depth, reverse):
        return G.walk(self.graph, self._ids(pattern), depth_of(depth), reverse).select("module").distinct()

    def _do_deps(self, pattern="", depth=2):
        return self._reach(pattern, depth, False)

    def _do_rdeps(self, pattern="", depth=1):
        return self._reach(pattern, depth, True)

    def _beside(self, ids: DataFrame, reverse: bool) -> DataFrame:
        # Straight from the edges, without the aggregate over all pairs.
        here, there = ("target", "source") if reverse else ("source", "target")
        pairs = self.graph.edges.select(G.module_of(here).alias("here"), G.module_of(there).alias("module")).filter("here <> module")
        # Ids are distinct: an inner join keeps the plan small where a semi join is copied into every branch of a union.
        return pairs.join(ids.select(F.col("module").alias("here")), "here").select("module").distinct()

    def _do_imports(self, pattern=""):
        return self._beside(self._ids(pattern), False)

    def _do_dependents(self, pattern=""):
        return self._beside(self._ids(pattern), True)

    def _do_boundary(self, pattern=""):
        ids = self._ids(pattern)
        return ids.union(self._beside(ids, False)).union(self._beside(ids, True)).distinct()

    def _do_entity(self, name=""):
        return lookup.entity_definitions(self.graph, str(name)).select("module").distinct()

    def _do_refs_to(self, name=""):
        return lookup.refs_to(self.graph, str(name))

    def _do_intersect(self, a, b):
        return self._set(a).intersect(self._set(b))

    def _do_union(self, *parts):
        out = self._none()
        for part in parts:
            out = out.union(self._set(part))
        return out.distinct()

    def _do_diff(self, a, b):
        return self._set(a).subtract(self._set(b))

    def _do_filter(self, a, pattern):
        return self._set(a).filter(matches(F.col("module"), str(pattern)))

    def _do_files(self, a):
        return self._set(a).join(self.graph.modules.select("module", "path"), "module").select("path").distinct()

    def _do_count(self, a):
        return self._set(a).distinct().agg(F.count(F.lit(1)).alias("n"))

    def _do_layer(self, pattern=""):
        first = self._ids(pattern).agg(F.min("module").alias("module"))
        known = first.join(self.graph.modules.select("module", "purpose"), "module", "left")
        return known.select(F.when(F.col("module").isNull(), "unknown").otherwise(classify.layer(F.col("module"), F.col("purpose"))).alias("layer"))

    def _do_layer_of(self, a, layer):
        inside = policy.layered(self.graph.modules).filter(F.col("layer") == str(layer)).select("module")
        return self._set(a).join(inside, "module", "left_semi")

    def _do_violations(self, scope="all"):
        bad = policy.violations(self.graph).select(F.col("source").alias("module")).distinct()
        return bad if scope == "all" else bad.join(self._ids(scope), "module", "left_semi")

    def _do_find_function(self, name=""):
        short = classify.short_name(F.col("name"))
        hit = (F.col("name") == name) | (short == name) | matches(F.col("name"), str(name)) | matches(short, str(name))
        return self.graph.entities.filter("kind = 'fn'").filter(hit).select("module").distinct()

    def _do_find_type(self, name=""):
        return lookup.find_type(self.graph, str(name)).select("module").distinct()

    def _called(self, name, depth, reverse: bool) -> DataFrame:
        name = str(name)
        targets = lookup.resolve_function(self.graph, name)
        ids, own = targets.select(F.col("id").alias("_id")).distinct(), targets.select("module").distinct()
        calls = self.graph.edges.filter("etype = 'calls'")
        here, there = ("target", "source") if reverse else ("source", "target")
        direct = calls.join(ids, F.col(here) == F.col("_id"), "left_semi").select(G.module_of(there).alias("module"))
        beyond = G.walk(self.graph, own, depth_of(depth), reverse).select("module")
        out = direct.union(beyond)
        return (out.union(own) if reverse else out).distinct()

    def _do_find_callers(self, name="", depth=2):
        return self._called(name, depth, True)

    def _do_find_calls(self, name="", depth=2):
        return self._called(name, depth, False)

    def _do_search(self, pattern=""):
        return lookup.search(self.graph.modules, str(pattern))

    def _do_analyze(self, pattern=""):
        """Of several ids the least; without one only the count of no entities."""
        return policy.analyze_summary(self.graph, self._ids(pattern).agg(F.min("module").alias("module")))

    def _do_diff_functions(self, ref="HEAD"):
        """Modules of the functions that a diff against ``ref`` changes."""
        if self.diff is None:
            raise QueryError("no-diff", "diff-functions needs a working tree")
        by_path = self.graph.modules.select("module", "path")
        changed = ranges.changed_entities(ranges.hunks(self.diff(str(ref))), self.graph.entities.join(by_path, "module").select("path", "name", "line"))
        return changed.join(by_path, "path").select("module").distinct()


def query(graph: Graph, text: str, diff: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """``diff`` gives the lines (line_no, line) of a diff against a reference, for ``diff-functions``."""
    return Compiler(graph, diff).run(text)
