"""Commands over a graph, answered as fact lines.

Each command builds lazy DataFrames and runs one action for what it prints; the
printed rows are few by nature. ``run`` takes a command and its arguments.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import QueryError, depth_of, to_like
from ..operators import graph as G
from ..operators import lookup, policy, ranges
from ..operators.graph import Graph
from . import sexpr

# Endings and index files tried for the file of a module id, in order.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".py", ".rb", ".rake", ".rs", ".pas", ".pp", ".lpr", ".dpr", ".go", ".java", ".cs")
INDEXES = ("index.ts", "index.tsx", "index.js", "__init__.py", "mod.rs")

def quoted(text: str) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'

def fact(tag: str, *atoms, **flags) -> str:
    """One line; flags keep their order, and a flag without a value is None."""
    parts = [tag, *(str(a) for a in atoms)]
    for name, value in flags.items():
        name = name.rstrip("_").replace("_", "-")
        if value is None or value is False:
            continue
        parts.append(f":{name}" if value is True else f":{name} {value}")
    return f"({' '.join(parts)})"

class Report:
    def __init__(self, graph: Graph, root: str = ".", facts: DataFrame | None = None, sources: DataFrame | None = None, diff: Callable[[str], DataFrame] | None = None):
        self.graph, self.root, self.facts, self.sources, self.diff = graph, root, facts, sources, diff
        self._info: dict[str, tuple[str, str]] = {}

    # Lookups of what a line shows beside an id.

    def know(self, modules: Iterable[str]) -> None:
        missing = sorted({m for m in modules if m not in self._info})
        if missing:
            rows = self.graph.modules.filter(F.col("module").isin(missing)).select("module", "lang", "path", "purpose").collect()
            old = policy.OLD_CODES
            self._info |= {m: ("", m, "") for m in missing} | {r["module"]: (old.get(r["lang"], r["lang"]), r["path"], r["purpose"] or "") for r in rows}

    def lang(self, module: str) -> str:
        return self._info[module][0]

    def file(self, module: str) -> str:
        path = self._info[module][1]
        tried = [path, *(path + e for e in ENDINGS), *(f"{path}/{i}" for i in INDEXES)]
        return next((t for t in tried if os.path.isfile(os.path.join(self.root, t))), path)

    def ids(self, pattern: str) -> list[str]:
        found = [r["module"] for r in lookup.resolve(self.graph.modules, pattern).orderBy("module").collect()]
        self.know(found)
        return found

    def no_match(self, pattern: str) -> list[str]:
        near = [r["module"] for r in lookup.suggest(self.graph.modules, pattern).collect()]
        return [fact("error", "no-match", quoted(pattern)), *(fact("suggestion", m) for m in near)]

    def entities(self, module: str) -> list[str]:
        out = []
        for e in self.graph.entities.filter(F.col("module") == module).orderBy("line", "name").collect():
            lists = [f"(:{n} {' '.join(v)})" for n, v in (("bases", e["bases"]), ("deco", e["deco"]), ("methods", e["methods"])) if v]
            out.append(fact(e["kind"], module, e["name"], e["line"], ":lang", self.lang(module), *lists))
        return out

    def edge(self, row) -> str:
        flags = " ".join(f":{f}" for f in (row["flags"] if "flags" in row.__fields__ and row["flags"] else []))
        return f"({' '.join(x for x in (row['etype'], row['source'], row['target'], flags) if x)})"

    def _edges(self, where) -> list:
        return self.graph.ends.filter(where).orderBy("etype", "source", "target").collect()

    # Commands.

    def module(self, pattern: str) -> list[str]:
        out = []
        for m in self.ids(pattern):
            out.append(fact("node", m, ":lang", self.lang(m), quoted(self._info[m][2]), ":file", quoted(self.file(m))))
            out += self.entities(m)
            out += [self.edge(e) for e in self._edges(F.col("src_mod") == m)]
            out += [self.edge(e) for e in self._edges((F.col("dst_mod") == m) & (F.col("src_mod") != m))]
        return out or self.no_match(pattern)

    def _walk(self, pattern: str, depth: int, reverse: bool) -> list[str]:
        roots = self.ids(pattern)
        if not roots:
            return self.no_match(pattern)
        start = self.graph.modules.select("module").filter(F.col("module").isin(roots))
        rows = G.walk(self.graph, start, depth_of(depth), reverse).orderBy("root", "step").collect()
        self.know(r["module"] for r in rows)
        out, head = [], "rdep" if reverse else "dep"
        for root in roots:
            out.append(fact(f"{head}s-root", root, lang=self.lang(root)))
            out += [fact(head, root, r["module"], lang=self.lang(r["module"]), via=r["via"], depth=r["depth"], cycle=r["cycle"]) for r in rows if r["root"] == root]
        return out

    def deps(self, pattern: str, depth: str = "2") -> list[str]:
        return self._walk(pattern, depth, False)

    def rdeps(self, pattern: str, depth: str = "2") -> list[str]:
        return self._walk(pattern, depth, True)

    def entity(self, name: str) -> list[str]:
        found = lookup.entity_definitions(self.graph, name).orderBy("module", "line", "name").collect()
        if not found:
            return self.no_match(name)
        self.know(r["module"] for r in found)
        out = [fact("entity-def", r["kind"], r["module"], r["name"], r["line"], lang=self.lang(r["module"]), file=quoted(self.file(r["module"]))) for r in found]
        return out + [fact(r["etype"], r["source"], r["target"]) for r in lookup.entity_references(self.graph, name).orderBy("etype", "source", "target").collect()]

    def flow(self, pattern: str, name: str) -> list[str]:
        roots = self.ids(pattern)
        if not roots:
            return self.no_match(pattern)
        rows = G.flow(self.graph, roots[0], name).orderBy("depth", "source", "target", "via").collect()
        self.know(r["target"].split("::")[0] for r in rows)
        return [fact("flow", r["source"], r["target"], lang=self.lang(r["target"].split("::")[0]), via=r["via"], depth=r["depth"], module_level=r["module_level"]) for r in rows]

    def boundary(self, pattern: str, files_only: str = "") -> list[str]:
        roots = self.ids(pattern)
        if not roots:
            return self.no_match(pattern)
        m = roots[0]
        rows = G.boundary(self.graph, m).orderBy("role", "module").collect()
        self.know(r["module"] for r in rows)
        out_, in_ = ([(r["module"], r["via"]) for r in rows if r["role"] == role] for role in ("out", "in"))
        if files_only == "--files-only":
            return list(dict.fromkeys(self.file(x) for x in (m, *(o for o, _ in out_), *(i for i, _ in in_))))
        lines = [fact("boundary", m, lang=self.lang(m), file=quoted(self.file(m)), purpose=quoted(self._info[m][2])), *self.entities(m)]
        for tag, side in (("boundary-dep", out_), ("boundary-rdep", in_)):
            lines += [fact(tag, m, x, lang=self.lang(x), file=quoted(self.file(x)), relation=via) for x, via in side]
        return [*lines, fact("boundary-summary", m, total=1 + len(out_) + len(in_), deps=len(out_), rdeps=len(in_))]

    def analyze(self, pattern: str) -> list[str]:
        roots = self.ids(pattern)
        if not roots:
            return self.no_match(pattern)
        m = roots[0]
        out_ = self._edges(F.col("src_mod") == m)
        in_ = self._edges((F.col("dst_mod") == m) & (F.col("src_mod") != m))
        imports = sorted({e["dst_mod"] for e in out_ if e["etype"] == "imports"})
        flows = sorted({e["dst_mod"] for e in out_ if e["etype"] == "data-flow"})
        refs = [e for e in out_ if e["etype"] == "refs"]
        importers = {e["src_mod"] for e in in_ if e["etype"] == "imports"}
        others = {e["src_mod"] for e in in_ if e["etype"] != "imports"}
        users = sorted(importers | others)
        self.know([*imports, *flows, *users])
        lines = [fact("analyze", m, ":lang", self.lang(m), quoted(self._info[m][2]), ":file", quoted(self.file(m))), *self.entities(m)]
        lines += [fact("analyze-import", m, t, lang=self.lang(t), file=quoted(self.file(t))) for t in imports]
        lines += [fact("analyze-dataflow", m, t, ":lang", self.lang(t), ":validated") for t in flows]
        lines += [fact(e["etype"], e["source"], e["target"]) for e in (*refs, *(e for e in out_ if e["etype"] == "calls"))]
        for u in users:
            kinds = " ".join(k for k, group in (("imports", importers), ("refs", others)) if u in group)
            lines.append(fact("analyze-dependent", m, u, lang=self.lang(u), via=kinds, file=quoted(self.file(u))))
        lines += self._walk(m, "2", False)[1:] + self._walk(m, "1", True)[1:]
        own = self.graph.entities.filter((F.col("module") == m) & F.col("kind").isin("cls", "mod", "ifc", "typ") & ~F.col("name").startswith("_")).select("name", "kind", "line")
        mentions = self.graph.ends.filter(F.col("src_mod") != m).select(F.explode(F.array("src_ent", "dst_ent")).alias("name"), "src_mod")
        keyed = own.join(mentions, "name").groupBy("line", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("src_mod")).alias("mods"))
        for r in keyed.orderBy("line", "name").collect():
            self.know(r["mods"])
            lines.append(fact("key-entity", m, r["name"], lang=self.lang(m), kind=r["kind"], line=r["line"], refs=r["n"], modules=len(r["mods"])))
            lines += [fact("key-entity-ref", r["name"], x, lang=self.lang(x)) for x in r["mods"]]
        files = list(dict.fromkeys(self.file(x) for x in (m, *imports, *users)))
        lines += [fact("boundary-file", m, quoted(f)) for f in files]
        lines += [fact("layer", m, r["module"].split("/")[-1], layer=r["layer"]) for r in policy.import_layers(self.graph, m).orderBy("module").collect()]
        n = self.graph.entities.filter(F.col("module") == m).count()
        return [*lines, fact("analyze-summary", m, entities=n, imports=len(imports), dataflows=len(flows), refs=len(refs), dependents=len(users), boundary_files=len(files))]

    def quick(self, keyword: str) -> list[str]:
        found = self.ids(keyword)
        if not found and self.facts is not None:
            found = [r["module"] for r in lookup.quick(self.graph, self.facts, keyword).collect()]
        return self.analyze(found[0]) if found else self.no_match(keyword)

    def search(self, pattern: str) -> list[str]:
        found = [r["module"] for r in lookup.search(self.graph.modules, pattern).orderBy("module").collect()]
        self.know(found)
        if found:
            return [*(fact("search-result", m, lang=self.lang(m), file=quoted(self.file(m))) for m in found), fact("search-count", len(found))]
        if self.facts is not None:
            from ..functions.pattern import matches

            return [r["fact"] for r in self.facts.filter(matches(F.col("fact"), pattern)).orderBy("line_no").select("fact").collect()] or self.no_match(pattern)
        return self.no_match(pattern)

    def boundaries(self, scope: str = "all") -> list[str]:
        rows = policy.violations(self.graph)
        checked = self.graph.modules.select("module")
        if scope != "all":
            ids = self.ids(scope)
            if not ids:
                return self.no_match(scope)
            rows, checked = rows.filter(F.col("source").isin(ids)), checked.filter(F.col("module").isin(ids))
        found = rows.orderBy("source", "target", "src_layer", "dst_layer", "etype").collect()
        self.know(r["target"] for r in found)
        n = checked.count()
        lines = [fact("violation", r["source"], r["target"], ":src-layer", r["src_layer"], ":tgt-layer", r["dst_layer"], ":via", r["etype"], ":lang", self.lang(r["target"]), quoted(r["reason"])) for r in found]
        return [*lines, fact("boundaries-summary", violations=len(found), checked=n)] if found else [fact("boundaries-ok", checked=n)]

    def layers(self) -> list[str]:
        rows = policy.layered(self.graph.modules).select("layer", "module", "lang").orderBy("layer", "module").collect()
        lines = []
        for layer in dict.fromkeys(r["layer"] for r in rows):
            group = [r for r in rows if r["layer"] == layer]
            lines += [fact("layer-group", layer, count=len(group)), *(fact("layer-member", layer, r["module"], lang=policy.OLD_CODES.get(r["lang"], r["lang"])) for r in group)]
        return lines

    def invariants(self, scope: str = "all") -> list[str]:
        modules = self.graph.modules
        if scope != "all":
            ids = self.ids(scope)
            if not ids:
                return self.no_match(scope)
            modules = modules.filter(F.col("module").isin(ids))
        bad = policy.naming_violations(modules).orderBy("module").collect()
        checked = modules.filter("naming is not null and naming <> ''").count()
        lines = [fact("invariant-violation", r["module"], expected=quoted(r["expected"]), actual=r["actual"], lang=r["lang"], pkg=quoted(r["pkg"]) if r["pkg"] else None) for r in bad]
        return [*lines, fact("invariants-summary", violations=len(bad), checked=checked)] if bad else [fact("invariants-ok", checked=checked)]

    def find_function(self, name: str) -> list[str]:
        rows = lookup.find_function(self.graph, name).orderBy("id").collect()
        self.know(r["id"].split("::")[0] for r in rows)
        of = lambda r: r["id"].split("::")[0]
        return [fact("fn-def", r["id"], line=r["line"], lang=self.lang(of(r)), file=quoted(self.file(of(r))), kind=r["kind"]) for r in sorted(rows, key=lambda r: (of(r), r["line"], r["id"]))] or self.no_match(name)

    def find_type(self, name: str) -> list[str]:
        rows = lookup.find_type(self.graph, name).orderBy("module", "line", "name").collect()
        self.know(r["module"] for r in rows)
        return [fact("type-def", r["kind"], f"{r['module']}::{r['name']}", line=r["line"], lang=self.lang(r["module"]), file=quoted(self.file(r["module"]))) for r in rows] or self.no_match(name)

    def _called(self, name: str, depth: str, reverse: bool) -> list[str]:
        targets = lookup.resolve_function(self.graph, name).orderBy("id").collect()
        if not targets:
            return self.no_match(name)
        tag, one = ("callers-target", "caller") if reverse else ("calls-source", "calls-target")
        self.know(t["module"] for t in targets)
        lines = [fact(tag, t["id"], line=t["line"], lang=self.lang(t["module"]), file=quoted(self.file(t["module"]))) for t in targets]
        calls = (lookup.find_callers if reverse else lookup.find_calls)(self.graph, name).orderBy("source", "target").collect()
        shown = "source" if reverse else "target"
        self.know(c[shown].split("::")[0] for c in calls)
        lines += [fact(one, c["source"], "->", c["target"], lang=self.lang(c[shown].split("::")[0]), file=quoted(self.file(c[shown].split("::")[0]))) for c in calls]
        if not calls:
            lines.append("; no calls edges found, showing module-level edges")
        roots = self.graph.modules.select("module").filter(F.col("module").isin(sorted({t["module"] for t in targets})))
        rows = G.walk(self.graph, roots, depth_of(depth), reverse).orderBy("root", "step").collect()
        self.know(r["module"] for r in rows)
        tag = "caller-module" if reverse else "calls-module"
        pair = lambda r: (r["module"], "->", r["root"]) if reverse else (r["root"], "->", r["module"])
        return lines + [fact(tag, *pair(r), via=r["via"], depth=r["depth"], lang=self.lang(r["module"]), file=quoted(self.file(r["module"])), cycle=r["cycle"]) for r in rows]

    def find_callers(self, name: str, depth: str = "2") -> list[str]:
        return self._called(name, depth, True)

    def find_calls(self, name: str, depth: str = "2") -> list[str]:
        return self._called(name, depth, False)

    def find_callchain(self, source: str, target: str, depth: str = "5") -> list[str]:
        a, b = lookup.resolve_function(self.graph, source), lookup.resolve_function(self.graph, target)
        for name, side, got in ((source, "source", a), (target, "target", b)):
            if not got.take(1):
                return [fact("error", f"no-match-{side}", quoted(name))]
        node = lambda df: df.select(F.col("id").alias("node"))
        calls = self.graph.edges.filter("etype = 'calls'").select("source", "target")
        names = node(b).select(F.substring_index("node", "::", -1).alias("_n")).distinct()
        named = calls.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(names, F.substring_index("node", "::", -1) == F.col("_n"), "left_semi")
        found = G.call_chain(calls, node(a), node(b).union(named), depth_of(depth)).collect()
        tag = "callchain"
        if not found:  # any path between the modules, in either direction of the edges
            near = self.graph.neighbors
            both = near.select(F.col("src_mod").alias("source"), F.col("dst_mod").alias("target")).union(near.select("dst_mod", "src_mod"))
            module = lambda df: df.select(F.col("module").alias("node"))
            found, tag = G.call_chain(both, module(a), module(b), depth_of(depth)).collect(), "callchain-module"
        if not found:
            return [fact("callchain-none", quoted(source), "->", quoted(target), max_depth=depth)]
        path = found[0]["path"]
        self.know(p.split("::")[0] for p in path)
        lines = [fact(f"{tag}-step", i, p, lang=self.lang(p.split("::")[0]), file=quoted(self.file(p.split("::")[0]))) for i, p in enumerate(path)]
        return [*lines, fact(f"{tag}-summary", length=len(path), hops=len(path) - 1)]

    def _located(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        rows = self.graph.entities if kinds is None else self.graph.entities.filter(F.col("kind").isin(*kinds))
        return rows.join(self.graph.modules.select("module", "path"), "module").select("path", F.concat_ws("::", "module", "name").alias("name"), "line")

    def grep_functions(self, pattern: str) -> list[str]:
        to_like(pattern)
        if self.sources is None:
            raise QueryError("no-sources", "source texts are needed")
        rows = ranges.grep(self.sources, self._located(("fn",)), pattern).orderBy("path", "line_no").collect()
        return [fact("grep-match", r["name"], line=r["line_no"], file=quoted(r["path"]), text=quoted(r["line"].strip())) for r in rows] or [fact("grep-none", quoted(pattern))]

    def diff_functions(self, ref: str = "HEAD") -> list[str]:
        if self.diff is None:
            raise QueryError("no-diff", "a source of diffs is needed")
        changed = ranges.hunks(self.diff(ref))
        files = sorted({r["path"] for r in changed.select("path").distinct().collect()})
        if not files:
            return [fact("diff-functions-empty", quoted(ref))]
        rows = ranges.changed_entities(changed, self._located()).orderBy("path", "line", "name").collect()
        if not rows:
            return [*(fact("diff-file", quoted(f)) for f in files), fact("diff-functions-no-match", files=len(files), ref=quoted(ref))]
        return [*(fact("diff-fn", r["name"], line=r["line"], file=quoted(r["path"])) for r in rows), fact("diff-functions-summary", changed=len(rows), files=len(files), ref=quoted(ref))]

    def query(self, *words: str) -> list[str]:
        got = sexpr.query(self.graph, " ".join(words), self.diff)
        values = sorted(str(r[0]) for r in got.collect())
        if got.columns == ["module"]:
            self.know(values)
            return [*(fact("result", v, lang=self.lang(v)) for v in values), fact("result-count", len(values))]
        return [fact("result", quoted(v) if got.columns == ["path"] else v) for v in values]

COMMANDS = ("module", "deps", "rdeps", "entity", "flow", "boundary", "analyze", "quick", "search", "boundaries", "layers", "invariants", "find_function", "find_type", "find_callers", "find_calls", "find_callchain", "grep_functions", "diff_functions", "query")

def run(report: Report, command: str, *args: str) -> list[str]:
    """Lines of a command; QueryError for bad arguments."""
    if command not in COMMANDS:
        raise QueryError("unknown-command", command)
    try:
        return getattr(report, command)(*args)
    except TypeError as wrong:
        raise QueryError("invalid-argument", f"{command}: {wrong}") from None

