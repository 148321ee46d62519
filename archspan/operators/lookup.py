"""Lookups of modules, entities, functions and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import short_name
from ..functions.pattern import matches
from .graph import Graph

#: Matches listed of the substring tiers (fixed value).
SUBSTRING_CAP = 10
#: Suggestions for an id without a match (fixed value).
SUGGESTIONS = 5
#: Kinds that count as types (fixed values).
TYPE_KINDS = ("cls", "mod", "ifc", "typ", "enm")


def resolve(modules: DataFrame, pattern: str) -> DataFrame:
    """(module, tier) of the best tier: exact, suffix, substring, or substring in any case.

    The two substring tiers list the first ten ids only.
    """
    name = F.col("module")
    tier = F.when(name == pattern, 1).when(name.endswith(pattern), 2).when(name.contains(pattern), 3).when(F.lower(name).contains(pattern.lower()), 4)
    found = modules.select("module", tier.alias("tier")).filter("tier is not null")
    # The best tier of each partition first, so that the one-row minimum stays small.
    best = found.agg(F.min("tier").alias("best"))
    listed = found.join(F.broadcast(best), F.col("tier") == F.col("best")).select("module", "tier")
    exact = listed.filter("tier <= 2")
    capped = listed.filter("tier > 2").orderBy("module").limit(SUBSTRING_CAP)
    return exact.unionByName(capped)


def search(modules: DataFrame, pattern: str) -> DataFrame:
    """Modules whose id or last path segment fits the pattern."""
    return modules.select("module").filter(matches(F.col("module"), pattern) | matches(F.substring_index("module", "/", -1), pattern))


def suggest(modules: DataFrame, pattern: str) -> DataFrame:
    """(module, score): ids that hold most parts of the pattern."""
    parts = sorted({p for p in pattern.lower().replace(".", "/").replace("_", "/").replace("-", "/").split("/") if p})
    every = [p for p in pattern.lower().replace(".", "/").replace("_", "/").replace("-", "/").split("/") if p]
    if not parts:
        return modules.select("module", F.lit(0).alias("score")).limit(0)
    score = sum((F.lower("module").contains(p).cast("int") for p in every), F.lit(0))
    return modules.select("module", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "module").limit(SUGGESTIONS)


def module_view(graph: Graph, module: str) -> DataFrame:
    """(section, name, detail): the module, its entities, and its edges out and in."""
    own = graph.modules.filter(F.col("module") == module).select(F.lit("node").alias("section"), F.col("module").alias("name"), F.col("lang").alias("detail"))
    entities = graph.entities.filter(F.col("module") == module).select(F.lit("entity"), "name", F.concat_ws(" ", "kind", F.col("line").cast("string")))
    out = graph.ends.filter(F.col("src_mod") == module).select(F.lit("out"), "target", "etype")
    into = graph.ends.filter((F.col("dst_mod") == module) & (F.col("src_mod") != module)).select(F.lit("in"), "source", "etype")
    return own.union(entities).union(out).union(into)


def _named(graph: Graph, name: str) -> DataFrame:
    """Entities of that very name, or those that fit it as a pattern if there are none."""
    exact = graph.entities.filter(F.col("name") == name)
    fits = graph.entities.filter(matches(F.col("name"), name))
    return exact.unionByName(fits.filter(exact.agg(F.count(F.lit(1))).scalar() == 0))


def entity_definitions(graph: Graph, name: str) -> DataFrame:
    return _named(graph, name).select("module", "name", "kind", "line")


def entity_references(graph: Graph, name: str) -> DataFrame:
    """Edges that touch a name of the definitions, on either end, once each."""
    names = _named(graph, name).select(F.col("name").alias("_n")).distinct()
    # Two equi-joins, whatever the number of names: edges whose source end fits, and of the others those whose target end does.
    one, two = F.col("src_ent") == F.col("_n"), F.col("dst_ent") == F.col("_n")
    by_source = graph.ends.join(names, one, "left_semi")
    by_target = graph.ends.join(names, one, "left_anti").join(names, two, "left_semi")
    return by_source.unionByName(by_target).select("etype", "source", "target")


def refs_to(graph: Graph, name: str) -> DataFrame:
    """Source modules of edges that have the name on either end."""
    return graph.ends.filter((F.col("src_ent") == name) | (F.col("dst_ent") == name)).select(F.col("src_mod").alias("module")).distinct()


def key_entities(graph: Graph) -> DataFrame:
    """(name, n_refs, n_modules): mentions of bare names, both ends counted."""
    ends = graph.ends
    mentions = ends.select(F.col("src_ent").alias("name"), "src_mod").union(ends.select("dst_ent", "src_mod")).filter("name is not null")
    return mentions.groupBy("name").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("src_mod").alias("n_modules"))


def _methods(graph: Graph) -> DataFrame:
    """Methods listed by classes and modules that no function of the module defines."""
    precise = graph.entities.filter("kind = 'fn'").select("module", short_name(F.col("name")).alias("method")).distinct()
    listed = graph.entities.filter("kind in ('cls', 'mod')").select("module", "name", "line", F.explode("methods").alias("method"))
    return listed.join(precise, ["module", "method"], "left_anti")


def find_function(graph: Graph, name: str) -> DataFrame:
    """(id, line, kind): functions by full or short name, and methods that only a class lists."""
    short = short_name(F.col("name"))
    hit = (F.col("name") == name) | (short == name) | matches(F.col("name"), name) | matches(short, name)
    functions = graph.entities.filter("kind = 'fn'").filter(hit).select(F.concat_ws("::", "module", "name").alias("id"), "line", F.when(short != F.col("name"), "method").otherwise("function").alias("kind"))
    methods = _methods(graph).filter((F.col("method") == name) | matches(F.col("method"), name)).select(F.concat("module", F.lit("::"), "name", F.lit("."), "method").alias("id"), "line", F.lit("method").alias("kind"))
    first = functions.unionByName(methods).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("line", "kind")))
    return first.filter("_r = 1").drop("_r")


def find_type(graph: Graph, name: str) -> DataFrame:
    """(module, name, kind, line) of types by name."""
    return graph.entities.filter(F.col("kind").isin(*TYPE_KINDS)).filter((F.col("name") == name) | matches(F.col("name"), name)).select("module", "name", "kind", "line")


def resolve_function(graph: Graph, name: str) -> DataFrame:
    """(id, module, line) of functions and methods whose name holds ``name`` in any case."""
    low = name.lower()
    functions = graph.entities.filter("kind = 'fn'").filter(F.lower("name").contains(low)).select(F.concat_ws("::", "module", "name").alias("id"), "module", "line")
    methods = _methods(graph).filter(F.lower("method").contains(low)).select(F.concat_ws("::", "module", "method").alias("id"), "module", "line")
    return functions.unionByName(methods).distinct()


def _last(entity: str) -> Column:
    return F.when(F.col(entity).contains("::"), F.substring_index(entity, "::", -1)).otherwise("")


def find_callers(graph: Graph, name: str) -> DataFrame:
    """(source, target): calls of a resolved function, by id or by bare name."""
    ids = resolve_function(graph, name).select(F.col("id").alias("target"), F.lit(True).alias("_hit")).distinct()
    calls = graph.edges.filter("etype = 'calls'").select("source", "target").distinct()
    return calls.join(ids, "target", "left").filter(F.col("_hit") | (_last("target") == name)).select("source", "target")


def find_calls(graph: Graph, name: str) -> DataFrame:
    """(source, target): calls made by a resolved function."""
    ids = resolve_function(graph, name).select(F.col("id").alias("source"), F.lit(True).alias("_hit")).distinct()
    calls = graph.edges.filter("etype = 'calls'").select("source", "target").distinct()
    return calls.join(ids, "source", "left").filter(F.col("_hit") | (_last("source") == name)).select("source", "target")


def quick(graph: Graph, facts: DataFrame, keyword: str) -> DataFrame:
    """First module for a keyword: by id, else by the first fact line (line_no, module, fact) that holds it."""
    by_id = resolve(graph.modules, keyword).select("module", F.lit(0).cast("long").alias("_r"))
    by_fact = facts.filter(F.lower("fact").contains(keyword.lower())).join(graph.modules.select("module"), "module", "left_semi").select("module", (F.col("line_no") + 1).alias("_r"))
    return by_id.unionByName(by_fact).orderBy("_r", "module").limit(1).select("module")


