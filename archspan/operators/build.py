"""From file facts to the architecture graph: the edge builders composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import QueryError
from ..schema import KIND_TAGS, LANGUAGE_CODES
from ..sources.tree import module_id
from . import edges as E
from . import resolve
from .graph import Graph
from .policy import id_collisions
from .scratch import Scratch

_NONE = "cast(array() as array<string>)"


def modules_of(facts: DataFrame) -> DataFrame:
    chain = F.col("language")
    for name, code in LANGUAGE_CODES.items():
        chain = F.when(F.col("language") == name, code).otherwise(chain)
    return facts.select(module_id(F.col("path"), F.col("language")).alias("module"), "path", chain.alias("lang"), F.col("repo").alias("pkg"), "purpose", "naming")


def entities_of(facts: DataFrame) -> DataFrame:
    rows = facts.select(module_id(F.col("path"), F.col("language")).alias("module"), F.inline("entities"))
    tag = F.substring("kind", 1, 3)
    for kind, short in KIND_TAGS.items():
        tag = F.when(F.col("kind") == kind, short).otherwise(tag)
    return rows.select("module", "name", tag.alias("kind"), "line", "bases", F.col("decorators").alias("deco"), "methods")


def check_ids(modules: DataFrame) -> None:
    """Two files with one id fail the build, and every one of them is named."""
    bad = id_collisions(modules).select("module")
    rows = modules.join(bad, "module", "left_semi").select("module", "path").orderBy("module", "path").limit(100).collect()
    if rows:
        raise QueryError("id-collision", ", ".join(f"{r['module']}: {r['path']}" for r in rows))


def build(facts: DataFrame, cfg: resolve.Configs) -> Graph:
    """Graph of all edges that the facts imply: imports, calls of interfaces, data flows, references, HTTP calls."""
    # Facts and resolved imports feed many joins: written once, they are extracted once.
    scratch = Scratch(facts.sparkSession)
    facts = scratch.write(facts, "facts").withColumn("module", module_id(F.col("path"), F.col("language")))
    modules, entities = modules_of(facts), entities_of(facts)
    check_ids(modules)
    found = scratch.write(resolve.resolved(facts, cfg), "resolved")
    plain = facts.select(F.col("module").alias("source"), F.explode("imports").alias("import"))
    submodules = _submodules(facts)
    related = facts.select(F.col("module").alias("source"), F.explode("relations").alias("_r")).select("source", F.col("_r.target").alias("import"), F.col("_r.relation").alias("relation"))
    every = plain.withColumn("relation", F.lit(None).cast("string")).unionByName(related).join(found, ["source", "import"]).select("source", "target", "relation").unionByName(submodules)
    abstract = facts.select("module", F.explode("exports_abstract").alias("symbol"))
    imports = E.import_edges(every, abstract)

    interfaces = entities.filter("kind = 'ifc'").select("module", F.col("name").alias("symbol"))
    exported = facts.select("module", F.explode("exported_names").alias("symbol"))
    bases = facts.select(F.col("module").alias("source"), F.explode(F.concat("implements", "extends", F.flatten(F.transform("entities", lambda e: e["bases"])))).alias("symbol")).distinct()
    offered = E.provider_candidates(abstract, interfaces, exported, bases)
    named = facts.select(F.col("module").alias("source"), F.posexplode("imported_names").alias("ord", "_n")).select("source", "ord", F.col("_n.local").alias("local"), F.col("_n.original").alias("original"), F.col("_n.module").alias("import"))
    one = found.groupBy("source", "import").agg(F.min("target").alias("target"))
    aimed = named.join(one, ["source", "import"], "left")
    api = E.api_edges(E.resolve_symbols(bases, aimed.select("source", F.col("local").alias("symbol"), "ord", "target"), offered))
    flows = E.data_flow_edges(plain.join(found, ["source", "import"]).select("source", "target"), facts.filter("has_validation").select("module"))

    names = facts.select("module", F.posexplode("exported_names").alias("ord", "name"))
    hits = E.target_entities(aimed.filter("target is not null and target <> source").select("target", "original", "local"), entities.select("module", "name"), names)
    refs = aimed.filter("target is not null").join(hits, ["target", "original", "local"]).select("source", "local", "target", "entity")
    local = entities.select(F.col("module").alias("source"), "name", F.concat("bases", "deco").alias("mentions"))
    references = E.reference_edges(refs, local)
    callbacks = _callbacks(facts, entities)
    http = E.http_edges(entities.select("module", "name").join(modules.select("module", F.col("pkg").alias("repo")), "module"), modules.select(F.col("pkg").alias("repo")).distinct())

    none = F.expr(_NONE)
    via = F.array_sort(F.concat(F.when(F.col("via_base"), F.array(F.lit("via-base"))).otherwise(none), F.coalesce("relations", none)))
    edge = lambda df, kind, flags: df.select(F.lit(kind).alias("etype"), "source", "target", flags.alias("flags"))
    parts = [edge(imports, "imports", via), edge(api, "calls-api", F.array(F.lit("via-ifc"))), edge(flows, "data-flow", F.array(F.lit("validated"))), edge(references, "refs", none), edge(callbacks, "refs", F.array(F.lit("callback"))), edge(http, "http-calls", none)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return Graph(modules, entities, scratch.write(out.dropDuplicates(["etype", "source", "target"]), "edges"))


def _submodules(facts: DataFrame) -> DataFrame:
    """Python names imported from a package that are modules of it, as imports of their own."""
    asked = facts.filter("language = 'python'").select(F.col("module").alias("source"), "path", F.explode("imported_names").alias("_n")).select("source", "path", F.col("_n.module").alias("m"), F.col("_n.original").alias("o")).filter("m <> '' and o <> m and o <> '*'")
    extended = asked.select("source", "path", F.when(F.col("m").rlike(r"^\.+$"), F.concat("m", "o")).otherwise(F.concat_ws(".", "m", "o")).alias("import")).distinct()
    shape = extended.groupBy("source", "path").agg(F.collect_set("import").alias("imports"))
    empty = F.expr(_NONE)
    rows = shape.join(facts.select("path", "language", "declared", "paths", "relations", "imported_names", "exported_names", "extends"), "path").select("path", "language", "declared", "paths", "imports", F.slice("relations", F.lit(1), F.lit(0)).alias("relations"), F.slice("imported_names", F.lit(1), F.lit(0)).alias("imported_names"), empty.alias("exported_names"), empty.alias("extends"))
    offer = facts.select("path", "language", "declared", "exported_names")
    hits = resolve.resolved(rows, resolve.Configs([]), offer)
    # Only a plain file counts as the submodule, not a package's __init__.
    return hits.filter(~F.col("target").endswith("/__init__")).select("source", "target", F.lit(None).cast("string").alias("relation"))


def _callbacks(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """References inside a module from a class to the method that a relation names."""
    rows = facts.select("module", F.explode("relations").alias("_r")).select("module", F.col("_r.source_entity").alias("a"), F.col("_r.target_entity").alias("b")).filter("a is not null and b is not null")
    known = entities.select("module", "name").distinct()
    both = rows.join(known.withColumnRenamed("name", "a"), ["module", "a"], "left_semi").join(known.withColumnRenamed("name", "b"), ["module", "b"], "left_semi")
    return both.select(F.concat_ws("::", "module", "a").alias("source"), F.concat_ws("::", "module", "b").alias("target")).distinct()
