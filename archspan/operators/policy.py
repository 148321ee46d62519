"""Architecture rules: layers, denied imports, naming conventions, incremental checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from .graph import Graph

#: Codes of older maps (fixed values).
OLD_CODES = {"ty": "ts", "tx": "tsx"}


def layered(modules: DataFrame) -> DataFrame:
    return modules.withColumn("layer", classify.layer(F.col("module"), F.col("purpose")))


def layers(modules: DataFrame) -> DataFrame:
    """(layer, n_modules)."""
    return layered(modules).groupBy("layer").agg(F.count(F.lit(1)).alias("n_modules"))


def violations(graph: Graph) -> DataFrame:
    """(source, target, etype, src_layer, dst_layer, reason): denied imports and data flows, a row per edge."""
    by = layered(graph.modules).select("module", "layer")
    ends = graph.ends.filter(F.col("etype").isin("imports", "data-flow") & (F.col("src_mod") != F.col("dst_mod")))
    # A module that is not in the table still has a layer by its path.
    src = F.coalesce(F.col("s.layer"), classify.layer_by_path(F.col("src_mod")))
    dst = F.coalesce(F.col("d.layer"), classify.layer_by_path(F.col("dst_mod")))
    named = ends.join(by.alias("s"), F.col("src_mod") == F.col("s.module")).join(by.alias("d"), F.col("dst_mod") == F.col("d.module"), "left").select("etype", "src_mod", "dst_mod", src.alias("src_layer"), dst.alias("dst_layer"))
    rules = classify.rule_frame(graph.modules.sparkSession, classify.DENY_RULES, ["src_layer", "dst_layer", "reason"])
    return named.join(rules, ["src_layer", "dst_layer"]).select(F.col("src_mod").alias("source"), F.col("dst_mod").alias("target"), "etype", "src_layer", "dst_layer", "reason")


def purpose_violations(graph: Graph, via_base: DataFrame | None = None) -> DataFrame:
    """(source, target, detail): imports of infrastructure by domain or UI modules, by purpose text.

    ``via_base`` has (source, target) pairs that go through an abstract base and are allowed.
    """
    purpose = graph.modules.select("module", F.lower(F.coalesce("purpose", F.lit(""))).alias("purpose"))
    imports = graph.ends.filter("etype = 'imports'").select("src_mod", "dst_mod").distinct()
    both = imports.join(purpose.alias("s"), F.col("src_mod") == F.col("s.module")).join(purpose.alias("d"), F.col("dst_mod") == F.col("d.module")).filter(F.col("d.purpose").contains("infrastructure"))
    if via_base is not None:
        both = both.join(via_base, (F.col("src_mod") == via_base.source) & (F.col("dst_mod") == via_base.target), "left_anti")
    details = F.array(
        F.when(F.col("s.purpose").contains("domain"), "domain imports infrastructure without abstract base"),
        F.when(F.col("s.purpose").contains("ui component"), "UI imports infrastructure without abstract base"),
    )
    return both.select(F.col("src_mod").alias("source"), F.col("dst_mod").alias("target"), F.explode(F.array_compact(details)).alias("detail"))


def _named(modules: DataFrame) -> DataFrame:
    """Modules with a naming convention, and those that their language allows (null: any)."""
    lang = F.col("lang")
    for old, new in OLD_CODES.items():
        lang = F.when(F.col("lang") == old, new).otherwise(lang)
    chain = F.lit(None).cast("array<string>")
    for code, allowed in classify.NAMING_RULES.items():
        chain = F.when(lang == code, F.array(*map(F.lit, sorted(allowed)))).otherwise(chain)
    return modules.filter("naming is not null and naming <> ''").select("module", lang.alias("lang"), "pkg", F.col("naming").alias("actual"), chain.alias("_allowed"))


def _breaks() -> Column:
    return F.col("_allowed").isNotNull() & ~F.array_contains("_allowed", F.col("actual"))


def naming_violations(modules: DataFrame) -> DataFrame:
    """(module, lang, pkg, actual, expected): names outside the language's conventions."""
    return _named(modules).filter(_breaks()).select("module", "lang", "pkg", "actual", F.array_join("_allowed", " ").alias("expected"))


def naming_summary(modules: DataFrame) -> DataFrame:
    """(violations, checked)."""
    return _named(modules).agg(F.count_if(_breaks()).alias("violations"), F.count(F.lit(1)).alias("checked"))


def id_collisions(modules: DataFrame) -> DataFrame:
    """(module, n_paths): ids that more than one file maps to."""
    return modules.groupBy("module").agg(F.countDistinct("path").alias("n_paths")).filter("n_paths > 1")


def changed(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows (path, content_hash) of ``current`` that the cache lacks."""
    return current.join(cached.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def _at(df: DataFrame, column: str, module: str | DataFrame) -> DataFrame:
    """Rows of one module, given by id or as a DataFrame of one row at most (column module)."""
    if isinstance(module, str):
        return df.filter(F.col(column) == module)
    return df.join(F.broadcast(module.select(F.col("module").alias("_at"))), F.col(column) == F.col("_at"), "left_semi")


def analyze_summary(graph: Graph, module: str | DataFrame) -> DataFrame:
    """(metric, n): counts of edges out by type, modules in by kind, entities and boundary."""
    ends = graph.ends.filter("src_mod <> dst_mod")
    out = _at(ends, "src_mod", module).groupBy(F.concat(F.lit("out:"), "etype").alias("metric")).agg(F.countDistinct("target").alias("n"))
    kind = F.when(F.col("etype") == "imports", "imports").otherwise("refs")
    into = _at(ends, "dst_mod", module).groupBy(F.concat(F.lit("in:"), kind).alias("metric")).agg(F.countDistinct("src_mod").alias("n"))
    own = _at(graph.entities, "module", module).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("metric"), "n")
    return out.unionByName(into).unionByName(own)


def analyze_dependents(graph: Graph, module: str) -> DataFrame:
    """(module, relation): who depends on it, by imports or by anything else."""
    ends = graph.ends.filter((F.col("dst_mod") == module) & (F.col("src_mod") != module))
    return ends.select(F.col("src_mod").alias("module"), F.when(F.col("etype") == "imports", "imports").otherwise("refs").alias("relation")).distinct()


def import_layers(graph: Graph, module: str) -> DataFrame:
    """(target, layer) of the imports of a module."""
    targets = graph.ends.filter((F.col("src_mod") == module) & (F.col("etype") == "imports") & (F.col("dst_mod") != module)).select(F.col("dst_mod").alias("module")).distinct()
    return targets.join(layered(graph.modules).select("module", "layer"), "module", "left")
