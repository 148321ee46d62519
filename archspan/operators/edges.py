"""Edge builders: joins over file facts. Ambiguity always gives no edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of classes that call another service end so (fixed values), longest first.
CLIENT_SUFFIXES = ("ClientService", "ClientApi", "External", "Client", "Remote")


def import_edges(resolved: DataFrame, abstract: DataFrame) -> DataFrame:
    """(source, target, relations, via_base) from resolved imports (source, target, relation).

    One edge for each pair of different modules; ``abstract`` has the modules that
    export an abstract type.
    """
    pairs = resolved.filter("target is not null and source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    base = abstract.select(F.col("module").alias("target"), F.lit(True).alias("_b")).distinct()
    return pairs.join(base, "target", "left").select("source", "target", "relations", F.coalesce("_b", F.lit(False)).alias("via_base"))


def unique_providers(candidates: DataFrame) -> DataFrame:
    """(symbol, module) of symbols that exactly one module provides, from (symbol, module)."""
    return candidates.groupBy("symbol").agg(F.countDistinct("module").alias("_n"), F.min("module").alias("module")).filter("_n = 1").select("symbol", "module")


def provider_candidates(abstract: DataFrame, interfaces: DataFrame, exported: DataFrame, bases: DataFrame) -> DataFrame:
    """(symbol, module): abstract exports, interfaces, and exported names that are a base somewhere."""
    used = exported.join(bases.select("symbol").distinct(), "symbol", "left_semi")
    return abstract.select("symbol", "module").unionByName(interfaces.select("symbol", "module")).unionByName(used.select("symbol", "module")).distinct()


def resolve_symbols(wanted: DataFrame, imports: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source, symbol, target) of wanted (source, symbol).

    ``imports`` (source, symbol, ord, target): the first import of the symbol in a
    source decides, even if its target is null; else a unique provider does.
    """
    first = imports.withColumn("_r", F.row_number().over(Window.partitionBy("source", "symbol").orderBy("ord"))).filter("_r = 1").select("source", "symbol", F.col("target").alias("_t"), F.lit(True).alias("_named"))
    only = unique_providers(candidates).withColumnRenamed("module", "_p")
    both = wanted.select("source", "symbol").distinct().join(first, ["source", "symbol"], "left").join(only, "symbol", "left")
    return both.select("source", "symbol", F.when(F.col("_named"), F.col("_t")).otherwise(F.col("_p")).alias("target")).filter("target is not null")


def api_edges(resolved: DataFrame) -> DataFrame:
    """(source, target) of resolved bases, without edges to itself."""
    return resolved.filter("source <> target").select("source", "target").distinct()


def data_flow_edges(imports: DataFrame, validated: DataFrame) -> DataFrame:
    """(source, target) of imports of modules that validate their input."""
    return imports.filter("source <> target").select("source", "target").distinct().join(validated.select(F.col("module").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def target_entities(asked: DataFrame, entities: DataFrame, exported: DataFrame) -> DataFrame:
    """(target, original, local, entity): the entity that an imported name means.

    Tiers: the unique entity of that name (or of the local name for a default import); if none, the
    unique entity whose last ``::`` part it is; if none, an exported name; a default
    import may mean the first export (``ord``). Several in the first tier mean none.
    """
    keys = ["target", "original", "local"]
    names = entities.select(F.col("module").alias("target"), F.col("name"))
    pairs = asked.select(*keys).distinct().join(names, "target")
    exact = (F.col("name") == F.col("original")) | ((F.col("original") == "default") & (F.col("name") == F.col("local")))
    short = F.substring_index("name", "::", -1) == F.col("original")
    tiers = pairs.groupBy(*keys).agg(
        F.count(F.when(exact, 1)).alias("_n1"), F.min(F.when(exact, F.col("name"))).alias("_e1"), F.count(F.when(short, 1)).alias("_n2"), F.min(F.when(short, F.col("name"))).alias("_e2")
    )
    out = exported.select(F.col("module").alias("target"), F.col("name").alias("original"), F.lit(True).alias("_x")).distinct()
    first = exported.groupBy(F.col("module").alias("target")).agg(F.min_by("name", "ord").alias("_first"))
    rows = asked.select(*keys).distinct().join(tiers, keys, "left").join(out, ["target", "original"], "left").join(first, "target", "left")
    entity = F.when(F.col("_n1") == 1, F.col("_e1")).when((F.coalesce("_n1", F.lit(0)) == 0) & (F.col("_n2") == 1), F.col("_e2"))
    entity = F.coalesce(entity, F.when(F.col("_x"), F.col("original")).when(F.col("original") == "default", F.col("_first")))
    return rows.select(*keys, entity.alias("entity")).filter("entity is not null")


def reference_edges(named: DataFrame, local: DataFrame) -> DataFrame:
    """(source, target): references from local entities, or from the module if none mentions the name.

    ``named``: (source, local, target, entity); ``local``: (source, name, mentions array).
    """
    mentions = local.select("source", "name", F.explode("mentions").alias("local")).distinct()
    rows = named.filter("source <> target").join(mentions, ["source", "local"], "left")
    source = F.when(F.col("name").isNull(), F.col("source")).otherwise(F.concat_ws("::", "source", "name"))
    return rows.select(source.alias("source"), F.concat_ws("::", "target", "entity").alias("target")).distinct()


def http_edges(clients: DataFrame, repos: DataFrame) -> DataFrame:
    """(source, target, client): service calls named by client classes (module, repo, name).

    The class name without its suffix, in kebab case, equals, begins with or
    begins another repository's name. Candidates share a prefix, so they are joined on
    every prefix of either side and never with all pairs. The least name wins.
    """
    name = F.col("name")
    stem, hit = F.lit(None).cast("string"), F.lit(False)
    for suffix in CLIENT_SUFFIXES:
        ends = name.endswith(suffix)
        stem = F.when(~hit & ends, F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(stem)
        hit = hit | ends
    asked = clients.withColumn("_stem", stem).filter("_stem is not null and _stem <> ''")
    asked = asked.withColumn("_key", F.lower(F.regexp_replace("_stem", "([a-z0-9])([A-Z])", "$1-$2")))
    names = repos.select(F.col("repo").alias("_repo"), F.lower("repo").alias("_low")).distinct()
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.substring(F.col(c), F.lit(1), n))
    longer = asked.withColumn("_p", F.explode(prefixes("_key"))).join(names, F.col("_p") == F.col("_low"))
    ahead = names.withColumn("_p", F.explode(prefixes("_low")))
    shorter = asked.join(ahead, F.col("_key") == F.col("_p"))
    columns = ["module", "repo", "name", "_repo"]
    both = longer.select(*columns).unionByName(shorter.select(*columns)).filter("_repo <> repo")
    return both.groupBy("module", "name").agg(F.min("_repo").alias("target")).groupBy(F.col("module").alias("source"), "target").agg(F.min("name").alias("client"))


def merge_verified(edges: DataFrame, verified: DataFrame) -> DataFrame:
    """(source, target, etype, lsp): verified edges flag equal ones and are added otherwise."""
    key = ["source", "target", "etype"]
    both = edges.select(*key, F.lit(True).alias("_old")).distinct().join(verified.select(*key, F.lit(True).alias("_new")).distinct(), key, "full")
    return both.select(*key, F.coalesce("_new", F.lit(False)).alias("lsp"))


def closed(prefix: str) -> str:
    """A prefix that does not end with a digit, so that prefix and number are read in one way only."""
    return prefix + "_" if prefix[-1:].isdigit() else prefix


def prefixes(repos: list[str]) -> dict[str, str]:
    """A short prefix for each package, no two alike when closed: initials of two parts, or two letters, and more letters or a number as needed."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    numbers: dict[tuple[str, int], int] = {}  # by first letters and length: the first number that may be free
    for repo in repos:
        parts = repo.replace("-", " ").split()
        base = parts[0][0] + parts[1][0] if len(parts) >= 2 else repo[:2]
        prefix = next((p for p in (base + x for x in ("", *repo[2:])) if closed(p) not in taken), None)
        if prefix is None:
            n = numbers.get((base, len(repo)), max(2, len(repo)))
            while closed(f"{base}{n}") in taken:
                n += 1
            prefix = f"{base}{n}"
            numbers[base, len(repo)] = n + 1
        taken.add(closed(prefix))
        out[repo] = prefix
    return out


def short_ids(modules: DataFrame) -> DataFrame:
    """(module, sid, pkg): the package's prefix and a number in id order.

    Packages get prefixes in the order of their first module. A package is a repository: one short
    name each comes to the driver, and prefixes are dealt there in linear time.
    """
    package = F.when(F.coalesce("pkg", F.lit("")) == "", "unknown").otherwise(F.col("pkg"))
    named = modules.select("module", "pkg", package.alias("_pkg"))
    first = named.groupBy("_pkg").agg(F.min("module").alias("_m")).orderBy("_m").select("_pkg").collect()
    rows = [(repo, closed(prefix)) for repo, prefix in prefixes([r["_pkg"] for r in first]).items()]
    table = modules.sparkSession.createDataFrame(rows, "_pkg string, _prefix string")
    numbered = named.withColumn("_n", F.row_number().over(Window.partitionBy("_pkg").orderBy("module")) - 1)
    return numbered.join(table, "_pkg").select("module", F.concat("_prefix", F.col("_n").cast("string")).alias("sid"), "pkg")


def call_edges(calls: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target, lines) from a language server's calls (source, name, path, target_name, line); unknown files drop out."""
    known = paths.select(F.col("path"), F.col("module").alias("_m"))
    rows = calls.join(known, "path").select(F.concat_ws("::", "source", "name").alias("source"), F.concat_ws("::", "_m", "target_name").alias("target"), "line")
    return rows.groupBy("source", "target").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def merge_symbols(syntax: DataFrame, server: DataFrame) -> DataFrame:
    """Entities (module, name, kind, line, bases, deco, methods) of a language server over those of the parser.

    The server decides kind and line; lists that it lacks, and entities that it
    missed in a module it reported, come from the parser.
    """
    key = ["module", "name"]
    lists = ("bases", "deco", "methods")
    old = syntax.select(*key, *[F.col(c).alias(f"_{c}") for c in ("kind", "line", *lists)])
    both = server.join(old, key, "full")
    filled = [F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", F.array().cast("array<string>"))).alias(c) for c in lists]
    return both.select(*key, F.coalesce("kind", "_kind").alias("kind"), F.coalesce("line", "_line").alias("line"), *filled)
