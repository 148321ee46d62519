"""Layer, naming and small string classifiers as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layer of the first row with a fragment in the lower-cased id.
PATH_LAYERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("test", ("/tests/", "/test_", ".test.", ".spec.", "/e2e/")),
    ("config", ("/config/", "/env/")),
    ("config", (".module&/modules/",)),
    ("shared", ("/interface/", "/interfaces/")),
    ("api", ("/api/", "/routes/", "/controllers/")),
    ("service", ("/services/", "/application/")),
    ("domain", ("/domain/", "/entities/", "/schema", "_schema")),
    ("infra", ("/repositories/", "/db/", "/infra/", "/infrastructure/", "rabbitmq", "s3")),
    ("shared", ("/commons/", "/common/", "/utils/", "/result", "/types/")),
    ("ui", ("/components/", "/pages/", "/ui/", "/hooks/")),
    ("domain", ("/dto/", "/dtos/")),
    ("api", ("/guards/", "/guard.")),
    ("api", ("/middleware/", "/middlewares/", "/interceptors/", "/pipes/")),
    ("infra", ("/adapters/", "/adapter.")),
    ("infra", ("/gateways/", "/gateway.")),
    ("infra", ("/migrations/", "/seeds/", "/seeders/")),
    ("domain", ("/models/", "/schemas/", "/events/", "/commands/", "/queries/")),
    ("service", ("/handlers/",)),
    ("shared", ("/lib/", "/helpers/", "/constants/", "/decorators/", "/mappers/")),
    ("ui", ("/stores/&/web/", "/store/&/web/", "/contexts/&/web/", "/providers/&/web/")),
    ("test", ("/fixtures/", "/mocks/", "/__mocks__/", "/factories/")),
    ("config", ("/scripts/", "/tools/", "/cli/")),
)

# Layer of a purpose.
PURPOSE_LAYERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("domain", ("domain logic", "domain entity", "data model", "data transfer object", "schema", "enum definitions", "policy", "value object", "aggregate root", "domain event", "Specification pattern")),
    ("infra", ("infrastructure adapter", "database migration", "database seed", "repository", "adapter", "gateway", "client", "connector", "scheduler", "worker", "Unit of Work", "Identity Map", "Proxy pattern", "SDK", "API client")),
    ("api", ("API layer", "API controller", "router", "access guard", "middleware", "interceptor", "validation pipe", "resolver")),
    ("service", ("service", "application service", "mailer", "event handler", "handler", "event listener", "processor", "provider", "registry", "agent", "manager", "subscriber", "dispatcher", "emitter", "Facade pattern", "Mediator pattern", "Observer pattern", "Command pattern", "Chain of Responsibility", "Memento pattern")),
    ("config", ("NestJS wiring module", "NestJS injectable", "configuration", "application bootstrap", "module entry point")),
    ("ui", ("UI component", "page/route", "React hook")),
    ("other", ("state store",)),
    ("test", ("test", "test fixture", "test mock")),
    ("shared", ("shared utilities", "utility helpers", "constants", "type definitions", "interface definitions", "decorator", "data mapper", "barrel re-exports", "plugin", "Factory pattern", "Builder pattern", "Strategy pattern", "Singleton pattern", "Composite pattern", "Visitor pattern", "Iterator pattern", "Decorator pattern")),
)

# Source layer, target layer, reason.
DENY_RULES = (
    ("domain", "infra", "domain imports infrastructure directly"),
    ("domain", "api", "domain imports API layer"),
    ("domain", "ui", "domain imports UI layer"),
    ("ui", "infra", "UI imports infrastructure directly"),
    ("service", "api", "service imports API layer (inversion)"),
    ("infra", "api", "infrastructure imports API layer"),
)

# Naming conventions allowed for a language.
NAMING_RULES = {
    "py": ("snake_case", "mixed", "kebab-case"),
    "rb": ("snake_case", "mixed"),
    "tsx": ("PascalCase", "camelCase", "kebab-case", "mixed"),
    "ts": ("camelCase", "PascalCase", "kebab-case", "mixed", "snake_case"),
}

#: (keyword, layer) in rank order.
PURPOSE_KEYS = tuple((key, layer) for layer, keys in PURPOSE_LAYERS for key in keys)


def _holds(value: Column, fragment: str) -> Column:
    parts = [value.contains(p) for p in fragment.split("&")]
    return reduce(lambda a, b: a & b, parts)


def layer_by_path(module: Column) -> Column:
    low = F.lower(module)
    chain = F
    for layer, fragments in PATH_LAYERS:
        chain = chain.when(reduce(or_, [_holds(low, f) for f in fragments]), F.lit(layer))
    return chain.otherwise(F.lit("other"))


def layer_by_path_sql(module: str) -> str:
    """The same ladder as SQL."""
    rungs = []
    for layer, fragments in PATH_LAYERS:
        tests = [" AND ".join(f"position('{p}' in lower({module}))>0" for p in f.split("&")) for f in fragments]
        rungs.append(f"WHEN {' OR '.join('(' + t + ')' for t in tests)} THEN '{layer}'")
    return f"CASE {' '.join(rungs)} ELSE 'other' END"


def layer_by_purpose(purpose: Column) -> Column:
    """Exact keyword, else first contained keyword, else the nearest word.

    Words of four letters and more are compared: up to two edits for keywords of
    five letters, one for four. The smallest distance wins, then the rank.
    """
    low = F.lower(F.coalesce(purpose, F.lit("")))
    chain = F.when((low == "") | (low == "general module"), F.lit("other"))
    for key, layer in PURPOSE_KEYS:
        chain = chain.when(low == key.lower(), F.lit(layer))
    for key, layer in PURPOSE_KEYS:
        chain = chain.when(low.contains(key.lower()), F.lit(layer))
    return chain.otherwise(F.coalesce(_nearest(low), F.lit("other")))


def _keyword_words() -> list[tuple[str, int, int, str]]:
    """(word, edits allowed, rank, layer) of keywords' words of four letters and more."""
    best: dict[str, tuple[int, str]] = {}
    for rank, (key, layer) in enumerate(PURPOSE_KEYS):
        for word in key.lower().split():
            if len(word) >= 4:
                best.setdefault(word, (rank, layer))
    return [(w, 2 if len(w) >= 5 else 1, r, layer) for w, (r, layer) in best.items()]


def _nearest(low: Column) -> Column:
    words = F.filter(F.split(low, r"[\s;,/]+"), lambda w: F.length(w) >= 4)
    keys = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(r).alias("r"), F.lit(layer).alias("l")) for w, t, r, layer in _keyword_words()])

    def closest(w: Column) -> Column:
        scored = F.transform(keys, lambda k: F.struct(F.levenshtein(w, k["w"]).alias("d"), k["r"].alias("r"), k["l"].alias("l"), k["t"].alias("t")))
        return F.array_min(F.filter(scored, lambda s: s["d"] <= s["t"]))

    return F.array_min(F.filter(F.transform(words, closest), lambda x: x.isNotNull()))["l"]


def layer(module: Column, purpose: Column) -> Column:
    """By path; by purpose where the path says nothing."""
    by_path = layer_by_path(module)
    return F.when(by_path != "other", by_path).otherwise(layer_by_purpose(purpose))


def naming(filename: Column) -> Column:
    """Naming convention of a file's stem."""
    stem = F.regexp_replace(F.substring_index(filename, "/", -1), r"(?<=.)\.[^.]*$", "")
    for suffix in ("test", "spec", "e2e", "stories", "d"):
        stem = F.regexp_replace(stem, rf"\.{suffix}$", "")
    return (
        F.when(stem.rlike("^[a-z][a-z0-9_]*$"), "snake_case")
        .when(stem.rlike("^[a-z][a-z0-9-]*$"), "kebab-case")
        .when(stem.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .when(stem.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase")
        .otherwise("mixed")
    )


def short_name(name: Column) -> Column:
    """Text after the last ``#`` or dot."""
    return F.regexp_extract(name, "[^#.]*$", 0)


def entity_uid(module: Column, name: Column) -> Column:
    return F.substring(F.sha1(F.concat(module, F.lit("::"), name)), 1, 8)


def column_of(name: Column, line: Column) -> Column:
    """Place of a name on its line, from 0; 0 if it is not there."""
    return F.greatest(F.instr(line, name) - 1, F.lit(0))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"))


def camelize(path: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """snake/path to CamelCase with ``::``, keeping acronyms."""
    known = {a.lower(): a for a in acronyms}

    def word(w: Column) -> Column:
        chain = F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
        for low, shown in known.items():
            chain = F.when(F.lower(w) == low, F.lit(shown)).otherwise(chain)
        return chain

    part = lambda p: F.array_join(F.transform(F.split(p, "_"), word), "")
    return F.array_join(F.transform(F.split(path, "/"), part), "::")


def singularize(name: Column) -> Column:
    size = F.length(name)
    return (
        F.when(name.endswith("ies"), F.concat(name.substr(F.lit(1), size - 3), F.lit("y")))
        .when(name.endswith("sses"), name.substr(F.lit(1), size - 2))
        .when(name.endswith("s") & ~name.endswith("ss"), name.substr(F.lit(1), size - 1))
        .otherwise(name)
    )


def rule_frame(spark, rows, names: list[str]) -> DataFrame:
    """A constant table, small enough to broadcast by its definition."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], names))
