"""Import resolution: ordered candidate keys, one join with the files, lowest rank wins.

Every import of a source becomes a short list of keys in order of preference: a
file path, a declared type, a constant, a unit or a directory. Keys are joined
with what the files provide and the first that exists decides. A key with several
owners gives no edge: types are skipped to the next key, constants and units block.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..sources.tree import module_id

#: Endings tried for a TypeScript base, and for a Pascal path without one (fixed values).
TS_ENDINGS = ("", ".ts", ".tsx", "/index.ts", "/index.tsx")
PASCAL_ENDINGS = (".pas", ".pp", ".lpr", ".dpr", ".inc")


class Configs:
    """Package and alias configuration, from the few config files of a tree."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.aliases: list[tuple[str, str, list[str]]] = []
        self.ts_packages: list[tuple[str, str]] = []
        self.crates: list[tuple[str, str]] = []
        self.go_modules: list[tuple[str, str]] = []
        self.acronyms: list[str] = []
        self.ruby_roots: list[str] = ["lib"]
        for path, content in sorted(rows):
            self._read(posixpath.dirname(path), posixpath.basename(path), content)
        self.aliases.sort(key=lambda a: (-a[0].count("/") - bool(a[0]), -len(a[1]), a[1]))
        self.crates.sort(key=lambda c: (-len(c[0]), c[0]))
        self.go_modules.sort(key=lambda m: (-len(m[1]), m[1]))

    def _read(self, folder: str, name: str, content: str) -> None:
        if re.fullmatch(r"tsconfig.*\.json", name):
            plain = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"^\s*//.*$|(?<=[\s,{])//[^\"\n]*$", "", content, flags=re.M))
            try:
                options = json.loads(plain).get("compilerOptions", {})
            except (ValueError, AttributeError):
                return
            base = posixpath.join(folder, options.get("baseUrl", "."))
            for pattern, targets in (options.get("paths") or {}).items():
                self.aliases.append((folder, pattern, [posixpath.normpath(posixpath.join(base, t)) for t in targets]))
        elif name == "package.json":
            try:
                found = json.loads(content).get("name")
            except (ValueError, AttributeError):
                return
            if isinstance(found, str) and found:
                self.ts_packages.append((folder, found))
        elif name == "Cargo.toml":
            import tomllib

            try:
                found = tomllib.loads(content).get("package", {}).get("name")
            except tomllib.TOMLDecodeError:
                return
            if found:
                self.crates.append((folder, found.replace("-", "_")))
        elif name == "go.mod":
            if m := re.search(r"^\s*module\s+(\S+)", content, re.M):
                self.go_modules.append((folder, m[1]))
        elif name == "inflections.rb":
            self.acronyms += re.findall(r"acronym\s*\(?\s*[\"'](\w+)[\"']", content)
        elif name in ("application.rb", "environment.rb"):
            self.ruby_roots += ["/".join(re.findall(r"[\"']([^\"']+)[\"']", m)) for m in re.findall(r"root\.join\(([^)]*)\)", content)]


def _within(path: str, folder: str) -> bool:
    return not folder or path == folder or path.startswith(folder + "/")


def _norm(path: str) -> str:
    return posixpath.normpath(path).lstrip("/") if path not in ("", ".") else ""


def _files(*paths: str) -> list[str]:
    return [f"f:{_norm(p)}" for p in paths]


def _python(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    level = len(name) - len(name.lstrip("."))
    parts = [p for p in name[level:].split(".") if p]
    folder = posixpath.dirname(path)
    join = posixpath.join
    if level:
        for _ in range(level - 1):
            folder = posixpath.dirname(folder)
        base = join(folder, *parts)
        return _files(base + ".py", join(base, "__init__.py"))
    keys = []
    for base in dict.fromkeys(["", folder]):
        keys += _files(join(base, *parts) + ".py", join(base, *parts, "__init__.py"))
    while folder:
        # Above the source a package directory must exist beside a module of that name.
        keys.append(("fd:" if len(parts) == 1 else "f:") + _norm(join(folder, *parts) + ".py"))
        keys += _files(join(folder, *parts, "__init__.py"))
        folder = posixpath.dirname(folder)
    return keys


def _ts_base(base: str) -> list[str]:
    bases = [base]
    for ending in (".jsx", ".mjs", ".cjs", ".js"):
        if base.endswith(ending):
            bases = [base[: -len(ending)], base]
            break
    return _files(*[b + e for b in bases for e in TS_ENDINGS])


def _typescript(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    if name.startswith((".", "/")):
        return _ts_base(posixpath.normpath(posixpath.join(posixpath.dirname(path), name)))
    keys = []
    for folder, pattern, targets in cfg.aliases:
        if not _within(path, folder):
            continue
        head, star, tail = pattern.partition("*")
        if not star:
            rest = "" if name == pattern else None
        else:
            rest = name[len(head) : len(name) - len(tail)] if name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail) else None
        if rest is not None:
            keys += [k for t in targets for k in _ts_base(t.replace("*", rest, 1))]
    owners = [p for p in cfg.ts_packages if _within(path, p[0])]
    if owners:
        folder, own = max(owners, key=lambda p: len(p[0]))
        if name == own:
            keys += _ts_base(posixpath.join(folder, "src", "index")) + _ts_base(posixpath.join(folder, "index"))
    return keys


def _rust_below(folder: str, parts: list[str], fallback: list[str]) -> list[str]:
    keys = []
    for n in range(len(parts), 0, -1):
        base = posixpath.join(folder, *parts[:n])
        keys += _files(base + ".rs", posixpath.join(base, "mod.rs"))
    return keys + _files(*fallback)


def _rust(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    parts = [p for p in name.split("::") if p and p != "*"]
    if not parts:
        return []
    owner = next((c for c in cfg.crates if _within(path, c[0])), None)
    entry = lambda folder: [posixpath.join(folder, "src", f) for f in ("lib.rs", "main.rs")]
    above = path.split("/")[:-1]
    crate = posixpath.join(owner[0], "src") if owner else "/".join(above[: len(above) - above[::-1].index("src")]) if "src" in above else posixpath.dirname(path)
    if parts[0] == "crate":
        return _rust_below(crate, parts[1:], entry(owner[0]) if owner else [path])
    if parts[0] in ("self", "super"):
        stem = posixpath.basename(path)
        here = posixpath.dirname(path) if stem in ("lib.rs", "main.rs", "mod.rs") else path[: -len(".rs")]
        went_up = False
        while parts and parts[0] in ("self", "super"):
            if parts.pop(0) == "super":
                here, went_up = posixpath.dirname(here), True
        fallback = []
        if not parts:
            fallback = [here + ".rs", posixpath.join(here, "mod.rs")] + (entry(owner[0]) if owner and here == crate else []) if went_up else [path]
        return _rust_below(here, parts, fallback)
    package = next((c for c in cfg.crates if c[1] == parts[0]), None)
    return _rust_below(posixpath.join(package[0], "src"), parts[1:], entry(package[0])) if package else []


def _declared_type(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    parts = name.removesuffix(".*").split(".")
    return [f"t:{source['language']}:{'.'.join(parts[:n])}" for n in range(len(parts), 0, -1)]


def _go(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    for folder, module in cfg.go_modules:
        if name == module or name.startswith(module + "/"):
            return [f"d:{_norm(posixpath.join(folder, name[len(module) :].lstrip('/')))}"]
    return []


def _camel(name: str, acronyms: list[str]) -> str:
    known = {a.lower(): a for a in acronyms}
    return "::".join("".join(known.get(w.lower(), w[:1].upper() + w[1:]) for w in part.split("_")) for part in name.split("/"))


def _single(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-2] if name.endswith("sses") else name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def _ruby(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    kind, _, value = name.partition(":")
    if kind == "ruby-require-relative":
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), value))
        return _files(base, base + ".rb")
    if kind == "ruby-require":
        roots = ["", "lib", *source["roots"], *cfg.ruby_roots]
        return [k for r in dict.fromkeys(roots) for k in _files(posixpath.join(r, value), posixpath.join(r, value + ".rb"))]
    if kind == "ruby-local-method":
        return _files(path)
    if kind == "ruby-association-one":
        value = _camel(value, cfg.acronyms)
    elif kind == "ruby-association-many":
        value = _camel(_single(value), cfg.acronyms)
    names = [value] if "::" in value else []
    spaces = []
    for declared in sorted(source["exported"], key=lambda n: -n.count("::")):
        parts = declared.split("::")
        spaces += ["::".join(parts[:n]) for n in range(len(parts), 0, -1)]
    names += [f"{s}::{value}" for s in dict.fromkeys(spaces) if s != value and not value.startswith(s + "::")]
    names += [f"{b}::{value}" for b in source["extends"]]
    return [f"c:{n}" for n in dict.fromkeys([*names, value])]


def expected_constant(path: str, roots: list[str], acronyms: list[str]) -> str:
    """Constant that an autoloaded path stands for; empty outside the roots."""
    inside = [r for r in roots if _within(path, r) and r]
    if not inside or not path.endswith(".rb"):
        return ""
    return _camel(path[len(max(inside, key=len)) + 1 : -3], acronyms)


def autoload_roots(path: str) -> list[str]:
    """Default autoload roots among the directories above a Rails path."""
    parts = path.split("/")[:-1]
    out = []
    for i, part in enumerate(parts):
        if part == "app" and i + 1 < len(parts):
            out.append("/".join(parts[: i + 2]))
            if i + 2 < len(parts) and parts[i + 2] == "concerns":
                out.append("/".join(parts[: i + 3]))
        elif part == "lib":
            out.append("/".join(parts[: i + 1]))
    return out


def _pascal(name: str, path: str, cfg: Configs, source: dict) -> list[str]:
    folder = posixpath.dirname(path)

    def at(target: str) -> list[str]:
        base = posixpath.normpath(posixpath.join(folder, target)).lower()
        return [f"p:{base}"] + ([] if posixpath.splitext(base)[1] else [f"p:{base}{e}" for e in PASCAL_ENDINGS])

    if name.startswith("pascal-include:"):
        return at(name.partition(":")[2])
    if name.startswith("pascal-type:"):
        return []
    explicit = [p["path"] for p in source["paths"] if p["unit"].lower() == name.lower()]
    if explicit:  # a stated path blocks a search by name
        return at(explicit[0]) if len(set(explicit)) == 1 else []
    return [f"u:{folder.lower()}:{name.lower()}", f"u::{name.lower()}"]


CANDIDATES: dict[str, Callable[[str, str, Configs, dict], list[str]]] = {
    "python": _python, "typescript": _typescript, "tsx": _typescript, "rust": _rust, "csharp": _declared_type, "java": _declared_type, "go": _go, "ruby": _ruby, "pascal": _pascal,
}


def configs(files: DataFrame) -> Configs:
    """Configuration of a tree from its config files (path, content); trees have few of them."""
    wanted = F.substring_index("path", "/", -1).rlike(r"^(?:tsconfig.*\.json|package\.json|Cargo\.toml|go\.mod|inflections\.rb|application\.rb|environment\.rb)$")
    return Configs([(r["path"], r["content"]) for r in files.filter(wanted).select("path", "content").collect()])


def provided(facts: DataFrame, cfg: Configs) -> DataFrame:
    """(key, module, owners): what the files offer; module is the least owner."""
    rows = facts.select("path", "language", "declared", "exported_names", module_id(F.col("path"), F.col("language")).alias("module"))
    at = F.regexp_replace("path", r"\.[^./]*$", "")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    by_path = rows.select(F.concat(F.lit("f:"), "path").alias("key"), "module")
    dirs = rows.filter("language = 'python'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("_d"), "path").filter("_d <> path").select("_d").distinct()
    beside = rows.filter("language = 'python'").withColumn("_d", at).join(dirs, "_d", "left_semi").select(F.concat(F.lit("fd:"), "path").alias("key"), "module")
    typed = rows.filter(F.col("language").isin("java", "csharp")).select("module", "language", F.explode("declared").alias("_t")).select(F.concat_ws(":", F.lit("t"), "language", "_t").alias("key"), "module")
    go = rows.filter("language = 'go' and path not like '%!_test.go' escape '!'").select(F.concat(F.lit("d:"), folder).alias("key"), "module")
    pascal = rows.filter("language = 'pascal'")
    unit = F.lower(F.substring_index(at, "/", -1))
    names = F.array_distinct(F.concat(F.array(unit), F.transform("declared", lambda n: F.lower(n))))
    units = pascal.filter("lower(path) not like '%.inc'").select("module", folder.alias("_f"), F.explode(names).alias("_u"))
    units = units.select(F.concat_ws(":", F.lit("u"), F.lower("_f"), "_u").alias("key"), "module").unionByName(units.select(F.concat(F.lit("u::"), "_u").alias("key"), "module"))
    paths = pascal.select(F.concat(F.lit("p:"), F.lower("path")).alias("key"), "module")
    acronyms, extra = cfg.acronyms, cfg.ruby_roots

    @F.pandas_udf(T.StringType())
    def expected(path: pd.Series) -> pd.Series:
        return path.map(lambda p: expected_constant(p, [*autoload_roots(p), *extra], acronyms))

    ruby = rows.filter("language = 'ruby'").withColumn("_e", expected("path"))
    constants = ruby.select("module", F.explode(F.array_distinct(F.concat("exported_names", F.when((F.size("exported_names") == 0) & (F.col("_e") != ""), F.array("_e")).otherwise(F.array().cast("array<string>"))))).alias("_c")).select(F.concat(F.lit("c:"), "_c").alias("key"), "module")
    every = by_path
    for part in (beside, typed, go, units, paths, constants):
        every = every.unionByName(part)
    return every.groupBy("key").agg(F.min("module").alias("module"), F.countDistinct("module").alias("owners"), F.array_sort(F.collect_set("module")).alias("all"))


def resolved(facts: DataFrame, cfg: Configs, files: DataFrame | None = None) -> DataFrame:
    """(source, import, target) of every import and relation target that resolves among ``files`` (default: the facts).

    A Go package gives a row for each of its files; all else gives one row at most.
    """

    ship(facts.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(language: pd.Series, name: pd.Series, path: pd.Series, exported: pd.Series, extends: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for lang, imp, at, exp, ext, stated in zip(language, name, path, exported, extends, paths, strict=True):
            source = {"language": lang, "exported": list(exp), "extends": list(ext), "paths": list(stated if stated is not None else []), "roots": autoload_roots(at)}
            out.append(CANDIDATES[lang](imp, at, cfg, source))
        return pd.Series(out)

    asked = F.array_distinct(F.concat("imports", F.transform("relations", lambda r: r["target"]), F.transform("imported_names", lambda r: r["module"])))
    rows = facts.select("path", "language", "exported_names", "extends", "paths", module_id(F.col("path"), F.col("language")).alias("source"), F.explode(asked).alias("import")).filter("import <> ''")
    ranked = rows.select("source", "import", F.posexplode(keys("language", "import", "path", "exported_names", "extends", "paths")).alias("rank", "key"))
    offer = provided(facts if files is None else files, cfg).filter(~(F.col("key").startswith("t:") & (F.col("owners") > 1)))
    # Two units of one name in the source's directory fall back to the global name, which is ambiguous too.
    first = ranked.join(offer, "key").groupBy("source", "import").agg(F.min_by(F.struct("key", "module", "owners", "all"), "rank").alias("hit"))
    many = F.col("hit.key").startswith("d:")
    target = F.when(many, F.col("hit.all")).when(F.col("hit.owners") == 1, F.array("hit.module")).otherwise(F.array().cast("array<string>"))
    return first.select("source", "import", F.explode(target).alias("target"))
