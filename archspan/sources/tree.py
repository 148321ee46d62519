"""Source trees: discovery, language routing, repositories, module ids, file text.

Paths are listed first, and filters and joins work on them; contents are read
by the executors for the files that stay.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories that are never scanned.
SKIP_DIRS = (
    "node_modules", ".venv", "venv", "__pycache__", ".git", "dist", ".next", ".turbo", "bin", "build", "obj", "coverage", ".tox",
    "site-packages", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "vendor", ".worktrees", ".ralphy-worktrees", ".ralphy-sandboxes",
)
# File endings of each language; Pascal's in any letter case.
EXTENSIONS = (
    ("typescript", (".ts",)),
    ("tsx", (".tsx",)),
    ("python", (".py",)),
    ("rust", (".rs",)),
    ("csharp", (".cs",)),
    ("java", (".java",)),
    ("go", (".go",)),
    ("ruby", (".rb", ".rake")),
    ("pascal", (".pas", ".pp", ".lpr", ".dpr", ".inc")),
)


def language(path: Column) -> Column:
    """Language of a file by its name, null if none."""
    chain = F.when(path.endswith(".d.ts"), F.lit(None).cast("string"))
    for name, endings in EXTENSIONS:
        value = F.lower(path) if name == "pascal" else path
        hit = F.lit(False)
        for ending in endings:
            hit = hit | value.endswith(ending)
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def module_id(path: Column, lang: Column) -> Column:
    """Id of a module: the relative path by the language's rule."""
    cut = lambda pattern: F.regexp_replace(path, pattern, "")
    return (
        F.when(lang == "python", cut(r"(?:(?<=.)/index)?\.py$"))
        .when(lang.isin("typescript", "tsx"), cut(r"(?:(?<=.)/index)?\.tsx?$"))
        .when(lang == "rust", cut(r"(?:(?<=.)/mod)?\.rs$"))
        .when(lang == "csharp", cut(r"\.cs$"))
        .when(lang == "java", cut(r"\.java$"))
        .when(lang == "go", cut(r"\.go$"))
        .when(lang == "ruby", cut(r"\.(?:rb|rake)$"))
        .when(lang == "pascal", cut(r"(?i)\.(?:pas|pp|lpr|dpr)$"))
        .otherwise(path)
    )


def _dirs(path: str) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def listing(root: str, skipped: frozenset[str]) -> tuple[list[str], list[str]]:
    """(files, repository roots) below ``root`` as relative paths, without entering skipped directories.

    A listing is metadata and made on the driver, as Spark's own readers do; those
    readers cannot be used here because they hide names like ``__init__.py``.
    Links are not followed.
    """
    if "://" in root:
        store, base = pafs.FileSystem.from_uri(root)
        files, roots, todo = [], [], [base.rstrip("/")]
        while todo:
            for entry in store.get_file_info(pafs.FileSelector(todo.pop())):
                inner = entry.path[len(base.rstrip("/")) + 1 :]
                if entry.base_name == ".git":
                    roots.append(inner[: -len("/.git")] if "/" in inner else "")
                elif entry.type == pafs.FileType.File:
                    files.append(inner)
                elif entry.base_name not in skipped:
                    todo.append(entry.path)
        return sorted(files), sorted(r for r in roots if r)
    files, roots = [], []
    for folder, dirs, names in os.walk(root, followlinks=False):
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        if inner != "." and (".git" in dirs or ".git" in names):
            roots.append(inner)
        dirs[:] = [d for d in dirs if d not in skipped and not os.path.islink(os.path.join(folder, d))]
        files += [n if inner == "." else f"{inner}/{n}" for n in names if not os.path.islink(os.path.join(folder, n))]
    return sorted(files), sorted(roots)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds the text of each path, bytes that are no UTF-8 replaced; read by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for batch in batches:
            texts = []
            for path in batch["path"]:
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
            yield batch.assign(content=texts)

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.StringType())]))


def discover(spark: SparkSession, root: str, exclude_dirs: tuple[str, ...] = (), ignored: DataFrame | None = None, repo: str = "root") -> DataFrame:
    """(path, language, repo, content) of the source files below ``root``.

    ``root`` is a folder that all executors see, or a URI of a file system.
    ``exclude_dirs`` are directory names beyond ``SKIP_DIRS``. ``ignored`` has a column
    path of files and of directories (with a slash at the end) that are left out.
    """
    for name in exclude_dirs:
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a directory name: {name}")
    paths, tops = listing(root, frozenset((*SKIP_DIRS, *exclude_dirs)))
    files = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("language", language(F.col("path"))).filter("language is not null")
    backup = F.exists(_dirs("path"), lambda d: F.lower(d) == "backup")
    files = files.filter(~((F.col("language") == "pascal") & backup))
    if ignored is not None:
        files = without_ignored(files, ignored)
    roots = spark.createDataFrame([(t,) for t in tops], "top string")
    return with_content(with_repo(files, roots, repo).select("path", "language", "repo"), root).select("path", "language", "repo", "content")


def _prefixes(path: str) -> Column:
    """Every directory above a path."""
    dirs = _dirs(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda n: F.array_join(F.slice(dirs, F.lit(1), n), "/"))


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that are not listed themselves and not below a listed directory."""
    gone = ignored.select(F.regexp_replace("path", "/$", "").alias("_gone")).distinct()
    above = files.select("path", F.explode(F.concat(_prefixes("path"), F.array("path"))).alias("_gone")).join(gone, "_gone", "left_semi").select("path").distinct()
    return files.join(above, "path", "left_anti")


def with_repo(files: DataFrame, roots: DataFrame, default: str) -> DataFrame:
    """Name of the nearest directory above that is a repository root (column top)."""
    above = files.select("path", F.explode(_prefixes("path")).alias("top")).join(roots.distinct(), "top")
    nearest = above.groupBy("path").agg(F.max_by("top", F.length("top")).alias("_top"))
    return files.join(nearest, "path", "left").withColumn("repo", F.coalesce(F.substring_index("_top", "/", -1), F.lit(default))).drop("_top")


# Files that make a directory a project of a language.
PROJECT_FILES = {
    "python": r"pyproject\.toml|setup\.py|setup\.cfg", "typescript": r"tsconfig\.json", "rust": r"Cargo\.toml", "csharp": r".*\.(?:csproj|sln)",
    "java": r"pom\.xml|build\.gradle(?:\.kts)?", "go": r"go\.mod", "ruby": r"Gemfile", "pascal": r".*\.(?:lpi|dproj)",
}


def projects(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, language, project, config): the deepest project above each file, from config files (path)."""
    name = F.substring_index("path", "/", -1)
    top = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    found = None
    for lang, pattern in PROJECT_FILES.items():
        part = configs.filter(name.rlike(f"^(?:{pattern})$")).select(F.lit(lang).alias("_l"), top.alias("project"), F.col("path").alias("config"))
        found = part if found is None else found.unionByName(part)
    family = F.when(F.col("language") == "tsx", "typescript").otherwise(F.col("language"))
    above = files.select("path", "language", family.alias("_l"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), _prefixes("path")))).alias("project")).join(found, ["_l", "project"])
    best = above.groupBy("path", "language").agg(F.max_by(F.struct("project", "config"), F.struct(F.length("project"), "config")).alias("_b"))
    return best.select("path", "language", "_b.project", "_b.config")


def git_ignored(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Paths that git would ignore, by the repository's own rules only; empty without git."""
    try:
        found = subprocess.run(["git", "-c", "core.excludesFile=/dev/null", "-C", root, "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True, timeout=60, check=False).stdout
    except (OSError, subprocess.SubprocessError):
        found = ""
    return spark.createDataFrame([(p,) for p in found.split("\0") if p], "path string")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(sha, first_parent) of every commit of all refs and reflogs."""
    out = subprocess.run(["git", "-C", root, "rev-list", "--all", "--reflog", "--parents"], capture_output=True, text=True, timeout=120, check=True).stdout
    rows = [line.split() for line in out.splitlines() if line]
    return spark.createDataFrame([(r[0], r[1] if len(r) > 1 else None) for r in rows], "sha string, first_parent string")


def subjects(spark: SparkSession, root: str) -> DataFrame:
    """(sha, subject) of every commit of all refs and reflogs."""
    out = subprocess.run(["git", "-C", root, "log", "--all", "--reflog", "--format=%H%x09%s"], capture_output=True, text=True, timeout=120, check=True).stdout
    return spark.createDataFrame([tuple(line.split("\t", 1)) for line in out.splitlines() if "\t" in line], "sha string, subject string")


def diff_lines(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(line_no, line) of the diff of a working tree against ``ref`` without context lines."""
    out = subprocess.run(["git", "-C", root, "diff", "--unified=0", ref], capture_output=True, text=True, timeout=30, check=True).stdout
    return spark.createDataFrame([(i, x) for i, x in enumerate(out.splitlines())], "line_no long, line string")
