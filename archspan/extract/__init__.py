"""Extractors: one source file in, its facts out.

``file_facts`` is a narrow pass: files go through Arrow batches to the extractor of their
language, and come back as rows of ``schema.FILE_FACTS`` plus ``declared`` (type or
unit names that the file declares for other files to import).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import purpose
from ..schema import FILE_FACTS
from ..shipping import ship
from . import curly, pascal, python, ruby, typescript

#: Extractor by language; registering a language here is all a new one needs.
EXTRACTORS: dict[str, Callable[[str, str], dict]] = {
    "python": python.extract,
    "typescript": typescript.extract,
    "tsx": typescript.extract,
    "rust": curly.rust,
    "csharp": curly.csharp,
    "java": curly.java,
    "go": curly.go,
    "ruby": ruby.extract,
    "pascal": pascal.extract,
}
_PATHS = T.ArrayType(T.StructType([T.StructField("unit", T.StringType()), T.StructField("path", T.StringType())]))
SCHEMA = T.StructType([*FILE_FACTS.fields, T.StructField("declared", T.ArrayType(T.StringType())), T.StructField("paths", _PATHS)])


def naming(path: str) -> str:
    """Naming convention of a file's stem."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    for suffix in (".test", ".spec", ".e2e", ".stories", ".d"):
        stem = stem.removesuffix(suffix)
    forms = (("snake_case", "[a-z][a-z0-9_]*"), ("kebab-case", "[a-z][a-z0-9-]*"), ("PascalCase", "[A-Z][a-zA-Z0-9]*"), ("camelCase", "[a-z][a-zA-Z0-9]*"))
    return next((label for label, form in forms if re.fullmatch(form, stem)), "mixed")


def extract_one(path: str, language: str, repo: str, content: str) -> dict:
    found = EXTRACTORS[language](path, content)
    pairs = [(e["name"], e["kind"]) for e in found["entities"]]
    family = "typescript" if language == "tsx" else language
    label = purpose.infer(f"/{path}", content, family, pairs)
    if label in purpose.GENERIC and pairs:
        label = purpose.infer(f"/{path}", "", family, pairs)
    return {"path": path, "language": language, "repo": repo, "content_hash": hashlib.sha256(content.encode()).hexdigest(), "purpose": label, "naming": naming(path), "declared": [], "paths": []} | found


def file_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, repo, content); languages without an extractor are left out."""
    ship(files.sparkSession)
    columns = [f.name for f in SCHEMA.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [extract_one(*r) for r in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame([[row[c] for c in columns] for row in rows], columns=columns)

    known = files.filter(files.language.isin(*EXTRACTORS)).select("path", "language", "repo", "content")
    return known.mapInPandas(run, SCHEMA)
