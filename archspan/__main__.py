"""Command line: ``python -m archspan [--map FILE] [--root DIR] COMMAND [ARGUMENTS]``.

``repl`` reads commands line by line until ``quit``; ``help`` lists them. ``infra [ROOT]
[--kustomize] [--helm] [--terraform] [--append FILE] [--stdout]`` needs no map: it prints the topology
of the manifests below ROOT, or appends it to a file; without a part it takes all three.

Exit codes: 0 answered (no match included), 1 bad map or command, 2 bad arguments.
"""

from __future__ import annotations

import os
import shlex
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pattern import QueryError
from .operators import infra
from .plans import report
from .sources import factmap, tree

PARTS = ("kustomize", "helm", "terraform")
MANIFEST = r"(?:^|/)(?:Chart\.yaml|values\.yaml|kustomization\.ya?ml|(?:deployment|statefulset|service)\.ya?ml|[^/]*\.tf)$"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the manifests below ``root``."""
    paths, _ = tree.listing(root, frozenset(infra.SKIP_DIRS))
    files = spark.createDataFrame([(p,) for p in paths], "path string").filter(F.col("path").rlike(MANIFEST))
    return tree.with_content(files, root)


def topology(spark: SparkSession, args: list[str]) -> int:
    root, parts, append, shown = os.getcwd(), [], None, False
    rest = iter(args)
    for arg in rest:
        if arg == "--append":
            append = next(rest, None)
        elif arg == "--stdout":
            shown = True
        elif arg[2:] in PARTS and arg.startswith("--"):
            parts.append(arg[2:])
        elif arg.startswith("--"):
            print(f"(error invalid-argument {report.quoted(arg)})")
            return 2
        else:
            root = arg
    if not os.path.isdir(root):
        print(f"(error invalid-argument {report.quoted(root)})")
        return 1
    nodes, edges = infra.topology(manifests(spark, root), tuple(p for p in PARTS if p in parts) or PARTS)
    lines = [r["line"] for r in infra.fact_lines(nodes, edges).orderBy("part", "line").toLocalIterator()]
    lines = ["", "; --- infrastructure topology ---", *(lines or ["; info: no supported Kustomize, Helm, or Terraform files found"])]
    if append is not None:
        with open(append, "a", encoding="utf-8") as out:
            out.writelines(f"{line}\n" for line in lines)
    if shown or append is None:
        print(*lines, sep="\n")
    return 0


def repl(answer: report.Report, lines: Iterable[str]) -> int:
    """Answers one command a line; an error is printed and the loop goes on."""
    for line in lines:
        words = shlex.split(line, comments=True)
        if not words:
            continue
        if words[0] in ("quit", "exit"):
            break
        if words[0] == "help":
            print("Commands:", *report.COMMANDS, "quit")
            continue
        try:
            print(*report.run(answer, *words), sep="\n")
        except QueryError as wrong:
            print(f"(error {wrong.kind} {report.quoted(wrong.text)})")
    return 0


def main(args: list[str]) -> int:
    options = {"--map": None, "--root": os.getcwd()}
    while len(args) > 1 and args[0] in options:
        options[args[0]], args = args[1], args[2:]
        if not os.path.isabs(options["--map"] or "/") or not os.path.isabs(options["--root"]):
            print('(error invalid-argument "paths must be absolute")')
            return 2
    if not args or args[0] in ("-h", "--help", "help"):
        print(__doc__, "\nCommands:", *report.COMMANDS, "repl", "infra")
        return 0
    if args[0] == "infra":
        return topology(SparkSession.builder.appName("archspan").getOrCreate(), args[1:])
    path = options["--map"] or factmap.find_map(os.getcwd())
    if path is None:
        print('(error invalid-map "no map file here or above")')
        return 1
    spark = SparkSession.builder.appName("archspan").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        graph = factmap.read_map(spark, path)
        graph.modules.limit(1).collect()
    except Exception as bad:  # the parser's error arrives through Spark
        print(f"(error invalid-map {report.quoted(str(bad).splitlines()[-1] if str(bad) else path)})")
        return 1
    root = options["--root"]
    sources = tree.discover(spark, root) if args[0] in ("grep_functions", "repl") else None
    answer = report.Report(graph, root, factmap.raw_facts(spark, path), sources, lambda ref: tree.diff_lines(spark, root, ref))
    if args[0] == "repl":
        return repl(answer, sys.stdin)
    try:
        print(*report.run(answer, *args), sep="\n")
    except QueryError as wrong:
        print(f"(error {wrong.kind} {report.quoted(wrong.text)})")
        return 1 if wrong.kind == "unknown-command" else 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
