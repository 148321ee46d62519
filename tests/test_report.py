import pytest
from pyspark.sql import functions as F
from test_graph import got, make

from archspan.functions import classify, uri
from archspan.functions.pattern import QueryError
from archspan.operators import edges
from archspan.plans import report
from archspan.sources import tree


@pytest.fixture(scope="module")
def answers(spark):
    graph = make(
        spark,
        [("a/x", "service"), ("a/y", "data model"), ("b/z", "")],
        [("a/y", "Thing", "cls", 3, ["run"]), ("a/x", "go", "fn", 1, []), ("b/z", "stop", "fn", 2, [])],
        [("imports", "a/x", "a/y"), ("imports", "b/z", "a/y"), ("imports", "a/y", "b/z"), ("refs", "a/x", "a/y::Thing"), ("calls", "a/x::go", "b/z::stop")],
    )
    facts = spark.createDataFrame([(4, "a/y", "(cls a/y Thing 3)")], "line_no long, module string, fact string")
    sources = spark.createDataFrame([("a/x.py", "def go():\n    hit()\n")], "path string, content string")
    diff = lambda ref: spark.createDataFrame([(0, "+++ b/a/x.py"), (1, "@@ -1 +2 @@")], "line_no long, line string")
    return report.Report(graph, "/nowhere", facts, sources, diff)


@pytest.mark.parametrize(
    ("command", "args", "expected"),
    [
        ("boundary", ("a/y",), "(boundary-rdep a/y a/x :lang py :file \"a/x.py\" :relation imports)"),
        ("boundary", ("a/y",), "(boundary-summary a/y :total 4 :deps 1 :rdeps 2)"),
        ("boundary", ("a/y", "--files-only"), "a/y.py"),
        ("module", ("a/y",), "(cls a/y Thing 3 :lang py (:methods run))"),
        ("deps", ("a/x", "2"), "(dep a/x b/z :lang py :via imports :depth 2)"),
        ("deps", ("a/x", "2"), "(dep a/x b/z :lang py :via calls :depth 1 :cycle)"),
        ("rdeps", ("a/y", "1"), "(rdep a/y b/z :lang py :via imports :depth 1)"),
        ("entity", ("Thing",), "(entity-def cls a/y Thing 3 :lang py :file \"a/y.py\")"),
        ("entity", ("Thing",), "(refs a/x a/y::Thing)"),
        ("flow", ("a/x", "go"), "(flow a/x::go b/z::stop :lang py :via calls :depth 0)"),
        ("analyze", ("a/y",), "(key-entity a/y Thing :lang py :kind cls :line 3 :refs 1 :modules 1)"),
        ("analyze", ("a/y",), "(analyze-dependent a/y a/x :lang py :via imports refs :file \"a/x.py\")"),
        ("analyze", ("a/y",), "(analyze-summary a/y :entities 1 :imports 1 :dataflows 0 :refs 0 :dependents 2 :boundary-files 3)"),
        ("quick", ("thing",), "(analyze a/y :lang py \"data model\" :file \"a/y.py\")"),
        ("search", ("^a/.*",), "(search-count 2)"),
        ("search", ("thing",), "(cls a/y Thing 3)"),
        ("boundaries", (), "(boundaries-ok :checked 3)"),
        ("layers", (), "(layer-group domain :count 1)"),
        ("invariants", (), "(invariants-ok :checked 3)"),
        ("find_function", ("go",), "(fn-def a/x::go :line 1 :lang py :file \"a/x.py\" :kind function)"),
        ("find_type", ("thing",), "(type-def cls a/y::Thing :line 3 :lang py :file \"a/y.py\")"),
        ("find_callers", ("stop",), "(caller a/x::go -> b/z::stop :lang py :file \"a/x.py\")"),
        ("find_calls", ("go", "1"), "(calls-target a/x::go -> b/z::stop :lang py :file \"b/z.py\")"),
        ("find_callchain", ("go", "stop"), "(callchain-summary :length 2 :hops 1)"),
        ("find_callchain", ("stop", "go"), "(callchain-module-summary :length 2 :hops 1)"),
        ("grep_functions", ("hit",), "(grep-match a/x::go :line 2 :file \"a/x.py\" :text \"hit()\")"),
        ("diff_functions", (), "(diff-functions-summary :changed 1 :files 1 :ref \"HEAD\")"),
        ("query", ('(deps "a/x"', "1)"), "(result-count 2)"),
        ("module", ("a-zz",), "(suggestion a/x)"),
    ],
)
def test_lines(answers, command, args, expected):
    assert expected in report.run(answers, command, *args)


def test_bad_requests(answers):
    for command, args in (("nope", ()), ("deps", ("a/x", "x")), ("deps", ()), ("search", ("[",)), ("grep_functions", ("(",))):
        with pytest.raises(QueryError):
            report.run(answers, command, *args)


def test_prefixes_differ():
    assert edges.prefixes(["web", "weather", "agent-hub", "ah"]) == {"web": "we", "weather": "wea", "agent-hub": "ah", "ah": "ah2"}


def test_language_server_results(spark):
    syntax = spark.createDataFrame([("m", "A", "cls", 9, ["Base"], ["D"], ["run"]), ("m", "only", "fn", 4, [], [], [])], "module string, name string, kind string, line int, bases array<string>, deco array<string>, methods array<string>")
    server = spark.createDataFrame([("m", "A", "ifc", 3, [], [], []), ("m", "new", "fn", 7, [], [], [])], syntax.schema)
    rows = {r["name"]: r for r in edges.merge_symbols(syntax, server).collect()}
    assert (rows["A"]["kind"], rows["A"]["line"], rows["A"]["methods"], rows["A"]["bases"]) == ("ifc", 3, ["run"], ["Base"])
    assert set(rows) == {"A", "only", "new"}
    calls = spark.createDataFrame([("m", "f", "n.py", "g", 5), ("m", "f", "n.py", "g", 2), ("m", "f", "gone.py", "h", 1)], "source string, name string, path string, target_name string, line int")
    paths = spark.createDataFrame([("n.py", "n")], "path string, module string")
    assert got(edges.call_edges(calls, paths), "source", "target", "lines") == [("m::f", "n::g", [2, 5])]


def test_projects(spark):
    files = spark.createDataFrame([("a/b/x.ts", "typescript"), ("a/y.tsx", "tsx"), ("c.py", "python"), ("d.go", "go")], "path string, language string")
    configs = spark.createDataFrame([("a/tsconfig.json",), ("a/b/tsconfig.json",), ("setup.py",)], "path string")
    assert got(tree.projects(files, configs), "path", "project") == [("a/b/x.ts", "a/b"), ("a/y.tsx", "a"), ("c.py", "")]


def test_uris_and_columns(spark):
    assert uri.decode(uri.encode("/a b/é+%.py")) == "/a b/é+%.py" and uri.encode("/a b") == "file:///a%20b"
    df = spark.createDataFrame([("foo", "  foo()"), ("no", "x")], "n string, l string")
    assert [r[0] for r in df.select(classify.column_of(F.col("n"), F.col("l"))).collect()] == [2, 0]
