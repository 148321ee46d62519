import pytest
from pyspark.sql import functions as F

from archspan.functions import classify
from archspan.functions.pattern import QueryError, depth_of, matches, to_like
from archspan.operators import edges, graph, lookup, policy, ranges
from archspan.operators.graph import Graph
from archspan.plans import sexpr
from archspan.schema import EDGES, ENTITIES, MODULES


def make(spark, modules=(), entities=(), links=()):
    m = spark.createDataFrame([(i, f"{i}.py", "py", "p", purpose, "snake_case") for i, purpose in modules], MODULES)
    e = spark.createDataFrame([(mod, name, kind, line, [], [], list(methods)) for mod, name, kind, line, methods in entities], ENTITIES)
    x = spark.createDataFrame([(t, a, b, [], []) for t, a, b in links], EDGES)
    return Graph(m, e, x)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [("abc", "xABCx", True), ("^abc", "xabc", False), ("abc$", "xABC", True), ("a.*c", "a-b-c", True), ("a.c", "abc", False), ("a.c", "a.c", True), ("a\\*", "a*", True), ("a_c", "abc", False), ("50%", "a50%b", True), ("^a.*b$", "ab", True), ("^a.*a$", "a", False), ("!", "x!", True), ("", "any", True),],
)
def test_safe_patterns(spark, pattern, value, hit):
    assert spark.createDataFrame([(value,)], "v string").select(matches(F.col("v"), pattern)).first()[0] is hit


@pytest.mark.parametrize("bad", ["[a]", "(a+)+$", "a|b", "a?", "a{2}", "*", "a^b", "a$b", "a\\", "a\\$", "x" * 257])
def test_unsafe_patterns_are_refused(bad):
    with pytest.raises(QueryError):
        to_like(bad)


@pytest.mark.parametrize("bad", ["x", "-1", "51", "1.5"])
def test_bad_depths_are_refused(bad):
    with pytest.raises(QueryError):
        depth_of(bad)


def test_depth_first_walk_differs_from_hops(spark):
    g = make(spark, [(x, "") for x in "rabc"], (), [("imports", "r", "a"), ("imports", "r", "b"), ("imports", "a", "b"), ("imports", "b", "c")])
    roots = spark.createDataFrame([("r",)], "module string")
    assert got(graph.hops(g, roots, 2), "depth", "module") == [(1, "a"), (1, "b"), (2, "c")]
    rows = sorted((r["step"], r["depth"], r["module"], r["cycle"]) for r in graph.walk(g, roots, 2).collect())
    assert [r[1:] for r in rows] == [(1, "a", False), (2, "b", False), (1, "b", True)]
    assert got(graph.hops(g, roots, 6), "depth", "module") == [(1, "a"), (1, "b"), (2, "c")]
    assert got(graph.hops(g, spark.createDataFrame([("c",)], "module string"), 5, True), "depth", "module") == [(1, "b"), (2, "a"), (2, "r")]


def test_closure_reaches_a_fixpoint_and_cycles_return(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)] + [("12", "0")], "parent string, child string")
    found = graph.closure(links, spark.createDataFrame([("0",)], "node string"))
    assert found.count() == 13
    assert got(found.filter("node = '0'"), "depth") == [(13,)]


def test_call_chain_is_shortest(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "x")], "source string, target string")
    node = lambda n: spark.createDataFrame([(n,)], "node string")
    assert got(graph.call_chain(calls, node("a"), node("e")), "hops", "path") == [(3, ["a", "b", "d", "e"])]
    assert graph.call_chain(calls, node("x"), node("e")).collect() == []
    assert graph.call_chain(calls, node("a"), node("e"), 2).collect() == []


def test_resolve_tiers(spark):
    g = make(spark, [("app/core/Service", ""), ("app/core/service_test", ""), ("lib/core", "")])
    assert got(lookup.resolve(g.modules, "lib/core"), "module") == [("lib/core",)]
    assert got(lookup.resolve(g.modules, "core"), "module") == [("lib/core",)]
    assert got(lookup.resolve(g.modules, "core/"), "module") == [("app/core/Service",), ("app/core/service_test",)]
    assert got(lookup.resolve(g.modules, "SERVICE"), "module") == [("app/core/Service",), ("app/core/service_test",)]
    assert lookup.resolve(g.modules, "nothing").collect() == []
    assert got(lookup.suggest(g.modules, "app-core-x"), "module", "score") == [("app/core/Service", 2), ("app/core/service_test", 2), ("lib/core", 1)]


def test_methods_are_listed_once(spark):
    g = make(spark, [("m", "")], [("m", "X", "cls", 1, ["call", "other"]), ("m", "X#call", "fn", 5, [])])
    assert got(lookup.find_function(g, "call"), "id", "line", "kind") == [("m::X#call", 5, "method")]
    assert got(lookup.find_function(g, "other"), "id", "line", "kind") == [("m::X.other", 1, "method")]


def test_callers_by_id_and_bare_name(spark):
    g = make(spark, [("a", ""), ("b", "")], [("b", "run", "fn", 1, [])], [("calls", "a::go", "b::run"), ("calls", "a::go", "z::run"), ("calls", "b::run", "a::go")])
    assert got(lookup.find_callers(g, "run"), "source", "target") == [("a::go", "b::run"), ("a::go", "z::run")]
    assert got(lookup.find_calls(g, "run"), "source", "target") == [("b::run", "a::go")]


def test_layers(spark):
    cases = [("x/api/y", "", "api"), ("api/y", "", "other"), ("x/y", "data model", "domain"), ("x/y", "servce layr", "api"), ("x/y", "servce", "service"), ("x/y", "general module", "other"), ("x/Tests/api/y", "", "test"), ("web/x/store/y", "", "other"), ("x/web/store/y", "", "ui"), ("my_s3_thing", "", "infra"), ("a/modules/b.module", "", "config"), ("q", "reposotory", "infra"), ("q", "the mailer of x", "service"), ("q", None, "other")]
    df = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "i string, m string, p string, want string")
    for r in df.select("m", "p", "want", classify.layer(F.col("m"), F.col("p")).alias("layer")).collect():
        assert r["layer"] == r["want"], r


def test_naming(spark):
    cases = {"a/snake_case.py": "snake_case", "kebab-case.ts": "kebab-case", "Pascal.tsx": "PascalCase", "camelCase.ts": "camelCase", "Odd-Name.ts": "mixed", "thing.test.ts": "snake_case"}
    df = spark.createDataFrame(list(cases.items()), "f string, want string")
    assert all(r[0] == r[1] for r in df.select("want", classify.naming(F.col("f"))).collect())


def test_rules(spark):
    g = make(spark, [("x/domain/a", "domain logic"), ("x/infra/b", "infrastructure adapter"), ("x/api/c", "")], (), [("imports", "x/domain/a", "x/infra/b"), ("data-flow", "x/domain/a", "x/infra/b"), ("refs", "x/domain/a", "x/api/c"), ("imports", "x/infra/b", "x/api/c")])
    assert got(policy.violations(g), "source", "target", "etype") == [("x/domain/a", "x/infra/b", "data-flow"), ("x/domain/a", "x/infra/b", "imports"), ("x/infra/b", "x/api/c", "imports")]
    assert got(policy.purpose_violations(g), "source", "target") == [("x/domain/a", "x/infra/b")]
    allowed = spark.createDataFrame([("x/domain/a", "x/infra/b")], "source string, target string")
    assert policy.purpose_violations(g, allowed).collect() == []


def test_query_language(spark):
    g = make(spark, [("a/x", ""), ("a/y", ""), ("b/z", "")], [("a/y", "Thing", "cls", 3, [])], [("imports", "a/x", "a/y"), ("imports", "b/z", "a/y"), ("imports", "a/y", "b/z"), ("refs", "a/x", "a/y::Thing")])
    run = lambda text: sorted(r[0] for r in sexpr.query(g, text).collect())
    assert run('(deps "a/x" 1)') == ["a/y"]
    assert run('(deps "a/x" 2)') == ["a/y", "b/z"]
    assert run('(rdeps "a/y")') == ["a/x", "b/z"]
    assert run('(intersect (rdeps "a/y") (deps "a/y" 1))') == ["b/z"]
    assert run('(diff (rdeps "a/y") "b/z")') == ["a/x"]
    assert run('(union "a/x" "b/z")') == ["a/x", "b/z"]
    assert run('(count (boundary "a/y"))') == [3]
    assert run('(files (filter (boundary "a/y") "^a/.*"))') == ["a/x.py", "a/y.py"]
    assert run('(refs-to "Thing")') == ["a/x"]
    assert run('(refs_to "Thing")') == ["a/x"]
    assert run('(find-type "thing")') == ["a/y"]
    assert run('(entity "Thing")') == ["a/y"]
    assert run("(no-such-function x)") == []
    assert run('(layer "nothing")') == ["unknown"]
    for bad in ("(deps", ")", "", '(deps "a/x" many)', '(filter "a/x" "[")'):
        with pytest.raises(QueryError):
            sexpr.query(g, bad).collect()


def test_nested_query_is_one_plan(spark):
    g = make(spark, [("a", ""), ("b", "")], (), [("imports", "a", "b")])
    plan = sexpr.query(g, '(count (union (imports "a") (dependents "b")))')._jdf.queryExecution().toString()
    assert "Union" in plan and "PythonUDF" not in plan


def test_lines_and_ranges(spark):
    files = spark.createDataFrame([("f", "\n".join(f"line {i} {'hit' if i in (2, 7, 150) else ''}" for i in range(1, 300)))], "path string, content string")
    fns = spark.createDataFrame([("f", "one", 1), ("f", "two", 5), ("f", "past", 999)], "path string, name string, line int")
    assert got(ranges.grep(files, fns, "hit"), "name", "line_no") == [("one", 2), ("two", 7)]
    hunks = ["+++ b/f", "@@ -1,2 +3,2 @@ def x", "@@ -9 +10 @@", "@@ -20,3 +20,0 @@", "@@ -1 +1,+x,y odd @@"]
    lines = spark.createDataFrame(list(enumerate(hunks)), "line_no long, line string")
    assert got(ranges.hunks(lines), "path", "start", "end") == [("f", 3, 4), ("f", 10, 10)]
    changed = ranges.changed_entities(ranges.hunks(lines), fns)
    assert got(changed, "name") == [("one",), ("two",)]
    asked = spark.createDataFrame([("f", 1, 4), ("f", 2, 5), ("f", 3, 0)], "path string, ref_id long, ref_line int")
    assert got(ranges.enclosing(asked, fns), "ref_id", "name") == [(1, "one"), (2, "two"), (3, None)]


def test_providers_fail_closed(spark):
    wanted = spark.createDataFrame([("s", "Port"), ("s", "Twice"), ("s", "Named"), ("s", "Lost")], "source string, symbol string")
    offers = spark.createDataFrame([("Port", "p"), ("Twice", "a"), ("Twice", "b"), ("Named", "wrong"), ("Lost", "only")], "symbol string, module string")
    imports = spark.createDataFrame([("s", "Named", 1, "right"), ("s", "Named", 2, "later"), ("s", "Lost", 1, None)], "source string, symbol string, ord int, target string")
    assert got(edges.resolve_symbols(wanted, imports, offers), "symbol", "target") == [("Named", "right"), ("Port", "p")]


def test_target_entity_tiers(spark):
    asked = spark.createDataFrame([("t", n, loc) for n, loc in (("A", "A"), ("B", "B"), ("default", "Main"), ("C", "C"), ("x", "x"), ("D", "D"))], "target string, original string, local string")
    names = spark.createDataFrame([("t", n) for n in ("A", "B", "B", "Main", "N::C", "N::D", "M::D")], "module string, name string")
    exported = spark.createDataFrame([("t", "first", 0), ("t", "x", 1)], "module string, name string, ord int")
    assert got(edges.target_entities(asked, names, exported), "original", "entity") == [("A", "A"), ("C", "N::C"), ("default", "Main"), ("x", "x")]


def test_http_clients(spark):
    clients = spark.createDataFrame([("m", "web", "McpHubClientService"), ("m", "web", "WebClient"), ("n", "api", "AgentExternal"), ("n", "api", "Other")], "module string, repo string, name string")
    repos = spark.createDataFrame([("mcp-hub",), ("web",), ("agent-core",), ("api",)], "repo string")
    assert got(edges.http_edges(clients, repos), "source", "target", "client") == [("m", "mcp-hub", "McpHubClientService"), ("n", "agent-core", "AgentExternal")]
