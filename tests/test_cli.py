"""The command line's loop and topology command, the map writer's trie and lock, and diffs in queries."""

import random

import pytest
from test_graph import make

from archspan import __main__ as cli
from archspan.functions.pattern import QueryError
from archspan.plans import report, sexpr
from archspan.sources import factmap


def small(spark):
    return make(spark, [("a/x", "service"), ("a/y", "data model"), ("b/z", "")], [("a/x", "go", "fn", 1, []), ("b/z", "stop", "fn", 2, [])], [("imports", "a/x", "a/y"), ("imports", "a/y", "b/z")])


def test_repl_answers_until_quit(spark, capsys):
    assert cli.repl(report.Report(small(spark), "/nowhere"), ["", "# note", "deps a/x 1", "deps a/x many", "nothing", "help", "quit", "layers"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["(deps-root a/x :lang py)", "(dep a/x a/y :lang py :via imports :depth 1)"]
    assert out[2].startswith("(error invalid-depth") and out[3].startswith("(error unknown-command") and out[4].startswith("Commands:")
    assert len(out) == 5


def test_topology_command(spark, tmp_path, capsys):
    for path, text in {"c/Chart.yaml": "name: shop\n", "c/node_modules/Chart.yaml": "name: no\n", "tf/main.tf": 'resource "kind" "db" {\n}\n'}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert cli.topology(spark, [str(tmp_path)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[1] == "; --- infrastructure topology ---" and lines[2:] == ["(infra-node infra/shop :kind helm-chart)", "(infra-node infra/tf-db :kind terraform :component kind)"]
    out = tmp_path / "map.sexp"
    out.write_text("before\n")
    assert cli.topology(spark, [str(tmp_path), "--terraform", "--append", str(out)]) == 0
    assert capsys.readouterr().out == "" and out.read_text().splitlines() == ["before", "", "; --- infrastructure topology ---", "(infra-node infra/tf-db :kind terraform :component kind)"]
    assert cli.topology(spark, [str(tmp_path / "c"), "--kustomize", "--stdout"]) == 0
    assert "no supported" in capsys.readouterr().out
    assert cli.topology(spark, [str(tmp_path / "none")]) == 1 and cli.topology(spark, ["--other"]) == 2


def test_trie_reads_back_as_written():
    rng = random.Random(4)
    ids = {"/".join(rng.choice(["a", "b", "c-d", "e.f", "g"]) for _ in range(rng.randint(1, 5))) for _ in range(300)} | {"top", "a/only/one/long/way", "a", "a/b"}
    rows = sorted((i.split("/"), f"s{n}") for n, i in enumerate(sorted(ids)))
    lines = list(factmap.path_trie(rows))
    text = f"(paths {' '.join(lines)})"
    _, form = next(factmap.forms(text))
    found: dict[str, str] = {}
    factmap._paths(form[1:], "", found)
    assert found == {sid: "/".join(segments) for segments, sid in rows}
    assert len(text) < sum(len(f'(def {sid} "{"/".join(s)}")') for s, sid in rows)


def test_trie_runs_over_only_children():
    rows = sorted([(["a", "b", "c", "x"], "1"), (["a", "b", "c", "y"], "2"), (["a", "b", "c"], "3"), (["t"], "4"), (["u", "v"], "5")])
    assert list(factmap.path_trie(rows)) == ["(a/b/c", "(3 :self)", "(1 x)", "(2 y)", ")", "(4 t)", "(u", "(5 v)", ")"]


@pytest.mark.parametrize("trie", [False, True])
def test_written_map_reads_back(spark, tmp_path, trie):
    g = small(spark)
    odd = spark.createDataFrame([("with space/mod", "with space/mod", "py", "p", "", "")], g.modules.schema)
    g.modules = g.modules.unionByName(odd)
    path = str(tmp_path / "map.sexp")
    factmap.write_map(g, path, trie)
    back = factmap.read_map(spark, path)
    assert sorted(r["module"] for r in back.modules.collect()) == ["a/x", "a/y", "b/z", "with space/mod"]
    assert sorted((r["source"], r["target"]) for r in back.edges.collect()) == [("a/x", "a/y"), ("a/y", "b/z")]
    assert ("(paths" in (tmp_path / "map.sexp").read_text()) == trie


def test_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "map.sexp")
    with factmap.exclusive(path), pytest.raises(QueryError, match="locked|map.sexp"):
        factmap.write_map(small(spark), path)
    factmap.write_map(small(spark), path)
    assert [p.name for p in tmp_path.iterdir()] == ["map.sexp"]


def test_diff_functions_in_a_query(spark):
    diff = lambda ref: spark.createDataFrame([(0, "+++ b/a/x.py"), (1, f"@@ -1 +{len(ref)} @@"), (2, "+++ b/none.py"), (3, "@@ -1 +1 @@")], "line_no long, line string")
    g = small(spark)
    assert [r["module"] for r in sexpr.query(g, '(diff-functions "HEAD")', diff).collect()] == ["a/x"]
    assert "(result-count 1)" in report.run(report.Report(g, "/nowhere", diff=diff), "query", '(union (diff-functions "HEAD"))')
    with pytest.raises(QueryError):
        sexpr.query(g, "(diff-functions)")
    assert sexpr.query(g, '(analyze "nothing like it")').collect()[0]["n"] == 0


def test_hunks_across_blocks(spark, monkeypatch):
    from archspan.operators import ranges

    monkeypatch.setattr(ranges, "DIFF_BLOCK", 3)
    lines = ["+++ b/f.py", "@@ -1 +5,2 @@", "+x", "+x", "+x", "+x", "@@ -9,0 +20 @@ def", "+++ b/g.py", "@@ -1,2 +0,0 @@", "@@ -4 +7,3 @@", "+++ /dev/null"]
    found = ranges.hunks(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")).collect()
    assert sorted((r["path"], r["start"], r["end"]) for r in found) == [("f.py", 5, 6), ("f.py", 20, 20), ("g.py", 7, 9)]
