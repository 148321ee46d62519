import pytest

from archspan.functions.pattern import QueryError
from archspan.operators import graph, lookup
from archspan.sources import factmap

MAP = """; a comment
(belief-map :schema 1 :files 3 :nodes 3 :edges 3 :violations 0)
(paths
  (src (s1 :self)
    (src
      (s2 worker.service)
    )
  )
)
(def s3 "with space/mod")
(node s2 ts "service" :naming kebab-case :pkg web)
(node s3 py "general module")
(node other rb "x")
(cls s2 WorkerService 16 :eid abcd1234 (:bases Base) (:methods run stop))
(fn s3 helper 4)
(imports s3 s2 :via-base)
(refs s3 s2::WorkerService)
(calls s3::helper s2::run :lines 3 9 :lsp)
"""


def test_read(spark, tmp_path):
    (tmp_path / "map.sexp").write_text(MAP.replace("(src (s1 :self)\n    (src\n", "(src\n    (inner\n"))
    g = factmap.read_map(spark, str(tmp_path / "map.sexp"))
    assert sorted(r["module"] for r in g.modules.collect()) == ["other", "src/inner/worker.service", "with space/mod"]
    e = {r["name"]: r for r in g.entities.collect()}
    assert (e["WorkerService"]["line"], e["WorkerService"]["bases"], e["WorkerService"]["methods"]) == (16, ["Base"], ["run", "stop"])
    call = g.edges.filter("etype = 'calls'").first()
    assert (call["source"], call["target"], call["lines"], call["flags"]) == ("with space/mod::helper", "src/inner/worker.service::run", [3, 9], ["lines", "lsp"])
    assert sorted(r["module"] for r in graph.boundary(g, "src/inner/worker.service").collect()) == ["src/inner/worker.service", "with space/mod"]
    assert lookup.refs_to(g, "WorkerService").collect()[0]["module"] == "with space/mod"


def test_own_id_of_a_directory():
    out = {}
    factmap._paths([["a", ["s1", ":self"], ["s2", "b"]], ["s3", "c"]], "", out)
    assert out == {"s1": "a", "s2": "a/b", "s3": "c"}


@pytest.mark.parametrize("text", ["(node a py x)", "(belief-map :schema 2 :nodes 0)", "(belief-map :schema 1 :nodes 2)\n(node a py x)", "(belief-map :schema 1 :nodes 0", "(paths (a b))"])
def test_bad_maps_are_refused(text):
    with pytest.raises(QueryError):
        factmap.parse(text)


def test_round_trip_and_same_bytes(spark, tmp_path):
    (tmp_path / "map.sexp").write_text(MAP.replace("(src (s1 :self)\n    (src\n", "(src\n    (inner\n"))
    g = factmap.read_map(spark, str(tmp_path / "map.sexp"))
    one, two = tmp_path / "one.sexp", tmp_path / "two.sexp"
    factmap.write_map(g, str(one))
    again = factmap.read_map(spark, str(one))
    factmap.write_map(again, str(two))
    for name in ("modules", "entities"):
        drop = ["path"] if name == "modules" else []
        a, b = (sorted(map(str, getattr(x, name).drop(*drop).collect())) for x in (g, again))
        assert a == b
    assert sorted((r["etype"], r["source"], r["target"]) for r in g.edges.collect()) == sorted((r["etype"], r["source"], r["target"]) for r in again.edges.collect())
    factmap.write_map(again, str(one))
    assert one.read_bytes() == two.read_bytes()
