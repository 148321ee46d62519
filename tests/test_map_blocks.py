"""Maps that are written and read in several blocks."""

import os
import random
from collections import Counter

import pytest

from archspan.functions.pattern import QueryError
from archspan.operators import edges
from archspan.operators.scratch import Scratch
from archspan.sources import factmap


@pytest.fixture
def narrow(spark):
    """Blocks of a few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def names(rng, n):
    return sorted({"/".join(rng.choice(["a", "b", "c-d", "e.f", "g"]) for _ in range(rng.randint(1, 6))) for _ in range(n)})


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_trie_in_parts_is_the_trie_of_all(spark, monkeypatch, rows):
    monkeypatch.setattr(factmap, "TRIE_ROWS", rows)
    ids = [(m, f"s{i}") for i, m in enumerate(names(random.Random(rows), 60))]
    got = factmap.trie_parts(spark.createDataFrame(ids, "module string, sid string"), Scratch(spark)).orderBy("part", "n").collect()
    want = list(factmap.path_trie(sorted((m.split("/"), s) for m, s in ids)))
    assert "\n".join(r["fact"] for r in got).split("\n") == want


def map_text(rng, trie):
    modules = names(rng, 80)
    sids = {m: f"s{i}" for i, m in enumerate(modules)}
    lines = ["; a comment (with \" in it", f"(belief-map :schema 1 :files 1 :nodes {len(modules)} :edges 1 :violations 0)"]
    if trie:
        lines += ["(paths", *factmap.path_trie(sorted((m.split("/"), s) for m, s in sids.items())), ")"]
    else:
        lines += [f'(def {s} "{m}") ; note' for m, s in sids.items()]
    for m, s in sids.items():
        lines.append(f'(node {s} py "x ({rng.randint(0, 9)}" :naming snake_case :pkg p)')
        lines += rng.choice([[f"(cls {s} K 4", "  (:bases A B)", "  (:methods run", "   stop))"], [f'(fn {s} "odd (name" 3)'], [f"(fn {s} f;g 3) (fn {s} h 4)"]])
        lines.append(f"(refs {s} {sids[rng.choice(modules)]}::K::x)")
    return "\n".join(lines) + "\n"


def keyed(facts):
    return Counter((line, kind, tuple(args), tuple(flags), tuple(sorted((k, tuple(v)) for k, v in lists.items()))) for line, kind, args, flags, lists in facts)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_the_facts_of_the_text(spark, tmp_path, narrow, seed):
    text = map_text(random.Random(seed), seed % 2)
    path = tmp_path / "map.sexp"
    path.write_text(text)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
    assert keyed(tuple(r) for r in factmap.read_facts(spark, str(path)).collect()) == keyed(factmap.parse(text)[1])


def test_no_task_reads_the_whole_map(spark, tmp_path, narrow, monkeypatch):
    monkeypatch.setattr(factmap, "parse_texts", lambda texts: pytest.fail("read as one text"))
    for trie in (False, True):
        (tmp_path / "map.sexp").write_text(map_text(random.Random(9), trie))
        assert factmap.read_facts(spark, str(tmp_path / "map.sexp")).count()


def test_a_later_definition_holds_below_it(spark, tmp_path, narrow):
    text = "(belief-map :schema 1 :nodes 2)\n(def s a)\n(node s py x)\n(def s b)\n(node s py y)\n(refs s s::E)\n"
    (tmp_path / "map.sexp").write_text(text + '(fn s "two\nlines" 3)\n')
    got = factmap.read_facts(spark, str(tmp_path / "map.sexp")).collect()
    assert {(r["kind"], *r["args"]) for r in got} == {("node", "a", "py", "x"), ("node", "b", "py", "y"), ("refs", "b", "b::E"), ("fn", "b", "two\nlines", "3")}


@pytest.mark.parametrize("text", ["(node a py x)\n(belief-map :schema 1 :nodes 1)", "(belief-map :schema 2 :nodes 0)", "(belief-map :schema 1 :nodes 2)\n(node a py x)", "(belief-map :schema 1 :nodes 0", "(belief-map :schema 1 :nodes 0))", ""])
def test_bad_files_are_refused(spark, tmp_path, text):
    (tmp_path / "map.sexp").write_text(text)
    with pytest.raises(QueryError):
        factmap.read_facts(spark, str(tmp_path / "map.sexp")).collect()


def test_the_driver_holds_no_trie(spark, tmp_path, monkeypatch):
    """The ids come to the driver neither as rows nor as one list."""
    modules = spark.createDataFrame([(f"a/b{i // 9}/c{i}", f"p{i}", "py", "pkg", "x", "") for i in range(100)], "module string, path string, lang string, pkg string, purpose string, naming string")
    entities = spark.createDataFrame([], "module string, name string, kind string, line int, bases array<string>, deco array<string>, methods array<string>")
    g = factmap.Graph(modules, entities, spark.createDataFrame([], "etype string, source string, target string"))
    monkeypatch.setattr(factmap, "TRIE_ROWS", 10)
    monkeypatch.setattr(factmap, "path_trie", lambda *a: pytest.fail("one list"))
    monkeypatch.setattr(type(modules), "toLocalIterator", lambda *a, **k: pytest.fail("rows in the driver"))
    path = os.path.join(tmp_path, "map.sexp")
    factmap.write_map(g, path, True)
    back = factmap.read_map(spark, path)
    assert {r["module"] for r in back.modules.collect()} == {f"a/b{i // 9}/c{i}" for i in range(100)}
    assert edges.short_ids(back.modules).count() == 100
