from collections import defaultdict

import pytest
from helpers import TOKEN, awkward_rows, documents
from pyspark.sql import functions as F

from archspan.llm import mixing


def filled(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in full)
        level = left / max(sum(weight[n] for n in names if n not in full), 1)
        more = {n for n in names if n not in full and level * weight[n] > 3 * sizes[n]}
        if not more:
            return {n: 3 * sizes[n] if n in full else level * weight[n] for n in names}
        full |= more


def check(rows, texts_by_source, tolerance):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for source, r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    want = filled(sizes)
    for source in sizes:
        assert target[source] == pytest.approx(want[source])
        assert abs(taken[source] - want[source]) <= max(1, tolerance * want[source])


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (i % 40 + 1), "en", ("tiny" if i < 20 else f"src{i % 4}" if i % 7 else None), 1) for i in range(1500)]
    df = documents(spark, rows, clash=("taken", "size"))
    got = mixing.mix(df, seed=4).collect()
    assert len(got) == 1500
    by = {r[0]: r[3] for r in rows}
    check([(by[r["doc_id"]], r) for r in got], None, 0.02)
    assert all(r["size"] == r["doc_id"] % 40 + 1 for r in got)
    again = mixing.mix(df.repartition(5), seed=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_awkward_rows(spark):
    got = mixing.mix(documents(spark), seed=1)
    assert got.count() == len(awkward_rows())
    sizes = sorted(r["size"] for r in got.collect())
    assert sizes == sorted(len(TOKEN.findall(t or "")) for _, t, *_ in awkward_rows())


def test_documents_repeat_as_taken(spark):
    rows = [(i, "w " * 10, "en", "a" if i < 30 else "b" if i < 300 else "c", 1) for i in range(900)]
    df = documents(spark, rows, clash=("_c", "taken"))
    got = mixing.mixed(df, seed=2)
    assert got.columns == df.columns
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    want = filled({"a": 300, "b": 2700, "c": 6000})
    for source, words in want.items():
        assert abs(n[source] * 10 - words) <= 0.15 * words + 20


def test_repeated_rows_and_empty_table(spark):
    df = documents(spark, [(1, "a b c", "en", "x", 1)] * 50 + [(2, "d e f", "en", "y", 1)] * 50)
    assert mixing.mixed(df, seed=2).filter("doc_id in (1, 2)").count() > 0
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [])).collect() == []


def test_quotas_are_the_highest_quotients(spark):
    targets = spark.createDataFrame([("sa", 530, 530.0), ("sb", 240, 240.0), ("sc", 230, 230.0)], "_s string, source_size long, target double")
    got = mixing.quotas(targets, 100, 3, shards=2)
    n = {r["_s"]: r["n"] for r in got.groupBy("_s").agg(F.sum("quota").alias("n")).collect()}
    quotients = sorted(((t / (2 * k + 1), s) for s, t in (("sa", 530), ("sb", 240), ("sc", 230)) for k in range(10)), reverse=True)[:10]
    assert n == {s: sum(q[1] == s for q in quotients) for s in n}
    by_shard = [r["n"] for r in got.groupBy("shard").agg(F.sum("quota").alias("n")).collect()]
    assert by_shard == [5, 5]


def test_words_of_each_shard_equal_brute_force(spark, monkeypatch):
    """Quotas, seeded order of blocks and parts of documents, written plainly over the stream of every source."""
    monkeypatch.setattr(mixing, "BLOCKS", 200)
    monkeypatch.setattr(mixing, "BLOCKS_A_SOURCE", 20)
    rows = [(i, "w " * (i * 7 % 60), "en", ("tiny" if i < 15 else f"src{i % 3}"), 1) for i in range(400)]
    df = documents(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix(df, seed=4, shards=5).collect()}
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(4), "doc_id", "text").alias("h")).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows})
    whole = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    targets = filled(whole)
    block = sum(whole.values()) // 200
    seats = sorted(((-targets[s] / (2 * k + 1), "s" + s, k) for s in sources for k in range(-(-whole[s] // block) * 3)))[: round(sum(targets.values()) / block)]
    key = {(r["s"], r["j"]): r["h"] for r in spark.range(400).selectExpr("id as j", "explode(array('" + "','".join(sources) + "')) as s").selectExpr("s", "j", "xxhash64(4, concat('s', s), j) as h").collect()}
    for s in sources:
        quota = [sum(i % 5 == shard for i, seat in enumerate(seats) if seat[1] == "s" + s) for shard in range(5)]
        n = -(-whole[s] // block)
        ranked = sorted(range(n), key=lambda j: (key[s, j], j))
        picks = [(ranked * 3)[i] for i in range(sum(quota))]
        owners = [shard for shard in range(5) for _ in range(quota[shard])]
        x = 0
        for i in sorted((r[0] for r in rows if r[3] == s), key=lambda i: (order[i], i)):
            want = {}
            for j, shard in zip(picks, owners, strict=True):
                words = min(x + size[i], (j + 1) * block) - max(x, j * block)
                if words > 0:
                    want[shard] = want.get(shard, 0) + words
            assert {e["shard"]: e["words"] for e in got[i]["by_shard"]} == want
            assert got[i]["taken"] == sum(want.values())
            x += size[i]
