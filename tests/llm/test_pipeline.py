"""The pipeline on planted documents, stage by stage against plain Python."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from helpers import SCHEMA, TOKEN, prose
from test_decontaminate import expected as contamination
from test_mixing import filled
from test_near_dedup import grouped
from test_quality_rules import expected as statistics


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 40)) for i in range(5)]
    rows = []

    def add(text, source=None):
        rows.append((len(rows), text, "en", source or f"src{len(rows) % 4}", len(text or "")))

    for _ in range(150):
        add(prose(rng, rng.randint(60, 140)))
    for base in range(0, 30, 3):  # exact and near copies
        add(rows[base][1])
        words = rows[base][1].split()
        words[10] = "changed"
        add(" ".join(words))
    for i in range(12):  # benchmark passages, a few in much other text
        add(prose(rng, 30) + " " + items[i % 5][1] + " " + prose(rng, 30 if i % 3 else 900))
    for _ in range(10):
        add(" ".join(f"{w}&&&" for w in prose(rng, 60).split()))
        add("too short to stay")
    add(None)
    add("")
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def stage(spark, name, rows, folder):
    function = dict(corpus_pipeline.STAGES)[name]
    return function(spark, spark.createDataFrame(rows, SCHEMA), folder)


def test_stages_equal_brute_force(spark, planted):
    folder, rows, items = planted
    plain = lambda df: sorted(tuple(r) for r in df.collect())

    kept = stage(spark, "quality_rules", rows, folder)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    def passes(text):
        n, chars, symbols, dups, repeats = statistics(text)
        return n >= 20 and 100 * repeats <= 30 * n and 2 * n <= chars <= 20 * n and 4 * symbols <= n

    rows = sorted(r for r in rows if passes(r[1]))
    assert plain(kept) == rows

    kept = stage(spark, "near_duplicates", rows, folder)
    first = {min(c) for c in grouped(rows)}
    rows = [r for r in rows if r[0] in first]
    assert plain(kept) == rows

    kept = stage(spark, "decontamination", rows, folder)
    rows = [r for r in rows if not contamination(r[1], items)[4]]
    assert plain(kept) == rows
    assert len(rows) > 140

    mixed = stage(spark, "mixture", rows, folder)
    taken = Counter(r["source"] for r in mixed.collect() for _ in TOKEN.findall(r["text"]))
    want = filled(Counter(r[3] for r in rows for _ in TOKEN.findall(r[1])))
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] for s in want)
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    rows = [tuple(r) for r in mixed.collect()]
    placed = stage(spark, "shards", rows, folder).collect()
    assert sorted(tuple(r)[:5] for r in placed) == sorted(rows)
    sizes = Counter(r["shard"] for r in placed)
    assert max(sizes.values()) - min(sizes[k] for k in range(corpus_pipeline.SHARDS)) <= 1


def test_run_chains_the_stages_and_reruns_agree(spark, planted):
    folder = planted[0]
    one = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert one and one == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
