from collections import Counter

import pytest
from helpers import documents
from pyspark.sql import functions as F

from archspan.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert got != sorted(got)


@pytest.mark.parametrize("clash", [(), ("SHARD", "slot", "_h", "_row", "_n")])
def test_all_rows_whole_gapless_and_even(spark, clash):
    df = documents(spark, clash=clash)
    rows = sharding.shard(df, 4).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_placement_does_not_depend_on_partitions(spark):
    df = documents(spark)
    one = Counter(map(str, sharding.shard(df.coalesce(1), 5, seed=3).collect()))
    many = Counter(map(str, sharding.shard(df.repartition(7), 5, seed=3).collect()))
    assert one == many


def test_narrow_rows_with_many_copies(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("doc_id"), F.lit(1).alias("size"))
    rows = sharding.shard(df, 7).collect()
    assert len(rows) == 1000
    assert sorted(Counter(r["shard"] for r in rows).values()) == [142, 143, 143, 143, 143, 143, 143]


def test_empty_table(spark):
    assert sharding.shard(documents(spark, []), 3).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(documents(spark, []), 0)
