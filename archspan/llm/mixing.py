"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

Sources in code point order (null last) weigh 1, 2, 3, repeating, or as given, and
share the words of the whole table. A target stops at ``REPEAT`` times its source's words;
the excess is shared again by weight until no target is above its stop, which is one
water level: target = least(stop, level * weight).

All targets are cut into about ``BLOCKS`` equal blocks of words. Each block goes
to the source with the highest quotient target / (2k + 1), k being the blocks that
the source has; the ranked blocks are dealt to ``shards`` in turn, which gives every
shard an integer quota of each source. A source's documents, in a seeded order,
form a stream that is cut into n blocks of that size. A source's blocks, in an order by seeded
rank and up to ``REPEAT`` times over, are its picks; the shards take as many of them as their
quotas, one after the other.

A document's words taken are those of its parts in blocks, once for each shard that picked
the block. A document's place in the stream comes from sums inside hash ranges of a source plus
the sums of the ranges before, so a source with a third of the rows is spread over many tasks;
parts are as many as documents and blocks.

Null text has 0 words and is never taken. Rows that repeat a doc_id are separate documents;
rows that tie in the seeded order stand by doc_id and size. Texts of any length are counted
whole. Empty tables give no rows. Of ``df`` only doc_id, text and source are read by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, packed, small, unpacked

BLOCKS = 65_536
#: Blocks for each source at least, should there be many sources.
BLOCKS_A_SOURCE = 256
REPEAT = 3
SHARDS = 24
RANGE_ROWS = 32_768
WEIGHTS = (1, 2, 3)

_BEFORE = (Window.unboundedPreceding, -1)


def _source():
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(_s, source_size, target) from (_s, source_size): a row per source."""
    null_last = Window.orderBy(F.col("_s") == "n", "_s")
    ranked = sizes.withColumn("_r", F.row_number().over(null_last) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_w", weight).withColumn("_stop", F.col("source_size").cast("double") * REPEAT)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_stop") / F.col("_w"), "_s").rowsBetween(*_BEFORE)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(filling), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filling), F.lit(0.0))
    )
    return ranked.withColumn("_level", level).select(
        "_s", "source_size", F.least("_stop", F.max("_level").over(everything) * F.col("_w")).alias("target")
    )


def quotas(targets: DataFrame, block: int, n_sources: int, shards: int = 1) -> DataFrame:
    """(_s, shard, quota): blocks by the highest quotients, dealt to shards in turn."""
    targets = targets.withColumn("_total", F.sum("target").over(Window.partitionBy()))
    share = F.col("target") / F.lit(block)
    # Rounding of all sources moves the last quotient by half a block each at most.
    most = F.ceil(share + F.col("target") / F.greatest("_total", F.lit(1.0)) * F.lit(n_sources / 2)) + 1
    there = F.ceil(F.col("source_size") / F.lit(block)) * REPEAT
    seats = (
        targets.withColumn("_seats", F.round(F.col("_total") / F.lit(block)))
        .filter("target > 0")
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(most, there) - 1)))
        .withColumn("_q", F.col("target") / (2 * F.col("_k") + 1))
    )
    ranked = seats.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_q"), "_s", "_k")))
    return ranked.filter(F.col("_rank") <= F.col("_seats")).groupBy("_s", F.pmod(F.col("_rank") - 1, F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def block_table(targets: DataFrame, quota: DataFrame, block: int, seed: int) -> DataFrame:
    """(_s, _j, shards): for each block of a source the shards that picked it, one entry a pick."""
    along = Window.partitionBy("_s").orderBy("shard")
    ends = quota.withColumn("end", F.sum("quota").over(along)).groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"), F.sum("quota").alias("quota"))
    cut = targets.join(ends, "_s").withColumn("_n", F.ceil(F.col("source_size") / F.lit(block)))
    rows = cut.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    order = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed), "_s", "_j"), "_j")
    rows = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    picks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(REPEAT - 1)), lambda k: F.col("_rank") + k * F.col("_n")), lambda i: i < F.col("quota"))
    owner = lambda i: F.filter("ends", lambda e: e["end"] > i)[0]["shard"]
    return rows.withColumn("shards", F.transform(picks, owner)).filter(F.size("shards") > 0).select("_s", "_j", "shards")


def _taken(rows: DataFrame, n: int, seed: int, scratch: Scratch, weights: tuple[int, ...], shards: int) -> DataFrame:
    """Rows (doc_id, _s, size, _h, _g, _x) with source_size, target, taken and by_shard."""
    bits = max(0, min(24, math.ceil(math.log2(max(1, n / RANGE_ROWS)))))
    rows = rows.withColumn("_b", F.shiftrightunsigned(F.col("_h"), 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = scratch.write(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_words")), "ranges")
    sizes = ranges.groupBy("_s").agg(F.sum("_words").alias("source_size"))
    targets = scratch.write(source_targets(sizes, weights), "targets")
    n_sources, total = targets.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    blocks = max(BLOCKS, BLOCKS_A_SOURCE * n_sources)
    block = max(1, (total or 0) // blocks)
    table = scratch.write(block_table(targets.filter("target > 0"), quotas(targets, block, n_sources, shards), block, seed), "blocks")
    offsets = ranges.select("_s", "_b", F.coalesce(F.sum("_words").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size").rowsBetween(*_BEFORE)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_s", "_b"])
    placed = placed.withColumn("_x", F.col("_offset") + F.col("_before")).select("doc_id", "_s", "size", "_h", "_g", "_x")
    placed = scratch.write(placed, "placed")
    end = F.col("_x") + F.col("size")
    first, last = F.floor(F.col("_x") / block), F.floor((end - 1) / block)
    parts = placed.filter("size > 0").withColumn("_j", F.explode(F.sequence(first, last)))
    words = F.least(end, (F.col("_j") + 1) * block) - F.greatest(F.col("_x"), F.col("_j") * block)
    # Start and source name a document that has words.
    picked = parts.select("_s", "_x", "_j", words.alias("_words")).join(small(table, table.count(), 192), ["_s", "_j"])
    each = picked.select("_s", "_x", F.explode("shards").alias("shard"), "_words").repartition("_s", "_x")
    each = each.groupBy("_s", "_x", "shard").agg(F.sum("_words").alias("words"))
    found = each.groupBy("_s", "_x").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("by_shard")).withColumnsRenamed({"_s": "_fs", "_x": "_fx"})
    nothing = F.array().cast("array<struct<shard:int,words:bigint>>")
    joined = placed.join(found, F.expr("_s = _fs and _x = _fx and size > 0"), "left").drop("_fs", "_fx")
    joined = joined.withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "by_shard": F.coalesce("by_shard", nothing)})
    return joined.join(small(targets, n_sources), "_s")


def _prepared(df: DataFrame, seed: int) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _source().alias("_s"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "text", "source").alias("_g"),
    )


def mix(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, by_shard) for every row of ``df``.

    by_shard lists the words that each shard takes, repeats counted; taken is their sum.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(_prepared(df, seed), "rows")
    return _taken(rows, rows.count(), seed, scratch, weights, shards).select("doc_id", "size", "source_size", "target", "taken", "by_shard")


def mixed(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with the same columns.

    A row appears taken div size times, and once more with the probability that
    the rest is of its size, by a seeded hash; rows without words never appear.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(_prepared(df, seed), "rows")
    taken = _taken(rows, rows.count(), seed, scratch, weights, SHARDS)
    rest = F.pmod(F.col("taken"), F.greatest("size", F.lit(1))) / F.greatest("size", F.lit(1))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "_g", "_x"), 11) / F.lit(float(2**53))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1))) + (chance < rest).cast("long")).otherwise(0)
    counted = taken.select("_h", "_g", copies.alias("_c")).groupBy("_h", "_g").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_m"))
    counted = scratch.write(counted.filter("_c > 0"), "copies")
    keyed = packed(df, _h=F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), _g=F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"), F.col("source")))
    joined = keyed.join(counted, ["_h", "_g"])
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_i")
    once = joined.filter("_m = 1").select("_row", repeat)
    if counted.filter("_m > 1").take(1):
        once = once.unionByName(joined.filter("_m > 1").dropDuplicates(["_h", "_g"]).select("_row", repeat))
    return once.select(*unpacked(df.columns))
