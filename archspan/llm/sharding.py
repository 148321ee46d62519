"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of a 128-bit hash of their contents, so the
numbers do not depend on files, partitions or the order in which rows arrive. A
generalised Feistel network permutes the numbers: its state is a pair (left,
right) in Z_a x Z_b with a = ceil(sqrt N) and b = ceil(N / a), and a result of N
or more is permuted again until it is below N (cycle walking). a * b exceeds N by
less than a, so a walk is rare and has at most a steps; 512 are made,
which for larger a (b is about a) a walk exceeds with a chance of a**-512: then the job fails. Row n then goes to
shard perm(n) mod S, slot perm(n) div S: shard sizes differ by one row at most
and slots have no gaps, and both are computable from n alone.

Numbering takes one narrow shuffle: hashes are counted per distinct row with a
map-side combine (a row repeated for a third of the table is one counter), then
a window runs inside ranges of the hash space whose sizes are uniform. Ranges
hold about ``RANGE_ROWS`` rows at any table size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

RANGE_ROWS = 32_768
ROUNDS = 8
#: Copies of one row that are expanded by one task.
COPIES = 65_536


def _step(n: int, seed: int):
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def permute(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            left, right = s["l"], s["r"]
            mix_l = F.pmod(left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a).cast("long")), F.lit(a).cast("long"))
            mix_r = F.pmod(right + F.pmod(F.xxhash64(left, i, F.lit(seed)), F.lit(b).cast("long")), F.lit(b).cast("long"))
            return F.struct(
                F.when(i % 2 == 0, mix_l).otherwise(left).alias("l"),
                F.when(i % 2 == 1, mix_r).otherwise(right).alias("r"),
            )

        start = F.struct((x % F.lit(a).cast("long")).alias("l"), F.floor(x / F.lit(a)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])

    return a, permute


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """Position of row ``number`` (long, 0 to n-1) in the shuffled order, 0 to n-1."""
    if n >= 2**52:
        raise ValueError("row numbers of 2**52 and more are not supported")
    a, permute = _step(n, seed)
    limit = F.lit(n).cast("long")
    first = permute(number)
    # A walk stays among fewer than a values outside the range before it returns.
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(a, 512))),
        first,
        lambda v, _: F.when(v >= limit, permute(v)).otherwise(v),
    )
    stuck = F.raise_error(F.lit("a walk of the permutation did not end")).cast("long")
    return F.when(first < limit, first).when(walk < limit, walk).otherwise(stuck)


def _hashable(df: DataFrame) -> list[Column]:
    """Columns for xxhash64, which takes no maps: those count as JSON text."""
    return [F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]


def row_starts(keys: DataFrame, n: int) -> DataFrame:
    """For (_h, _g) of every row: copies ``_m`` and the number ``_n`` of the first copy."""
    bits = max(0, min(24, math.ceil(math.log2(max(1, n / RANGE_ROWS)))))
    span = F.shiftrightunsigned(F.col("_h"), 64 - bits) if bits else F.lit(0).cast("long")
    counted = keys.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_m")).withColumn("_b", span)
    sizes = counted.groupBy("_b").agg(F.sum("_m").alias("_size"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # 2**24 ranges at most, one small row each: a bounded broadcast.
    offsets = sizes.select("_b", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_b").orderBy("_h", "_g").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("_before", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
        .join(F.broadcast(offsets) if 2**bits <= 65_536 else offsets, "_b")
        .select("_h", "_g", "_m", (F.col("_offset") + F.col("_before")).alias("_n"))
    )


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long).

    Every column, null ones included, takes part in the order; columns named
    shard or slot in any letter case are replaced. Repeated rows get different
    numbers, in no particular order among them. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = without(df, "shard", "slot")
    columns = df.columns
    packed = df.select(
        F.xxhash64(*_hashable(df)).alias("_h"),
        F.xxhash64(F.lit(seed + 1), *_hashable(df)).alias("_g"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
    )
    n = df.count()
    starts = row_starts(packed.select("_h", "_g"), n)
    narrow = all(t in ("bigint", "int", "double", "boolean", "date") for _, t in df.dtypes)
    if narrow:
        # The row itself rides along with its counter: no join back.
        ridden = _narrow(packed, n)
    else:
        joined = packed.join(starts, ["_h", "_g"])
        once = joined.filter("_m = 1").select("_row", "_n")
        many = joined.filter("_m > 1").groupBy("_h", "_g").agg(F.any_value("_row").alias("_row"), F.any_value("_m").alias("_m"), F.any_value("_n").alias("_n"))
        ridden = once.unionByName(_copies(many))
    place = ridden.select("_row", permuted(F.col("_n"), n, seed).alias("_p"))
    return place.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
    )


def _narrow(packed: DataFrame, n: int) -> DataFrame:
    bits = max(0, min(24, math.ceil(math.log2(max(1, n / RANGE_ROWS)))))
    span = F.shiftrightunsigned(F.col("_h"), 64 - bits) if bits else F.lit(0).cast("long")
    counted = packed.groupBy("_h", "_g", "_row").agg(F.count(F.lit(1)).alias("_m")).withColumn("_b", span)
    sizes = packed.groupBy(span.alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_b").orderBy("_h", "_g", "_row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        counted.withColumn("_before", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
        .join(F.broadcast(offsets) if 2**bits <= 65_536 else offsets, "_b")
        .select("_row", "_m", (F.col("_offset") + F.col("_before")).alias("_n"))
    )
    return _copies(numbered)


def _copies(rows: DataFrame) -> DataFrame:
    """(_row, _n) for every copy of (_row, _m, _n), in blocks, so that no array is long."""
    blocks = rows.select("_row", "_m", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / COPIES))).alias("_k"))
    last = F.least(F.col("_m"), (F.col("_k") + 1) * COPIES) - 1
    return blocks.select("_row", "_n", F.explode(F.sequence(F.col("_k") * COPIES, last)).alias("_j")).select("_row", (F.col("_n") + F.col("_j")).alias("_n"))
