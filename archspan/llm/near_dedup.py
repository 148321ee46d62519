"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Shingles are five words (lower-cased A-Z, cut at ASCII punctuation). A shingle's
weight in a document is (1 + ln tf) * min(idf, the median idf of the document's
shingles), with idf = ln(1 + N / df): what many documents share counts little in a
document of its own, and no shingle counts more than the document's typical one. Without
that bound the rare edits of a copy would outweigh all that a group shares once the
group holds a good part of the table; with it, copies in groups of any size are as
similar as in a pair.

1. Document frequencies: every task adds its documents to a count-min sketch of
   fixed size; sketches are summed part by part as streams, in two levels. A document adds
   about its number of distinct shingles to a row of 2**20 counters, so the
   sketch's error is the same share of N at any N; df counts as N / ``CLIP`` at least.
2. Texts: one row per distinct text (128-bit md5), so exact copies cost one
   counter each and meet in a map-side combine.
3. Samples: ``BANDS * ROWS`` improved consistent weighted samples a text, hashed in
   bands. Texts that share a band form a bucket. All members of a bucket are
   compared with two leaders of it, both likely to be the original among its
   edited copies, whose copies need not be alike: the text whose shingles are most
   frequent (an edit makes rare ones; tells in large groups), and the text that shares
   most buckets with others (tells in small ones). So the copies of a large group
   are one component before any pairs are made.
4. Verification: exact weighted Jaccard of the two whole texts, at least ``SIMILARITY``.
   Then every pair of a bucket that the leaders left in different components is
   decided: a bucket's members are dealt to blocks of about ``BLOCK``, large components to
   blocks of their own, and every two blocks with different components are compared as a
   whole. A bound that never falls below the similarity picks the pairs to verify. Pairs of one
   component are not compared, so work is linear in the copies of a text and
   quadratic only in members of one bucket that are no copies of each other.
5. Classes: connected components of the links by least labels with pointer
   jumping; each step is a written table.

Null text counts as empty text. Texts without a word are copies only of equal
texts. A class is named by its least doc_id (null if none has one).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import Scratch, packed, ship, small, unpacked

SIMILARITY = 0.8
WIDTH = 5
BANDS, ROWS = 14, 4
#: Members and bytes of text of a block, about.
BLOCK, BLOCK_BYTES = 128, 1 << 22
#: Shingles that are compared at a time.
COLUMNS = 4096
#: Count-min sketch of document frequencies.
SKETCH_ROWS, SKETCH_BITS = 2, 20
PARTS = 16
#: First-level sums of a part of the sketch.
LANES = 64
CLIP = 4096.0
GROUP_BYTES = 1 << 19
U = np.uint64


def _slots(shingle: np.ndarray, row: int) -> np.ndarray:
    return (textbytes.mix(shingle * textbytes._ODD[30 + row]) >> U(64 - SKETCH_BITS)).astype(np.int64)


def _key(text="text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def frequencies(docs: DataFrame) -> np.ndarray:
    """ln(1 + N / df) of every counter, as float32 of shape (SKETCH_ROWS, 2**SKETCH_BITS)."""
    size = 1 << SKETCH_BITS
    step = size // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH_ROWS, size), np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in textbytes.groups(batch.column(0), GROUP_BYTES):
                _, shingle, _ = textbytes.shingles(data, offsets, WIDTH)
                for row in range(SKETCH_ROWS):
                    np.add.at(total[row], _slots(shingle, row), 1)
        if n:
            flat = total.reshape(SKETCH_ROWS * PARTS, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(flat)), pa.int32()), pa.array([n] * len(flat), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in flat], pa.binary())],
                names=["part", "n", "counts"],
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, np.ndarray], dict[int, int]]:
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            for part, n, counts in zip(batch.column("part"), batch.column("n"), batch.column("counts"), strict=True):
                got = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                key = part.as_py()
                sums[key] = sums[key] + got if key in sums else got
                seen[key] = seen.get(key, 0) + n.as_py()
        return sums, seen

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = summed(batches)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen[part]], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "n", "counts"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = summed(batches)
        for part, total in sums.items():
            n = max(seen[part], 1)
            idf = np.log1p(n / np.maximum(total, n / CLIP))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([idf.astype(np.float32).tobytes()], pa.binary())], names=["part", "idf"])

    sketches = docs.select("text").mapInArrow(count, "part int, n long, counts binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    lanes = sketches.repartition("part", "lane").select("part", "n", "counts").mapInArrow(add, "part int, n long, counts binary")
    parts = lanes.repartition("part").mapInArrow(end, "part int, idf binary")
    out = np.zeros((SKETCH_ROWS * PARTS, step), np.float32)
    for part, idf in parts.collect():  # 8 MB at any input size
        out[part] = np.frombuffer(idf, np.float32)
    return out.reshape(SKETCH_ROWS, size)


def _idf(shingle: np.ndarray, table: np.ndarray) -> np.ndarray:
    idf = table[0][_slots(shingle, 0)]
    for row in range(1, SKETCH_ROWS):  # the least df is the best estimate
        idf = np.maximum(idf, table[row][_slots(shingle, row)])
    return idf


def _weights(doc: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of shingles that are grouped by ``doc``, numbers below 2**20."""
    if not len(doc):
        return np.zeros(0, np.float32)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[starts, len(doc)])
    middle = np.sort(doc * 16.0 + idf)[starts + (n - 1) // 2] - doc[starts] * 16.0  # exact: idf is float32 and below 16
    return ((1 + np.log(count)) * np.minimum(idf, np.repeat(middle, n))).astype(np.float32)


def _uniform(bits: np.ndarray, width: int) -> np.ndarray:
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-width)


def weighted_samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-th consistent weighted sample of each segment of shingles."""
    seed = U(int(textbytes._ODD[40]) * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)
    one = textbytes.mix(shingle ^ seed)
    two = textbytes.mix(one + textbytes._ODD[41])
    gamma_c = -np.log(_uniform((one >> U(40)), 24) * _uniform(one >> U(16) & U(0xFFFFFF), 24))
    r = -np.log(_uniform(two >> U(43), 21) * _uniform(two >> U(22) & U(0x1FFFFF), 21))
    beta = _uniform(two & U(0x3FFFFF), 22)
    t = np.floor(np.log(weight) / r + beta)
    value = np.log(gamma_c) - r * (t - beta + np.float32(1))
    counts = np.diff(np.r_[starts, len(shingle)])
    least = np.minimum.reduceat(value, starts)
    at = np.flatnonzero(value == np.repeat(least, counts))
    owner = np.searchsorted(starts, at, "right")
    at = at[np.r_[True, owner[1:] != owner[:-1]]]
    return textbytes.mix(shingle[at] * textbytes._ODD[42] + t[at].astype(np.int64).astype(U) * textbytes._ODD[43] + seed)


def _bands(column: pa.Array, table: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Band hashes of every text (null for texts without a word), and how frequent its shingles are."""
    out = np.zeros((len(column), BANDS), U)
    has = np.zeros(len(column), bool)
    common = np.zeros(len(column))
    for lo, _, data, offsets in textbytes.groups(column, GROUP_BYTES):
        doc, shingle, count = textbytes.shingles(data, offsets, WIDTH)
        if not len(doc):
            continue
        idf = _idf(shingle, table)
        weight = _weights(doc, count, idf)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = lo + doc[starts]
        has[rows] = True
        common[rows] = -np.add.reduceat(idf.astype(np.float64), starts) / np.diff(np.r_[starts, len(doc)])
        for band in range(BANDS):
            h = np.full(len(rows), band + 1, U) * textbytes._ODD[44]
            for j in range(ROWS):
                h = textbytes.mix(h + weighted_samples(shingle, weight, starts, band * ROWS + j))
            out[rows, band] = h
    values = pa.array(out.view(np.int64).ravel())
    flat = pa.FixedSizeListArray.from_arrays(values, BANDS).cast(pa.list_(pa.int64()))
    return pa.compute.if_else(pa.array(has), flat, pa.scalar(None, flat.type)), pa.array(common)


def banded(rows: DataFrame, table) -> DataFrame:
    """Columns other than text, and ``bands`` and ``common``."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _bands(batch.column(batch.schema.get_field_index("text")), table.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *made], names=[*kept, "bands", "common"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("bands", T.ArrayType(T.LongType())).add("common", T.DoubleType()))


def similarity(left: pa.Array, right: pa.Array, table: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts row by row; 0 if either has no word."""
    out = np.zeros(len(left))
    sizes = pa.compute.fill_null(pa.compute.binary_length(left), 0).to_numpy(zero_copy_only=False) + pa.compute.fill_null(pa.compute.binary_length(right), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // (2 * GROUP_BYTES)
    edges = np.flatnonzero(np.r_[True, np.diff(group) > 0]).tolist()
    cuts = sorted({*edges, *range(0, len(left), textbytes.GROUP_DOCS), len(left)})
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        sides = []
        for column in (left, right):
            parts = []
            for at, _, data, offsets in textbytes.groups(column.slice(lo, hi - lo), 1 << 62):
                doc, shingle, count = textbytes.shingles(data, offsets, WIDTH)
                parts.append(((doc + at).astype(U) << U(52) | shingle, _weights(doc, count, _idf(shingle, table)).astype(np.float64)))
            sides.append([np.concatenate(x) for x in zip(*parts, strict=True)])
        (ka, wa), (kb, wb) = sides
        total = np.bincount((ka >> U(52)).astype(np.int64), wa, hi - lo) + np.bincount((kb >> U(52)).astype(np.int64), wb, hi - lo)
        both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        shared = np.bincount((both >> U(52)).astype(np.int64), np.minimum(wa[ia], wb[ib]), hi - lo)
        out[lo:hi] = np.divide(shared, total - shared, out=np.zeros(hi - lo), where=total > shared)
        out[lo:hi][(total > 0) & (total - shared <= 0)] = 1.0
    return out


def _pairs(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of bucket members and the two leaders of their bucket; and the other members (band, tkey, bytes)."""
    flat = texts.filter("bands is not null").select("tkey", "common", "bytes", F.explode("bands").alias("band"))
    sizes = flat.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("tkey").alias("_lo"), F.max("tkey").alias("_hi")).filter("_lo <> _hi").select("band", "size")
    members = scratch.write(flat.join(sizes, "band"), "members")
    score = members.groupBy("tkey").agg(F.sum("size").alias("score"))
    scored = members.select("band", "tkey", "common").join(score, "tkey")
    leaders = scored.groupBy("band").agg(F.max(F.struct("common", "score", "tkey")).alias("first"), F.max(F.struct("score", "common", "tkey")).alias("second"))
    led = leaders.select("band", F.col("first.tkey").alias("_one"), F.col("second.tkey").alias("_two"))
    both = members.select("band", "tkey", "bytes").join(led, "band")
    pairs = (
        both.select("tkey", F.explode(F.array("_one", "_two")).alias("_l"))
        .filter("tkey <> _l")
        .select(F.least("tkey", "_l").alias("a"), F.greatest("tkey", "_l").alias("b"))
        .distinct()
    )
    return pairs, both.filter("tkey <> _one and tkey <> _two").select("band", "tkey", "bytes")


def _blocks(followers: DataFrame, labels: DataFrame, n_labels: int, scratch: Scratch) -> DataFrame:
    """(task, side, tkey, label): two blocks of a bucket for every task, or one that is compared with itself (side 2)."""
    named = followers.join(small(labels.withColumnRenamed("node", "tkey"), n_labels), "tkey", "left").withColumn("label", F.coalesce("label", "tkey"))
    enough = lambda n, size: F.ceil(F.greatest(F.sum(n) / BLOCK, F.sum(size) / BLOCK_BYTES)).cast("int")
    held = scratch.write(named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).withColumn("large", (F.col("n") * 2 >= BLOCK) | (F.col("size") * 2 >= BLOCK_BYTES)), "held")
    few = lambda c: F.when(F.col("large"), F.lit(0)).otherwise(F.col(c))
    buckets = held.groupBy("band").agg(enough(few("n"), few("size")).alias("lanes"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("band", "lanes")
    spread = F.xxhash64("label")
    lane = F.when(F.col("large"), F.bitwise_not(F.shiftrightunsigned(spread, 1))).otherwise(F.pmod(spread, F.greatest("lanes", F.lit(1))))
    lanes = held.join(buckets, "band").select("band", "label", lane.alias("lane"))
    laned = scratch.write(named.join(lanes, ["band", "label"]), "laned")
    parts = laned.groupBy("band", "lane").agg(enough(F.lit(1), "bytes").alias("parts"))
    dealt = laned.join(parts, ["band", "lane"]).withColumn("block", F.struct("lane", F.pmod(F.xxhash64("tkey"), "parts").cast("int").alias("part")))
    dealt = scratch.write(dealt.select("band", "block", "tkey", "label"), "dealt")
    held = dealt.groupBy("band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    one, two = (held.select("band", *[F.col(c).alias(f"{c}{i}") for c in ("block", "lo", "hi")]) for i in (1, 2))
    tasks = one.join(two, "band").filter("block1 <= block2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    task = F.xxhash64("band", "block1", "block2")
    own = F.struct(F.col("block1").alias("block"), F.lit(2).alias("side"))
    two_sided = F.array(F.struct(F.col("block1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(1).alias("side")))
    sides = tasks.select("band", task.alias("task"), F.explode(F.when(F.col("block1") == F.col("block2"), F.array(own)).otherwise(two_sided)).alias("_s"))
    return sides.select("band", "task", "_s.block", "_s.side").join(dealt, ["band", "block"]).select("task", "side", "tkey", "label")


def may_reach(texts: pa.Array, left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether row i of ``left`` and row j of ``right`` (rows of ``texts``) can be of ``SIMILARITY``; never False for two rows that are.

    The lesser of two weights is at most the root of their product, so products of
    vectors of roots bound what two texts share.
    """
    made = []
    for lo, _, data, offsets in textbytes.groups(texts, GROUP_BYTES):
        doc, shingle, count = textbytes.shingles(data, offsets, WIDTH)
        made.append((doc + lo, shingle, _weights(doc, count, _idf(shingle, table))))
    doc, shingle, weight = (np.concatenate(x) for x in zip(*made, strict=True))
    total = np.bincount(doc, weight, len(texts))
    _, code, df = np.unique(shingle, return_inverse=True, return_counts=True)
    met = (df > 1)[code]
    code = (np.cumsum(df > 1) - 1)[code[met]]
    order = np.argsort(code, kind="stable")
    doc, code, root = doc[met][order], code[order], np.sqrt(weight[met][order])
    shared = np.zeros((len(left), len(right)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (lo, lo + COLUMNS))
        dense = np.zeros((len(texts), int(code[b - 1]) - lo + 1), np.float32)
        dense[doc[a:b], code[a:b] - lo] = root[a:b]
        shared += dense[left] @ dense[right].T
    least = SIMILARITY / (1 + SIMILARITY) * (total[left][:, None] + total[right][None, :])
    return shared >= least * (1 - 1e-4)


def _met(blocks: DataFrame, texts: DataFrame, table) -> DataFrame:
    """(a, b, similarity) of the near copies among the blocks of every task."""

    def near(rows: list[tuple]) -> pa.RecordBatch:
        keys, text = [r[2] for r in rows], pa.array([r[4] for r in rows], pa.string())
        side = np.array([r[1] for r in rows])
        _, label = np.unique(np.array([r[3] for r in rows], object), return_inverse=True)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        reach = may_reach(text, left, right, table.value) & (label[left][:, None] != label[right][None, :])
        i, j = np.nonzero(reach)
        i, j = left[i], right[j]
        once = (i < j) | (side[i] == 0)
        i, j = i[once], j[once]
        s = similarity(text.take(pa.array(i)), text.take(pa.array(j)), table.value)
        found = [(min(keys[x], keys[y]), max(keys[x], keys[y]), z) for x, y, z in zip(i[s >= SIMILARITY], j[s >= SIMILARITY], s[s >= SIMILARITY], strict=True)]
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and rows[0][0] != row[0]:
                    yield near(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield near(rows)

    whole = blocks.join(texts, "tkey").select("task", "side", "tkey", "label", "text").repartition("task").sortWithinPartitions("task")
    return whole.mapInArrow(run, "a binary, b binary, similarity double")


def _fetch(docs: DataFrame, keys: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """(tkey, text) of the texts in ``keys`` (tkey, first_id): one document of each is read out."""
    found = docs.join(small(keys, n), (docs.tkey == keys.tkey) & docs.doc_id.eqNullSafe(keys.first_id)).select(docs.tkey, docs.text)
    return scratch.write(found.groupBy("tkey").agg(F.first("text").alias("text")), name)


def _verified(pairs: DataFrame, texts: DataFrame, table) -> DataFrame:
    left = texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = similarity(batch.column(2), batch.column(3), table.value)
            near = pa.array(s >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(s[s >= SIMILARITY])], names=["a", "b", "similarity"])

    sides = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return sides.mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame, scratch: Scratch, name: str = "all") -> DataFrame:
    """(node, label): least node of each connected component of links (a, b)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = scratch.write(both, f"{name}_edges")
    labels = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), f"{name}0")
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        nearer = labels.join(heard.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        after = scratch.write(after, f"{name}{turn}")
        moved = after.filter("label <> old").count()
        labels = after.select("node", "label")
        if turn > 1:
            scratch.drop(f"{name}{turn - 2}")
        if not moved:
            return labels


def _resolve(df: DataFrame) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """(scratch, documents (doc_id, tkey), texts with their class ``label``, links)."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    table = spark.sparkContext.broadcast(frequencies(docs))
    keyed = docs.withColumn("tkey", _key())
    sized = keyed.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    signed = scratch.write(banded(sized, table), "signed")
    texts = scratch.write(signed.groupBy("tkey").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("common").alias("common")), "texts")
    links = spark.createDataFrame([], "a binary, b binary, similarity double")
    pairs, followers = _pairs(texts, scratch)
    pairs = scratch.write(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("tkey")).union(pairs.select(F.col("b").alias("tkey"))).distinct()
    keys = scratch.write(ends.join(texts.select("tkey", "first_id"), "tkey"), "keys")
    n = keys.count()
    if n:
        fetched = _fetch(keyed, keys, n, scratch, "fetched")
        links = scratch.write(_verified(pairs, fetched, table), "links")
    labels = components(links, scratch)
    if n:
        blocks = scratch.write(_blocks(followers, labels, labels.count(), scratch), "blocks")
        more = scratch.write(_met(blocks, fetched, table).groupBy("a", "b").agg(F.first("similarity").alias("similarity")), "more")
        if more.take(1):
            links = links.unionByName(more)
            labels = components(links, scratch, "met")
    n_labels = labels.count()
    joined = texts.select("tkey", "first_id", "copies").join(small(labels.withColumnRenamed("node", "tkey"), n_labels), "tkey", "left")
    classes = scratch.write(joined.withColumn("label", F.coalesce("label", "tkey")), "classes")
    for name in ("texts", "members", "pairs", "keys", "fetched", "held", "laned", "dealt", "blocks", "met_edges", "all_edges"):
        scratch.drop(name)
    return scratch, signed.select("doc_id", "tkey"), classes, links


def classes(df: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_docs, n_links, kept) for every row of ``df``.

    class_id is the least doc_id of the class, class_docs its number of rows,
    n_links the number of verified links of the row's text to other texts. kept
    marks the rows with the class's least doc_id.
    """
    scratch, docs, texts, links = _resolve(df)
    groups = texts.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_docs"))
    degree = links.select(F.explode(F.array("a", "b")).alias("tkey")).groupBy("tkey").agg(F.count(F.lit(1)).alias("n_links"))
    named = texts.join(groups, "label").join(degree, "tkey", "left").select("tkey", "class_id", "class_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = scratch.write(named, "named")
    return docs.join(named, "tkey").select("doc_id", "class_id", "class_docs", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without near duplicates: exactly one row of each class.

    The row with the least doc_id stays (null ids last); among repeated rows of
    that doc_id and text, any one.
    """
    scratch, docs, texts, _ = _resolve(df)
    order = F.struct(F.col("first_id").isNull().alias("n"), F.coalesce("first_id", F.lit(0)).alias("i"), "tkey")
    best = texts.groupBy("label").agg(F.min(order).alias("best"))
    marked = scratch.write(texts.join(best, "label").select("tkey", "first_id", (F.col("best.tkey") == F.col("tkey")).alias("stays")), "marked")
    rows = docs.groupBy("tkey", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    fate = rows.join(marked, "tkey").select("tkey", "doc_id", "n", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("stays"))
    apart = scratch.write(fate.filter("not stays or n > 1").select(F.col("tkey").alias("_k"), F.col("doc_id").alias("_d"), "stays"), "apart")
    n = apart.count()
    keyed = packed(df, _tkey=_key(), _id=F.col("doc_id").cast("long"))
    same = (keyed["_tkey"] == F.col("_k")) & keyed["_id"].eqNullSafe(F.col("_d"))
    plain = keyed.join(small(apart, n), same, "left_anti").select(*unpacked(df.columns))
    again = apart.filter("stays")
    if n and (m := again.count()):
        one = keyed.join(small(again, m), same, "left_semi").dropDuplicates(["_tkey", "_id"]).select(*unpacked(df.columns))
        return plain.unionByName(one)
    return plain
