"""Benchmark decontamination by suffix arrays over shards of the training text.

Each group of documents that a task holds is a shard. Words of the shard become
ids in the benchmark's vocabulary (0 for any other word, which no benchmark
suffix can match), runs of known words that are too short for any window are left out,
and the rest is sorted into a suffix array by prefix doubling. Every distinct window
of the benchmark's suffixes is then binary-searched: the search narrows the array's
interval one word at a time, so the interval at a window's length holds all places
where the window occurs. Intervals of distinct windows of one length do not overlap, so a
shard has at most as many finds as words for each length, however often items or
documents repeat themselves.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter
item. ``matches`` lists, by item, the longest runs of document words whose every window
occurs in the item, and where in the item the first of them does first.

Items are a query set: they are written once in blocks of about ``BLOCK_BYTES`` of
text. The documents pass once for each block; between two blocks they are a written
table, so the driver and a task hold one block at a time. One block is the usual case:
then the pass is narrow, without a shuffle and without a written table.

Null texts have no words. Items without words have no windows; an item whose id
is null counts words as hit but is not listed. Items that repeat an id count as
one item. A document without words is never contaminated. Texts of any length are searched
whole; a document longer than ``SHARD_BYTES`` is a shard of its own. Rows that repeat are
judged alike. Columns that clash with added ones are replaced, or kept with ``only_clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import Scratch, ship, without

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
#: Pairs of (window, item) that are held at a time.
PAIRS = 1 << 20
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches")


class Items:
    """Vocabulary and distinct windows of one block of items.

    Window k is the ``length[k]`` words from ``rep[k]`` on; the items that hold it are
    ``owner[first[k]:first[k + 1]]``, first at their words ``place[...]``.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        column = pa.array([text for _, text in rows], pa.string())
        hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo, _, data, offsets in textbytes.groups(column, BLOCK_BYTES):
            starts, ends, first = textbytes.spans(data, offsets)
            hashes.append(textbytes.word_hashes(data, starts, ends))
            n = np.diff(first)
            owners.append((np.repeat(np.arange(len(n)), n) + lo).astype(np.int32))
            places.append((np.arange(len(starts)) - np.repeat(first[:-1], n)).astype(np.int32))
        self.vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        self.words = (ids + 1).astype(np.int32)
        owner, place = np.concatenate(owners), np.concatenate(places)
        own = np.bincount(owner, minlength=len(rows))[owner] if len(owner) else np.zeros(0, np.int64)
        #: Words of the window that starts at a suffix; 0 where none does.
        size = np.where(own >= window, np.where(own - place >= window, window, 0), np.where(place == 0, own, 0))
        #: Number of an item's id in the order of ids; -1 for null.
        self.ids = sorted({i for i, _ in rows if i is not None})
        number = {i: k for k, i in enumerate(self.ids)} | {None: -1}
        code = np.array([number[i] for i, _ in rows], np.int32)
        reps, lengths, firsts, held, where = [], [], [np.zeros(1, np.int64)], [], []
        for length in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == length)
            _, kind = np.unique(_window_ranks(self.words, at, length), return_inverse=True)
            order = np.lexsort((place[at], code[owner[at]], kind))
            kind, at = kind[order], at[order]
            fresh = np.r_[True, (np.diff(kind) != 0) | (np.diff(code[owner[at]]) != 0)]
            kind, at = kind[fresh], at[fresh]
            edge = np.flatnonzero(np.r_[True, np.diff(kind) != 0])
            reps.append(at[edge])
            lengths.append(np.full(len(edge), length))
            firsts.append(np.r_[edge[1:], len(kind)] + firsts[-1][-1])
            held.append(code[owner[at]])
            where.append(place[at])
        none = np.zeros(0, np.int64)
        self.rep, self.length, self.owner, self.place = (np.concatenate([none, *x]).astype(np.int32) for x in (reps, lengths, held, where))
        self.first = np.concatenate(firsts)
        self.shortest = int(self.length.min(initial=1 << 30)) if len(self.length) else 0
        self.depth = int(self.length.max(initial=0))


def _window_ranks(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal windows of ``length`` words, which start at ``at``."""
    rank, width = words.astype(np.int64), 1
    while width * 2 <= length:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:]
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + ahead, return_inverse=True)
        width *= 2
    return rank[at] * (rank.max(initial=0) + 1) + rank[at + length - width]


def suffix_array(z: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``z`` with a word (not 0), sorted by their next ``depth`` words at least."""
    rank = z.copy()
    width = 1
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:]
        ahead[rank == 0] = 0
        pair = rank * (rank.max(initial=0) + 1) + ahead
        _, rank = np.unique(pair, return_inverse=True)
        if z.min(initial=1) > 0:
            rank = rank + 1
        width *= 2
    places = np.flatnonzero(z)
    return places[np.argsort(rank[places], kind="stable")]


def _bound(z, sa, at, lo, hi, key, after: bool):
    """First index of [lo, hi) whose word at offset ``at`` is >= key (> key with ``after``)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        word = z[sa[np.minimum(mid, len(sa) - 1)] + at]
        right = open_ & ((word <= key) if after else (word < key))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def occurrences(z: np.ndarray, sa: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(window, place in ``z``) for every occurrence of a distinct window.

    ``z`` must be followed by ``items.depth`` zeros, which the caller adds.
    """
    window = np.arange(len(items.rep))
    lo, hi = np.zeros(len(window), np.int64), np.full(len(window), len(sa))
    found_w, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(items.depth):
        key = items.words[items.rep[window] + at]
        left = _bound(z, sa, at, lo, hi, key, False)
        right = _bound(z, sa, at, left, hi, key, True)
        stay = right > left
        window, lo, hi = window[stay], left[stay], right[stay]
        end = items.length[window] == at + 1
        if end.any():
            n = (hi - lo)[end]
            found_w.append(np.repeat(window[end], n))
            found_p.append(sa[np.repeat(lo[end] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            window, lo, hi = window[~end], lo[~end], hi[~end]
        if not len(window):
            break
    return np.concatenate(found_w), np.concatenate(found_p)


def _runs(doc: np.ndarray, word: np.ndarray, window: np.ndarray, items: Items) -> Iterator[tuple]:
    """(doc, item, item word, first word, end) of longest runs; a run may come in pieces."""
    order = np.lexsort((word, doc))
    doc, word, window = doc[order], word[order], window[order]
    n = items.first[window + 1] - items.first[window]
    cuts = np.r_[np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=-1)), len(n)]
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        m = n[a:b]
        pair = np.repeat(items.first[window[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        back = np.repeat(np.arange(a, b), m)
        item = items.owner[pair]
        order = np.lexsort((items.length[window[back]], word[back], item, doc[back]))
        pair, back, item = pair[order], back[order], item[order]
        d, w = doc[back], word[back]
        head = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(item) != 0) | (np.diff(w) > 1)])
        end = np.maximum.reduceat(w + items.length[window[back]], head)
        yield from zip(d[head].tolist(), item[head].tolist(), items.place[pair[head]].tolist(), w[head].tolist(), end.tolist(), w[np.r_[head[1:], len(d)] - 1].tolist(), strict=True)


def _shard_matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, dict[int, list[dict]]]:
    """Words per document of the shard, and its longest matches by document."""
    starts, ends, first = textbytes.spans(data, offsets)
    n_words = np.diff(first)
    if not len(starts) or not items.shortest:
        return n_words, {}
    h = textbytes.word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    ids = np.where(items.vocabulary[at] == h, at + 1, 0)
    known = np.flatnonzero(ids)
    if not len(known):
        return n_words, {}
    doc = np.searchsorted(first, known, "right") - 1
    breaks = np.flatnonzero(np.r_[True, (np.diff(known) > 1) | (np.diff(doc) > 0)])
    length = np.diff(np.r_[breaks, len(known)])
    keep = np.repeat(length >= items.shortest, length)
    known, doc = known[keep], doc[keep]
    if not len(known):
        return n_words, {}
    head = np.r_[True, (np.diff(known) > 1) | (np.diff(doc) > 0)]
    spot = np.arange(len(known)) + np.cumsum(head) - 1  # a 0 between runs
    z = np.zeros(int(spot[-1]) + 2 + items.depth, np.int64)
    z[spot] = ids[known]
    back = np.zeros(len(z), np.int64)
    back[spot] = np.arange(len(known))
    window, place = occurrences(z, suffix_array(z, items.depth), items)
    where = back[place]
    d = doc[where]
    out: dict[int, list[dict]] = {}
    open_: dict[tuple[int, int], tuple[dict, int]] = {}
    for i, item, item_word, begin, end, last in _runs(d, known[where] - first[:-1][d], window, items):
        before = open_.get((i, item))
        if before and begin <= before[1] + 1:  # a piece that continues
            found = before[0]
            found["n_words"] = max(found["n_words"], end - found["doc_word"])
        else:
            found = {"item_id": items.ids[item] if item >= 0 else None, "item_word": item_word, "doc_word": begin, "n_words": end - begin}
            out.setdefault(i, []).append(found)
        open_[i, item] = (found, last)
    return n_words, out


def _verdict(n: int, found: list[dict]) -> tuple[int, int, str, bool]:
    edges = sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in found)
    hit, reach = 0, 0
    for a, b in edges:
        hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    ids = sorted({m["item_id"] for m in found} - {None})
    return hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n


def item_blocks(items: DataFrame, scratch: Scratch) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items as (id as text, text), block by block; a block is of a bounded size of text."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-(total[0] + 64 * total[1]) // (BLOCK_BYTES // 2)))
    if n == 1:
        yield [tuple(r) for r in rows.collect()]
        return
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
    held = scratch.write(rows.withColumn("block", part).repartition("block"), "items")
    for k in range(n):
        yield [tuple(r) for r in held.filter(F.col("block") == k).select("item_id", "text").collect()]
    scratch.drop("items")


def decontaminate(df: DataFrame, items: DataFrame, keep_text: bool = True, only_clean: bool = False) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256, contaminated and matches.

    matches lists the longest verbatim matches: item, its first word, the
    document's first word and the number of words. With ``only_clean`` the
    affected documents are removed and just the columns of ``df`` return.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    clash = [c for c in df.columns if c.lower() in ADDED] if only_clean else []
    base = df.select(*[F.col(f"`{c}`").alias(f"_kept_{c}" if c in clash else c) for c in df.columns]) if only_clean else without(df, *ADDED)
    blocks = item_blocks(items, scratch)
    block, turn = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        base = _pass(base, Items(block), turn > 0, after is None, keep_text or after is not None, only_clean)
        if after is not None:
            base = scratch.write(base, f"pass{turn}")
            if turn:
                scratch.drop(f"pass{turn - 1}")
        block, turn = after, turn + 1
    if not only_clean:
        return base
    return base.select(*[F.col(f"`_kept_{c}`" if c in clash else f"`{c}`").alias(c) for c in df.columns])


def _pass(df: DataFrame, items: Items, more: bool, last: bool, keep_text: bool, only_clean: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    kept = [c for c in df.columns if c != "matches" and (keep_text or c != "text")]
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    final = last and not only_clean
    if final:
        for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")):
            schema = schema.add(name, kind)
    if not (last and only_clean):
        schema = schema.add("matches", MATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            before = batch.column(batch.schema.get_field_index("matches")) if more else None
            for lo, hi, data, offsets in textbytes.groups(text, SHARD_BYTES):
                n_words, found = _shard_matches(data, offsets, own)
                if before is not None:
                    for i, old in enumerate(before.slice(lo, hi - lo).to_pylist()):
                        if old:
                            found[i] = old + found.get(i, [])
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                names = list(kept)
                size = hi - lo
                if last:
                    hit, count, digest = np.zeros(size, np.int64), np.zeros(size, np.int64), [nothing] * size
                    tainted = np.zeros(size, bool)
                    for i, matches in found.items():
                        hit[i], count[i], digest[i], tainted[i] = _verdict(int(n_words[i]), matches)
                if last and only_clean:
                    clean = pa.array(~tainted)
                    yield pa.RecordBatch.from_arrays([a.filter(clean) for a in arrays], names=names)
                    continue
                if last:
                    arrays += [pa.array(n_words.astype(np.int64)), pa.array(hit), pa.array(count), pa.array(digest), pa.array(tainted)]
                    names += ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                arrays.append(pa.array([found.get(i, []) for i in range(size)], _MATCH_ARROW))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "matches"])

    return df.mapInArrow(run, schema)
