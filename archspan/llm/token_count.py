"""Exact byte-pair token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens by the vocabulary's own pattern. Pre-tokens not
seen before by this worker are laid end to end in one flat symbol array (a
ragged array) and merged together: in each round every sequence applies all
non-overlapping occurrences, from the left, of its own lowest-rank pair. Symbols
that survive are the tokens. A merge makes a symbol whose later merges all have
higher ranks, so applying one rank's occurrences at once equals applying them
one by one.

The vocabulary file is read by each worker from a path all executors have, or
shipped as a broadcast of its fixed size by ``load``.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted alike, each on its
own row; texts of any length are counted whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship, without

#: Split pattern of byte-level vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a worker before it starts anew.
CACHE = 400_000
#: Symbols merged in one ragged array; a longer pre-token forms an array of its own.
FLAT = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


class RankTable:
    """Merge ranks by pair of symbol ids, and the ids of single bytes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level pair merging is supported")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a prefix space is not supported")
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = np.zeros(256, np.int64)
        for sign, b in alphabet.items():
            self.byte_id[b] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.rank[at], len(self.key))


def merged_lengths(sequences: list[bytes], table: RankTable) -> np.ndarray:
    """Number of symbols each sequence ends with. Empty sequences end with 0."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    out = lengths.copy()
    none = len(table.key)
    symbols = table.byte_id[np.frombuffer(b"".join(sequences), np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), lengths)
    rank = np.full(len(symbols), none)
    if len(symbols) > 1:
        rank[:-1] = np.where(owner[:-1] == owner[1:], table.ranks(symbols[:-1], symbols[1:]), none)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.r_[starts, len(symbols)])
        done = least == none
        if done.any():  # finished sequences leave the array
            out[owner[starts[done]]] = counts[done]
            keep = np.repeat(~done, counts)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            if not len(symbols):
                break
            counts, least = counts[~done], least[~done]
        hit = rank == np.repeat(least, counts)
        at = np.flatnonzero(hit)
        if len(at) > 1:  # in a run of one repeated symbol, every second pair stands
            near = np.r_[False, (np.diff(at) == 1)]
            if near.any():
                first = np.flatnonzero(~near)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                at = at[place % 2 == 0]
        symbols[at] = table.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        fresh = moved[at]
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        touched = np.unique(np.r_[fresh, fresh[fresh > 0] - 1])
        inner = touched[touched + 1 < len(symbols)]
        rank[touched] = none
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[inner] = table.ranks(symbols[inner], symbols[inner + 1])
    return out


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens."""

    def __init__(self, spec: dict):
        self.table = RankTable(spec)
        self.split = regex.compile(PATTERN).findall
        special = sorted(self.table.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > CACHE:
            self.known = {}
        batch, size = [], 0
        for token in tokens:
            raw = token.encode()
            if batch and size + len(raw) > FLAT:
                self._merge(batch)
                batch, size = [], 0
            batch.append((token, raw))
            size += len(raw)
        if batch:
            self._merge(batch)

    def _merge(self, batch: list[tuple[str, bytes]]) -> None:
        counts = merged_lengths([raw for _, raw in batch], self.table)
        self.known.update(zip((t for t, _ in batch), counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts, fixed = [], []
        for text in texts:
            if self.special is not None and any(s in text for s in self.table.special):
                pieces = self.special.split(text)
                fixed.append(len(self.special.findall(text)))
                parts.append([t for piece in pieces for t in self.split(piece)])
            else:
                fixed.append(0)
                parts.append(self.split(text))
        fresh: set[str] = set().union(*parts) - self.known.keys()
        if fresh:
            self._learn(fresh if len(self.known) + len(fresh) <= CACHE else set().union(*parts))
        get = self.known.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(fixed, parts, strict=True)]


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


_COUNTERS: dict[str, Counter] = {}


def counts(df: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", group_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with n_bytes, n_tokens (long) and over_limit, and without ``text``.

    A narrow pass: no shuffle, one output row per input row. Texts are handled
    whole, in groups of about ``group_bytes``, so memory follows the longest
    text. Columns named like an added one are replaced.
    """
    ship(df.sparkSession)
    df = without(df, *[c for c in df.columns if c.lower() in ("n_bytes", "n_tokens", "over_limit")])
    kept = [c for c in df.columns if c != text]
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    for name, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(load(vocabulary))
        counter = _COUNTERS[vocabulary]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = np.cumsum(sizes) // group_bytes
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
            tokens: list[int] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                tokens += counter.count([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sizes), pa.array(n), pa.array(n > limit)],
                names=[*kept, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.mapInArrow(run, schema)
