"""Recurring lines across documents, found with a log-template tree.

A line is parsed to its tokens by built-in functions; tokens with a digit or @ or :// are variable
fields. The tree has a fixed depth: token count, then the leading ``DEPTH``
tokens. Lines of one leaf are clustered: a line joins the template that shares
most of its tokens, ``ALIKE`` of them at least, and positions that differ become fields
(<*>); otherwise it starts a template. Lines enter by falling count, then hash, so
reruns agree. A template that occurs in ``MIN_DOCS`` documents or more is
recurring, one of more than ``LONG_TOKENS`` tokens from ``LONG_DOCS`` on; all its lines
are dropped but the first one (by doc_id, then line), so that no passage is lost.
Templates with few constant tokens say nothing, but lines of equal tokens, fields
included, recur by the same counts whatever their template.

Only leaves with enough lines are clustered, and only their distinct lines are
moved: a line that a third of all documents share is one row behind a map-side
combine. A leaf of any size is clustered by one pass in one task, which streams its
lines and holds its templates; a line is compared only with templates that an index
of tokens by position does not rule out.

Lines of fewer than ``MIN_TOKENS`` tokens are never dropped; lines of any length are parsed
whole. Null and empty texts have no lines to drop. Rows with equal doc_id and text count as
one document. Other columns pass through; one named dropped_lines in any letter case is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, packed, row_key, ship, small, unpacked

DEPTH = 3
ALIKE = 0.6
MIN_DOCS = 3
#: A passage of so many tokens is no chance phrase: two documents make it recurring.
LONG_TOKENS, LONG_DOCS = 50, 2
MIN_TOKENS = 5
#: Lines of a leaf that are sent on at a time.
LEAF_LINES = 2048
FIELD = b"<*>"


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _masked(tokens: Column) -> Column:
    """Tokens, joined by blanks, with those that hold a digit, @ or :// replaced.

    Both patterns begin at a token's first character only and never go back, so a
    token of any length is read once.
    """
    marked = F.when(tokens.rlike("[0-9@]"), F.regexp_replace(tokens, "(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+", FIELD.decode())).otherwise(tokens)
    return F.when(tokens.contains("://"), F.regexp_replace(marked, "(?<![^ ])[^ ]*?://[^ ]*+", FIELD.decode())).otherwise(marked)


def parsed(docs: DataFrame) -> DataFrame:
    """(_k, doc_id, line, leaf, hash, exact, least, masked) of every line of enough tokens; least is the number of documents that makes it recurring."""
    lines = docs.filter("text <> ''").select("_k", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_raw"))
    # Most lines are words with single blanks between them; patterns are for the others.
    told = lines.withColumn("_odd", F.col("_raw").contains("  ") | F.col("_raw").contains("://") | F.col("_raw").rlike(r"[\x09-\x0D0-9@]"))
    blanks = F.when(F.col("_odd"), F.regexp_replace("_raw", f"[{SPACE}]+", " ")).otherwise(F.col("_raw"))
    plain = told.select("_k", "doc_id", "line", "_odd", F.trim(blanks).alias("_plain"))
    n = F.octet_length("_plain") - F.octet_length(F.replace("_plain", F.lit(" "), F.lit(""))) + 1
    # The row id pins the filter here: pushed below the projections it would repeat their work.
    enough = plain.withColumns({"_n": n, "_bar": F.monotonically_increasing_id()}).filter((F.col("_n") >= MIN_TOKENS) & (F.col("_bar") >= 0))
    rows = enough.withColumn("masked", F.when(F.col("_odd"), _masked(F.col("_plain"))).otherwise(F.col("_plain")))
    return rows.select(
        "_k",
        "doc_id",
        "line",
        F.xxhash64("_n", F.substring_index("masked", " ", DEPTH)).alias("leaf"),
        F.xxhash64("masked").alias("hash"),
        F.xxhash64("_plain").alias("exact"),
        F.when(F.col("_n") > LONG_TOKENS, LONG_DOCS).otherwise(MIN_DOCS).alias("least"),
        F.col("masked").cast("binary").alias("masked"),
    )


class Templates:
    """Templates of one leaf, all with ``width`` tokens."""

    def __init__(self, width: int):
        self.width, self.n = width, 0
        self.made = np.zeros((16, width), np.int64)
        self.codes: dict[bytes, int] = {FIELD: 0}
        self.names = [FIELD]
        self.least = math.ceil(ALIKE * width)
        #: By position and code, the templates that have, or once had, the code there.
        self.at: dict[tuple[int, int], list[int]] = defaultdict(list)

    def join(self, line: bytes) -> int:
        """Number of the template that the line joins or starts."""
        tokens = line.split(b" ")
        row = np.array([self.codes.get(token, -1) for token in tokens], np.int64)
        # Of so many positions one is shared by every template that is alike enough: those with the fewest templates are asked.
        lists = sorted((self.at.get(key, ()) for key in enumerate(row.tolist())), key=len)[: self.width - self.least + 1]
        near = np.array(sorted({k for some in lists for k in some}), np.int64)
        if len(near):
            same = (self.made[near] == row).sum(1)
            best = int(same.argmax())
            if same[best] >= self.least:
                number = int(near[best])
                for i in np.flatnonzero((self.made[number] != row) & (self.made[number] != 0)).tolist():
                    self.made[number, i] = 0
                    self.at[i, 0].append(number)
                return number
        for i, token in enumerate(tokens):
            if row[i] < 0:
                if token not in self.codes:
                    self.codes[token] = len(self.names)
                    self.names.append(token)
                row[i] = self.codes[token]
            self.at[i, int(row[i])].append(self.n)
        if self.n == len(self.made):
            self.made = np.concatenate([self.made, np.zeros_like(self.made)])
        self.made[self.n] = row
        self.n += 1
        return self.n - 1

    def texts(self) -> list[bytes]:
        return [b" ".join(self.names[c] for c in row) for row in self.made[: self.n].tolist()]


def cluster(lines: list[bytes]) -> list[bytes]:
    """Template of each line of one leaf; all have the same number of tokens."""
    made = Templates(len(lines[0].split(b" ")))
    member = [made.join(line) for line in lines]
    texts = made.texts()
    return [texts[m] for m in member]


def _clustered(rows: DataFrame) -> DataFrame:
    """Of rows (leaf, hash, n, masked): (leaf, hash, place) of every line and (leaf, place, template) of every template."""

    def lines_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["leaf", "hash", "place", "template"])

    def place(at: tuple[int, int], number: int) -> int:
        return _hash(b"%d %d %d" % (*at, number))

    def ended(at: tuple[int, int], made: Templates) -> Iterator[pa.RecordBatch]:
        texts = made.texts()
        for lo in range(0, len(texts), LEAF_LINES):
            yield lines_of([(at[0], None, place(at, lo + i), text) for i, text in enumerate(texts[lo : lo + LEAF_LINES])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made, out = None, None, []
        for batch in batches:
            for leaf, key, masked in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if (leaf, masked.count(b" ")) != at:
                    if made:
                        yield from ended(at, made)
                    at = (leaf, masked.count(b" "))
                    made = Templates(at[1] + 1)
                out.append((leaf, key, place(at, made.join(masked)), None))
                if len(out) >= LEAF_LINES:
                    yield lines_of(out)
                    out = []
        yield lines_of(out)
        if made:
            yield from ended(at, made)

    dealt = rows.select("leaf", "hash", "n", "masked").repartition("leaf").sortWithinPartitions("leaf", F.size(F.split(F.col("masked").cast("string"), " ")), F.desc("n"), "hash")
    return dealt.mapInArrow(run, "leaf long, hash long, place long, template binary")


def recurring_lines(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(_k, dropped): key of the row and numbers of the lines to drop, for documents that have any."""
    ship(df.sparkSession)
    docs = df.select(row_key("doc_id", "text").alias("_k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.write(parsed(docs).drop("masked"), "lines")
    kinds = scratch.write(lines.groupBy("leaf", "hash", "least").agg(F.count(F.lit(1)).alias("n")), "kinds")
    leaves = scratch.write(kinds.groupBy("leaf").agg(F.sum("n").alias("total"), F.min("least").alias("least")).filter("total >= least").select("leaf"), "leaves")
    n_leaves = leaves.count()
    candidates = parsed(docs).join(small(leaves, n_leaves), "leaf").groupBy("leaf", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("masked").alias("masked"))
    templates = scratch.write(_clustered(candidates), "templates")
    tokens = F.split(F.col("template").cast("string"), " ")
    constant = F.size(F.array_remove(tokens, FIELD.decode()))
    telling = scratch.write(templates.filter("template is not null").filter((constant >= MIN_TOKENS) & (constant >= F.size(tokens) * ALIKE)).select("place", F.xxhash64("leaf", "template").alias("t")), "telling")
    named = scratch.write(templates.filter("template is null").select("leaf", "hash", "place").join(small(telling, telling.count()), "place").select("leaf", "hash", "t"), "named")
    equal = scratch.write(lines.groupBy("exact").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("_least")).filter("n >= _least").select("exact"), "equal")
    where = ["_k", "doc_id", "line", "least"]
    alike = lines.join(small(named, named.count()), ["leaf", "hash"]).select("t", *where)
    same = lines.join(small(equal, equal.count()), "exact").select(F.xxhash64(F.lit("exact"), "exact").alias("t"), *where)
    found = scratch.write(alike.unionByName(same), "found")
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k", "line")
    each = found.groupBy("t", "_k").agg(F.min(first).alias("first"), F.min("least").alias("least"))
    recurring = scratch.write(each.groupBy("t").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"), F.min("least").alias("least")).filter("docs >= least").drop("least"), "recurring")
    out = found.join(small(recurring, recurring.count()), "t").filter((F.col("_k") != F.col("first._k")) | (F.col("line") != F.col("first.line")))
    done = scratch.write(out.groupBy("_k").agg(F.sort_array(F.collect_set("line")).alias("dropped")), "dropped")
    for name in ("lines", "kinds", "leaves", "templates", "telling", "named", "equal", "found", "recurring"):
        scratch.drop(name)
    return done


def marked(df: DataFrame) -> DataFrame:
    """``df`` with ``dropped_lines``, sorted numbers from 0 of its lines to drop."""
    scratch = Scratch(df.sparkSession)
    dropped = recurring_lines(df, scratch)
    names = [c for c in df.columns if c.lower() != "dropped_lines"]
    keyed = packed(df, _k=row_key("doc_id", "text"))
    n, lines = dropped.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()
    joined = keyed.join(small(dropped, n, 64 + 4 * lines // max(n, 1)), "_k", "left")
    return joined.select(*unpacked(names), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped_lines"))


def cleaned(df: DataFrame) -> DataFrame:
    """``df`` with the dropped lines cut from ``text``; all rows and columns stay."""
    rows = marked(df)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped_lines", i))
    text = F.when(F.size("dropped_lines") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("dropped_lines")
