"""Fixtures of awkward documents and plain reference versions of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    syllables = "an be co da el fi go hu in ja ko lu".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, odd characters."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (30, 60, 200, 25)]
    texts = [*base, base[0], base[1] + " tail", None, "", "   \n ", "one", "a b c", "é" * 50, "x" * 60_000, "\n".join(["same line of a few words"] * 5), prose(rng, 20_000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(0, base[0], "en", "s0", 1), (0, base[0], "en", "s0", 1), (None, base[2], None, None, None), (None, None, None, None, None), (3, "another text with the same id " + base[3], "en", None, 5)]
    return rows


def documents(spark, rows=None, clash=()):
    """Documents, with extra columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    for name in clash:
        df = df.withColumn(name, F.lit("kept"))
    return df


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
