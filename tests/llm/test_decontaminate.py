import hashlib
import random

import pytest
from helpers import WORD, awkward_rows, documents, lower, prose

from archspan.llm import decontaminate


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def fixture():
    rng = random.Random(11)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (3, "only four words here"), (4, None), (5, ""), (5, prose(rng, 20)), (None, prose(rng, 15)), (12, "..."), (6, "go go go go go go go go go go go go go go")]
    w = items[0][1].split()
    docs = awkward_rows()
    texts = [
        " ".join(w[:13]), " ".join(w[:12]), "x " + " ".join(w[5:30]).upper() + " y", "a, " + ", ".join(w[20:40]), prose(rng, 300) + " " + " ".join(w[3:17]), "Only FOUR words, here", "only four words",
        items[1][1] + " " + items[5][1] + " " + items[6][1], "go " * 30, " ".join(w[:20]) + " z " + " ".join(w[:20]),
    ]
    return items, docs + [(200 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


def expected(text, items):
    words = WORD.findall(lower(text))
    hit, ids = set(), set()
    for item_id, item in items:
        w = WORD.findall(lower(item))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    ids.add(None if item_id is None else str(item_id))
    ids = sorted(ids - {None})
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [None, 600])
def test_equals_brute_force(spark, monkeypatch, block):
    items, docs = fixture()
    docs = [d for d in docs if len(d[1] or "") < 50_000]
    if block:  # several blocks of items, chained
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    got = decontaminate.decontaminate(documents(spark, docs, clash=("MATCHES", "n_hit")), items_frame(spark, items))
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == expected(r["text"], items), r["text"]
        words = WORD.findall(lower(r["text"]))
        for m in r["matches"]:
            assert m["doc_word"] + m["n_words"] <= len(words)


def test_longest_match_and_location(spark):
    items, _ = fixture()
    w = items[0][1].split()
    df = documents(spark, [(1, "x y " + " ".join(w[4:30]) + " z", "en", "s", 1)])
    match = decontaminate.decontaminate(df, items_frame(spark, items[:1])).first()["matches"]
    assert [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in match] == [("1", 4, 2, 26)]


def test_removal_keeps_columns_and_clean_rows(spark):
    items, docs = fixture()
    df = documents(spark, docs, clash=("contaminated", "n_words"))
    kept = decontaminate.decontaminate(df, items_frame(spark, items), only_clean=True)
    assert kept.columns == df.columns
    want = sorted(str((d[0], d[1])) for d in docs if not (len(d[1] or "") < 50_000 and expected(d[1], items)[4]))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want


def test_empty_tables(spark):
    items, docs = fixture()
    assert decontaminate.decontaminate(documents(spark, []), items_frame(spark, items)).collect() == []
    rows = decontaminate.decontaminate(documents(spark), items_frame(spark, [])).collect()
    assert {r["n_hit"] for r in rows} == {0}


def runs(text, items):
    """(item, item word, first word, words) of the longest runs by brute force."""
    words = WORD.findall(lower(text))
    places = {}
    for item_id, item in items:
        w = WORD.findall(lower(item))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    places.setdefault(item_id, {}).setdefault(i, []).append((k, size))
    found = []
    for item_id, at in places.items():
        last = None
        for i in sorted(at):
            end = i + max(size for _, size in at[i])
            if last is not None and i == last + 1:
                found[-1][3] = max(found[-1][3], end - found[-1][2])
            else:
                found.append([None if item_id is None else str(item_id), min(k for k, _ in at[i]), i, end - i])
            last = i
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("pairs", [decontaminate.PAIRS, 7])
def test_longest_runs_equal_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = random.Random(3)
    words = "a b c d e".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([3, 4, 14, 15, 20, 30, 2])]
    items += [(7, "a " * 40), (7, "b a " * 20), (None, "c " * 16)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(6)] + [t * 2 for _, t in items] + ["a " * 90 + "z " + "a " * 13]
    block = decontaminate.Items([(None if i is None else str(i), t) for i, t in items])
    import pyarrow as pa

    from archspan.llm import textbytes

    for lo, hi, data, offsets in textbytes.groups(pa.array(texts), 1 << 20):
        _, found = decontaminate._shard_matches(data, offsets, block)
        for i in range(hi - lo):
            got = sorted(((m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in found.get(i, [])), key=str)
            assert got == runs(texts[lo + i], items)


def test_finds_of_repetitive_items_and_documents_stay_linear():
    import numpy as np

    items = decontaminate.Items([("a", "go " * 2_000), ("b", "go stay " * 1_000)])
    z = np.r_[np.full(50_000, items.words[0], np.int64), np.zeros(items.depth + 1, np.int64)]
    window, place = decontaminate.occurrences(z, decontaminate.suffix_array(z, items.depth), items)
    assert len(window) == len(place) == 50_000 - 12


def test_very_long_document(spark):
    items, _ = fixture()
    rng = random.Random(1)
    text = prose(rng, 400_000) + " " + items[0][1] + " " + prose(rng, 1_000)
    row = decontaminate.decontaminate(documents(spark, [(1, text, None, None, None)]), items_frame(spark, items)).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (401_040, 40, 1, False)
