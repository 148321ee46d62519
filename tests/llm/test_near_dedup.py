import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, awkward_rows, documents, lower, prose, shingles

from archspan.llm import near_dedup, textbytes


def test_words_and_shingles_equal_plain_python():
    texts = [t for _, t, *_ in awkward_rows() if len(t or "") < 50_000] + ["Ünï çødé, WORDS-and 123", "a" * 300, "end", "END of"]
    column = pa.array(texts, pa.string())
    for limit in (10, 1 << 20):
        for lo, hi, data, offsets in textbytes.groups(column, limit):
            starts, ends, first = textbytes.spans(data, offsets)
            raw = data.tobytes()
            for d in range(hi - lo):
                got = [raw[a:b].decode().lower() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]], strict=True)]
                assert got == [w.lower() for w in WORD.findall(lower(texts[lo + d]))]
            doc, _, count = textbytes.shingles(data, offsets)
            for d in range(hi - lo):
                assert (doc == d).sum() == len(shingles(texts[lo + d]))


def plain_similarity(a, b, factors):
    def weights(text):
        _, _, data, offsets = next(textbytes.groups(pa.array([text]), 1 << 30))
        d, s, c = textbytes.shingles(data, offsets)
        return dict(zip(s.tolist(), near_dedup._weights(d, c, near_dedup._idf(s, factors)).tolist(), strict=True))

    x, y = weights(a), weights(b)
    low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return low / (sum(x.values()) + sum(y.values()) - low) if x and y else 0.0


def test_similarity_and_sampling_agree():
    rng = random.Random(2)
    factors = np.random.default_rng(1).uniform(0, 9, (2, 1 << near_dedup.SKETCH_BITS)).astype(np.float32)
    base = prose(rng, 300).split()
    other = base[:]
    for i in range(0, 300, 37):
        other[i] = "changed"
    a, b = " ".join(base), " ".join(other)
    want = plain_similarity(a, b, factors)
    assert near_dedup.similarity(pa.array([a, a, "", None]), pa.array([b, a, "", a]), factors) == pytest.approx([want, 1.0, 0.0, 0.0], abs=1e-5)
    _, _, data, offsets = next(textbytes.groups(pa.array([a, b]), 1 << 30))
    doc, s, c = textbytes.shingles(data, offsets)
    w = near_dedup._weights(doc, c, near_dedup._idf(s, factors))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    same = np.mean([len(set(near_dedup.weighted_samples(s, w, starts, k).tolist())) == 1 for k in range(1500)])
    assert same == pytest.approx(want, abs=0.05)


def grouped(rows):
    """Classes by brute force over all pairs, plain Jaccard of 0.8 and more or equal texts."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) / len(a | b) >= 0.8:
                parent[find(i)] = find(j)
    return {frozenset(rows[i][0] for i in range(len(rows)) if find(i) == k) for k in map(find, range(len(rows)))}


def near_copies():
    rng = random.Random(9)
    rows, at = [], 0
    for group in (1, 1, 2, 3, 5, 40):
        base = prose(rng, 150).split()
        for k in range(group):
            words = base[:]
            if k:
                words[rng.randrange(len(words))] = f"edit{k}"
            rows.append((at, " ".join(words), "en", "s", 1))
            at += 1
    rows += [(at + i, rows[i * 7][1], "en", "s", 1) for i in range(4)]
    rows += [(at + 10, None, "en", "s", 1), (at + 11, "", "en", "s", 1), (at + 12, "...", "en", "s", 1), (at + 13, "a b", "en", "s", 1), (at + 14, "A, b!", "en", "s", 1)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = near_copies()
    got = near_dedup.classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["class_id"], set()).add(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert {frozenset(v) for v in by.values()} == grouped(rows)
    assert all(min(v) == k for k, v in by.items())
    assert all(r["class_docs"] == len(by[r["class_id"]]) for r in got)


def test_original_gathers_copies_that_are_unlike_each_other(spark):
    # Three edits in 150 words: 0.81 to the original, about 0.69 among the copies.
    rng = random.Random(13)
    base = prose(rng, 150).split()
    rows = [(0, " ".join(base), "en", "s", 1)]
    for k in range(1, 400):
        words = base[:]
        for spot in rng.sample(range(8, 142, 12), 3):
            words[spot] = f"edit{k}x{spot}"
        rows.append((k, " ".join(words), "en", "s", 1))
    rows += [(1000 + i, prose(rng, 120), "en", "s", 1) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert sum(got[k] == 0 for k in range(400)) >= 399
    assert all(got[1000 + i] == 1000 + i for i in range(50))


def test_one_row_of_each_class_stays(spark):
    rows = near_copies()
    rows += [rows[0], rows[0], (None, rows[5][1], None, None, None), (None, prose(random.Random(1), 80), None, None, None)]
    df = documents(spark, rows, clash=("_k", "_tkey", "class_id"))
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes = grouped(near_copies())
    assert sorted(i for i in ids if i is not None) == sorted(min(c) for c in classes)
    assert ids.count(None) == 1


def test_awkward_rows_and_empty_table(spark):
    df = documents(spark)
    assert near_dedup.classes(df).count() == df.count()
    assert near_dedup.classes(documents(spark, [])).collect() == []
    assert near_dedup.dedup(documents(spark, [])).collect() == []


def test_components_of_a_chain(spark):
    from archspan.llm.common import Scratch

    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40) if i != 20], "a binary, b binary")
    labels = {bytes(r["node"]): bytes(r["label"]) for r in near_dedup.components(links, Scratch(spark)).collect()}
    assert {v for k, v in labels.items() if k <= bytes([20])} == {bytes([0])}
    assert {v for k, v in labels.items() if k > bytes([20])} == {bytes([21])}


def test_bound_never_misses_a_pair():
    rng = random.Random(5)
    factors = np.random.default_rng(3).uniform(0, 9, (2, 1 << near_dedup.SKETCH_BITS)).astype(np.float32)
    base = prose(rng, 120).split()
    texts = []
    for k in range(40):
        words = base[:]
        for spot in rng.sample(range(120), k // 6):
            words[spot] = f"edit{k}x{spot}"
        texts.append(" ".join(words + words[: k % 5 * 9]))
    column, rows = pa.array(texts), np.arange(40)
    reach = near_dedup.may_reach(column, rows, rows, factors)
    left, right = np.repeat(rows, 40), np.tile(rows, 40)
    near = near_dedup.similarity(column.take(pa.array(left)), column.take(pa.array(right)), factors).reshape(40, 40) >= near_dedup.SIMILARITY
    apart = ~np.eye(40, dtype=bool)
    assert reach[near & apart].all() and near[apart].any() and not reach[apart].all()


def test_pairs_that_share_boilerplate_with_many_others_meet(spark):
    # Families of two share 85% of their words with all others, and about 0.9 of their shingles with each other.
    rng = random.Random(21)
    boiler = prose(rng, 850)
    rows = []
    for family in range(500):
        own = " ".join(f"w{family}x{i}" for i in range(100))
        for member in range(2):
            rows.append((2 * family + member, f"{boiler} {own} " + " ".join(f"v{family}m{member}x{i}" for i in range(46)), "en", "s", 1))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(spark, rows)).collect()}
    apart = sum(got[2 * f] != got[2 * f + 1] for f in range(500))
    assert apart == 0
    assert len(set(got.values())) == 500


def test_classes_equal_components_of_all_pairs_of_weighted_jaccard(spark):
    # Copies from hardly to heavily edited, in small and large families, some with a passage that a third of all share.
    rng = random.Random(31)
    passage = prose(rng, 60)
    rows = []
    for family, size in enumerate([1] * 40 + [2] * 30 + [5] * 10 + [60]):
        base = prose(rng, rng.randint(60, 250)).split()
        shared = rng.random() < 0.33
        for _ in range(size):
            words = base[:]
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(len(words))] = "e" + str(rng.random())
            rows.append((len(rows), " ".join(words) + (" " + passage if shared else "") + " tail of it all" * rng.choice((0, 0, 4)), "en", "s", 1))
    df = documents(spark, rows)
    factors = near_dedup.frequencies(df)

    def weights(text):
        _, _, data, offsets = next(textbytes.groups(pa.array([text]), 1 << 30))
        d, s, c = textbytes.shingles(data, offsets)
        return dict(zip(s.tolist(), near_dedup._weights(d, c, near_dedup._idf(s, factors)).tolist(), strict=True))

    held = [weights(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for i, x in enumerate(held):
        for j in range(i):
            y = held[j]
            low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if low >= 0.8 * (sum(x.values()) + sum(y.values()) - low):
                links.append((i, j))
                parent[find(i)] = find(j)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    met = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 200 and met >= 0.99 * len(links)
    assert all(find(i) == find(got[i]) for i in range(len(rows)))
