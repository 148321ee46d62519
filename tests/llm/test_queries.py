"""Every registered corpus query over awkward tables, against plain Python."""

import hashlib
import json
import random
import struct
import zlib

import pytest
import xxhash
from helpers import SCHEMA, TOKEN, awkward_rows, prose
from pyspark.sql import functions as F
from test_decontaminate import expected as contamination
from test_mixing import filled
from test_near_dedup import grouped
from test_quality_rules import expected as statistics
from test_secret_scan import base as secrets

from archspan.llm import queries

CLASHES = ("shard", "SLOT", "size", "class_id", "kept", "n_words", "score", "matches", "findings", "dropped_lines", "by_shard", "_row", "_k", "_h", "_t")


def tables(spark, folder, rows):
    rng = random.Random(2)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (None, "only four words here"), (3, None)]
    rows = rows and [*rows, (300, "intro " + items[0][1], "en", "s1", 1), (301, "see Only FOUR words, here and password = abcdefghijkl12", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("kept"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(rows and items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 2, 0) for i, *_ in rows if i is not None] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(rows and labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(c, t, r, x) for c in (1, 2, None) for t, r, x in ((0, "user", "hello"), (1, "assistant", 'an "answer"\n'), (2, "assistant", "é" * 2000), (None, None, None), (4, "assistant", "ab"), (4, "assistant", ""))]
    spark.createDataFrame(rows and turns, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1)).write.parquet(f"{folder}/conversations.parquet")
    return rows, items


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    return (folder, *tables(spark, folder, awkward_rows()))


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    tables(spark, folder, [])
    return folder


KINDS = {
    "op1_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_near_duplicates": "doc_id bigint, class_id bigint, class_docs bigint, n_links bigint, kept boolean",
    "op3_mixture": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, by_shard array<struct<shard:int,words:bigint>>",
    "op4_chat_messages": "conv_id bigint, position bigint, turn bigint, role string, n_calls int, n_invalid int, linked boolean, message string",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_quality_scores": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_contamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_recurring_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, dropped_lines array<int>",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


def test_every_query_is_listed():
    assert sorted(queries.queries()) == sorted(KINDS)


@pytest.mark.parametrize("name", sorted(KINDS))
def test_columns_rows_and_empty_tables(spark, given, nothing, name):
    got = queries.queries()[name](spark, given[0])
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == KINDS[name]
    if name != "op4_chat_messages":
        assert got.count() == len(given[1])
    assert queries.queries()[name](spark, nothing).collect() == []


def by_id(given, row):
    """Texts that the row may be of: some ids repeat."""
    return [t for i, t, *_ in given[1] if i == row["doc_id"]]


def permuted(x, n, seed):
    """The Feistel walk in plain Python."""
    a = max(1, int((n - 1) ** 0.5) + 1)
    b = max(1, -(-n // a))

    def mixed(half, turn, size):
        h = 42
        for value, form in ((half, "<q"), (turn, "<i"), (seed, "<i")):
            h = xxhash.xxh64_intdigest(struct.pack(form, value), h)
        return (h - (1 << 64) if h >= 1 << 63 else h) % size

    while True:
        left, right = x % a, x // a
        for turn in range(8):
            if turn % 2 == 0:
                left = (left + mixed(right, turn, a)) % a
            else:
                right = (right + mixed(left, turn, b)) % b
        x = right * a + left
        if x < n:
            return x


def test_op1_equals_brute_force(spark, given):
    folder, rows, _ = given
    got = queries.op1_shards(spark, folder)
    size = lambda t: len((t or "").encode()) + 8
    content = sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    listed = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in listed) == content
    order = [tuple(r) for r in got.select(F.xxhash64("doc_id", "size", "text_crc32"), F.xxhash64(F.lit(18), "doc_id", "size", "text_crc32"), "doc_id", "size").orderBy(*[1, 2]).collect()]
    n = len(rows)
    want = sorted((str(d), s, permuted(k, n, 17) % 24, permuted(k, n, 17) // 24) for k, (_, _, d, s) in enumerate(order))
    # Copies of one row take that row's numbers in any order.
    assert sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in listed) == want
    assert {r["law"] for r in listed} == {"rows"} and {r["grown_shard"] for r in listed} == {None}


def test_op2_equals_brute_force(spark, given):
    folder, rows, _ = given
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    classes = {i: c for c in grouped(rows) for i in c}
    least = {i: min((given[1][j][0] for j in c if given[1][j][0] is not None), default=None) for i, c in classes.items()}
    want = sorted(str((given[1][i][0], least[i], len(classes[i]))) for i in range(len(rows)))
    assert sorted(str((r["doc_id"], r["class_id"], r["class_docs"])) for r in queries.op2_near_duplicates(spark, folder).collect()) == want


def test_op3_sizes_and_targets(spark, given):
    folder, rows, _ = given
    got = queries.op3_mixture(spark, folder).collect()
    words = lambda t: len(TOKEN.findall(t or ""))
    whole = {s: sum(words(r[1]) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    targets = filled(whole)
    want = sorted(str((r[0], words(r[1]), whole[r[3]], round(float(targets[r[3]]), 6))) for r in rows)
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6))) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(e["words"] for e in r["by_shard"]) for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(sum(targets.values()), rel=0.02)


def test_op4_links_tool_turns(spark, given):
    folder = given[0]
    rows = queries.op4_chat_messages(spark, folder).collect()
    for r in rows:
        message = json.loads(r["message"])
        assert r["message"] == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    tools = [r for r in rows if r["role"] == "tool" and r["turn"] is not None and r["conv_id"] is not None]
    assert {r["linked"] for r in tools if r["turn"] // 4 != 4} == {True} and {r["linked"] for r in tools if r["turn"] // 4 == 4} == {False}
    calls = {(r["conv_id"], "c" + str(r["turn"] // 4)): r["position"] for r in rows if r["n_calls"] and r["turn"] is not None and r["conv_id"] is not None}
    assert calls and all(r["position"] > calls[r["conv_id"], json.loads(r["message"])["tool_call_id"]] for r in tools if r["linked"])
    assert {r["n_invalid"] for r in rows if r["n_calls"]} == {0, 1}


def test_op5_equals_the_library(spark, given):
    folder, rows, _ = given
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(queries.vocabulary())
    n = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    want = sorted(str((i, len((t or "").encode()), n(t), n(t) > 512)) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in queries.op5_token_counts(spark, folder).collect()) == want


def test_op6_holds_out_a_third(spark, given):
    for r in queries.op6_quality_scores(spark, given[0]).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op7_equals_brute_force(spark, given):
    folder, rows, items = given
    want = sorted(str((i, *contamination(t, items))) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in queries.op7_contamination(spark, folder).collect()) == want


def test_op8_equals_brute_force(spark, given):
    folder, rows, _ = given
    want = []
    for i, t, *_ in rows:
        n, chars, symbols, dups, repeats = statistics(t)
        want.append(str((i, n, chars, symbols, dups, repeats, n < 20 or 100 * repeats > 30 * n)))
    got = queries.op8_quality_rules(spark, folder).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op9_drops_lines_of_two_documents_and_more(spark, given):
    got = queries.op9_recurring_lines(spark, given[0]).collect()
    assert all(r["n_dropped"] == len(r["dropped_lines"]) and r["dropped_lines"] == sorted(set(r["dropped_lines"])) for r in got)
    assert sorted(r["n_lines"] for r in got) == sorted((t or "").count("\n") + 1 for _, t, *_ in given[1])
    # The long line of document 2 is also the null row's.
    assert [r["dropped_lines"] for r in got if r["doc_id"] == 2] == [[]]
    assert [0] in [r["dropped_lines"] for r in got if r["doc_id"] is None]


def test_op10_equals_brute_force(spark, given):
    folder, rows, _ = given
    want = []
    for i, t, *_ in rows:
        found = secrets(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append(str((i, *[sum(k == kind for k, *_ in found) for kind in ("assign", "access", "hex")], hashlib.sha256(joined.encode()).hexdigest())))
    got = queries.op10_secrets(spark, folder).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want)
    assert any(r["n_assign"] for r in got)
