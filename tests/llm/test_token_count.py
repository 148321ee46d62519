import os
import random

import pytest
from helpers import awkward_rows, documents

from archspan.llm import token_count

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
FILE = os.path.join(FOLDER, "byte_bpe_50k.json")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")


@needs_file
def test_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(FILE)
    rng = random.Random(3)
    odd = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "don't I'll we've", "  spaces   and\n\n\nlines\t", "日本語のテキスト 123456", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\U0001f600\U0001f600\U0001f468‍\U0001f469", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(3000)), "ab" * 5000]
    rows = awkward_rows() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(odd)]
    df = documents(spark, rows, clash=("N_TOKENS",))
    got = token_count.counts(df, FILE, limit=20)
    texts = {r[0]: r[1] for r in rows}
    assert got.count() == len(rows)
    for r in got.filter("doc_id is not null").collect():
        if r["doc_id"] in (0, 3):
            continue
        text = texts[r["doc_id"]] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 20)


@needs_file
def test_merging_batches_equals_one_by_one():
    table = token_count.RankTable(token_count.load(FILE))
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abeinrst ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    together = token_count.merged_lengths(words, table)
    assert together.tolist() == [int(token_count.merged_lengths([w], table)[0]) if w else 0 for w in words]


@needs_file
def test_empty_table(spark):
    assert token_count.counts(documents(spark, []), FILE).collect() == []
