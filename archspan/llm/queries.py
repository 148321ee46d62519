"""Registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, mixing, near_dedup, oracles, quality_model, quality_rules, secret_scan, sharding, token_count
from .common import table, utf8_bytes

SHARDS = 24
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file, which is never part of the repository: in ``TOKENIZER_DIR`` if that is set."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: shard sizes differ by at most one row. Null text: 8 bytes, crc32 of nothing (0)."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard(rows, SHARDS, seed=17)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=23)


def tool_turns(turns: DataFrame) -> DataFrame:
    """Tool turns made of every assistant's turn, in conversations -1 - conv_id; the tables hold none.

    Each is a call and its result. Every other result stands before its call, every fifth names
    a call that was never made, and by the length of the text arguments are an object, JSON in
    a string, or an object that its schema refuses.
    """
    spoken = turns.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    limit = F.length("text")
    number = F.when(limit % 3 == 2, F.concat(F.lit('"'), limit, F.lit('"'))).otherwise(limit.cast("string"))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    made = F.concat(F.lit('{"text": '), quoted(F.col("text")), F.lit(',  "limit": '), number, F.lit("}"))
    arguments = F.when(limit % 3 == 1, quoted(made)).otherwise(made)
    called = F.concat(F.lit('{"tool_calls": [{"id": "c'), F.col("turn"), F.lit('", "function": {"name": "look_up", "arguments": '), arguments, F.lit('}}], "content": "", "model": "m"}'))
    answered = F.concat(F.lit('{"tool_call_id": "'), F.when(F.col("turn") % 5 == 4, F.lit("x")).otherwise(F.lit("c")), F.col("turn"), F.lit('", "is_error": false, "content": '), quoted(F.col("text")), F.lit("}"))
    rows = F.array(
        F.struct((F.col("turn") * 4 + 2).alias("turn"), F.lit("assistant").alias("role"), called.alias("text")),
        F.struct((F.col("turn") * 4 + F.when(F.col("turn") % 2 == 0, 3).otherwise(1)).alias("turn"), F.lit("tool").alias("role"), answered.alias("text")),
    )
    return spoken.select((-1 - F.col("conv_id")).alias("conv_id"), F.explode(rows).alias("_t")).select("conv_id", "_t.turn", "_t.role", "_t.text")


#: What ``look_up`` takes.
SCHEMAS = {"look_up": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False}}


def op4_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and the tool turns made of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.messages(turns.unionByName(tool_turns(turns)), SCHEMAS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.counts(docs, vocabulary(), limit=512)


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels outside the held-out third only."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(docs, labels)
    return quality_model.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.cascade_verdict(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.marked(docs)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return rows.select("doc_id", lines.alias("n_lines"), F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("findings", lambda x: x["layers"] == "")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
