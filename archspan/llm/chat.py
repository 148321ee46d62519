"""Chat formatting: tool calls linked to results, ordered, validated and serialised.

A turn of a conversation is a row (conv_id, turn, role, text). An assistant's
text may be a JSON object with ``tool_calls``, an array of objects with id, name and
arguments (or function.name and function.arguments; arguments may be JSON in
a string). A tool's text is a JSON object with ``tool_call_id``. Anything else is
plain text.

Results are hash-joined to calls by conversation and call id (the earliest call
if an id repeats). The order is topological: a result comes after its call, at
its own place if that is later, else right behind the call's turn. Arguments are
validated against the tool's JSON schema: type, required, properties with type
and enum, and additionalProperties = false. Messages are canonical JSON: keys
sorted at every level, no white space. A tool turn keeps all keys of its object (the
row's role replaces one of that name); arguments that are JSON in a string stay a
string, of canonical JSON.

Output has a row per turn, so a conversation of any length is never gathered into one row;
positions are counted inside blocks of turns plus the sums of the blocks before.

Null turns come last in their conversation, null conv_ids form one conversation, null text is an empty
content and a null role stays null. Repeated turns keep their own rows. A result
without a call, and a call without a result, is reported and kept. Texts of any length are
formatted whole. Other columns than the four are not read and not returned. Turns of one
conversation and one number are numbered by one task, null ones by many.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_TURNS = 1024
#: Blocks of a conversation's turns without a number.
NULL_BLOCKS = 1024
_LAST = 2**62
#: SQL types that ``schema_of_variant`` reports for JSON schema types.
JSON_TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL("),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL(", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}


def _is(value: Column, kinds: str | list[str]) -> Column:
    kinds = [kinds] if isinstance(kinds, str) else kinds
    shape = F.schema_of_variant(value)
    found = F.lit(False)
    for kind in kinds:
        for name in JSON_TYPES[kind]:
            if kind == "integer" and name == "DECIMAL(":
                found = found | (shape.startswith(name) & shape.endswith(",0)"))
            else:
                found = found | shape.startswith(name)
    return F.coalesce(found, F.lit(False))


def validates(arguments: Column, schema: dict) -> Column:
    """True if the variant ``arguments`` fits the schema; null arguments never do."""
    text = F.to_json(arguments)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    fits = _is(arguments, schema.get("type", "object"))
    for name in schema.get("required", []):
        fits = fits & F.array_contains(keys, name)
    properties = schema.get("properties", {})
    for name, rule in properties.items():
        value = F.try_variant_get(arguments, "$['" + name.replace("'", "\\'") + "']", "variant")
        good = _is(value, rule["type"]) if "type" in rule else F.lit(True)
        if "enum" in rule:
            allowed = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in rule["enum"]]
            good = good & F.to_json(value).isin(allowed)
        fits = fits & (~F.array_contains(keys, name) | good)
    if schema.get("additionalProperties") is False:
        fits = fits & (F.size(F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>"))) == 0)
    return F.coalesce(fits, F.lit(False))


def _string(value: Column) -> Column:
    """JSON of a string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _entries(value: Column) -> Column:
    """(key, json) of a variant's keys; null if it is no object."""
    keyed = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.transform(keyed, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))


def _with(entries: Column, key: str, json_: Column) -> Column:
    return F.concat(F.filter(entries, lambda e: e["key"] != key), F.array(F.struct(F.lit(key).alias("key"), json_.alias("json"))))


def _object(entries: Column) -> Column:
    members = F.transform(F.array_sort(entries), lambda e: F.concat(_string(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _canonical_arguments(raw: Column) -> Column:
    inner = F.try_parse_json(F.try_variant_get(raw, "$", "string"))
    return F.when((F.schema_of_variant(raw) == "STRING") & inner.isNotNull(), _string(F.to_json(inner))).otherwise(F.to_json(raw))


def _canonical_call(c: Column) -> Column:
    get = lambda path: F.try_variant_get(c, path, "variant")
    entries = _entries(c)
    entries = F.when(get("$.arguments").isNotNull(), _with(entries, "arguments", _canonical_arguments(get("$.arguments")))).otherwise(entries)
    inner = _object(_with(_entries(get("$.function")), "arguments", _canonical_arguments(get("$.function.arguments"))))
    entries = F.when(get("$.function.arguments").isNotNull(), _with(entries, "function", inner)).otherwise(entries)
    return F.coalesce(_object(entries), F.to_json(c), F.lit("null"))


def _parsed() -> Column:
    """The text as a variant if it looks like a JSON object."""
    text = F.ltrim(F.col("text"))
    return F.when(text.startswith("{"), F.try_parse_json("text"))


def calls(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, call, call_id, name, arguments): a row per tool call."""
    listed = F.try_variant_get(_parsed(), "$.tool_calls", "array<variant>")
    rows = turns.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(listed).alias("call", "_c"))
    get = lambda path, kind: F.try_variant_get("_c", path, kind)
    raw = F.coalesce(get("$.function.arguments", "variant"), get("$.arguments", "variant"))
    in_text = F.try_variant_get(raw, "$", "string")
    arguments = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(in_text)).otherwise(raw)
    return rows.select("conv_id", "turn", "call", get("$.id", "string").alias("call_id"), F.coalesce(get("$.function.name", "string"), get("$.name", "string")).alias("name"), arguments.alias("arguments"))


def link(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, call, call_id, name, arguments_json, valid, linked) for each call.

    valid is false for arguments that are no JSON or do not fit, null for a tool without a
    schema; linked tells whether a result answers the call.
    """
    schemas = schemas or {}
    made = calls(turns)
    answered = turns.filter("role = 'tool'").select(F.col("conv_id").alias("_v"), F.try_variant_get(_parsed(), "$.tool_call_id", "string").alias("_id")).filter("_id is not null").groupBy("_v", "_id").agg(F.lit(True).alias("linked"))
    valid = F.lit(None).cast("boolean")
    for name, schema in schemas.items():
        valid = F.when(F.col("name") == name, validates(F.col("arguments"), schema)).otherwise(valid)
    both = made.join(answered.hint("shuffle_hash"), made.conv_id.eqNullSafe(answered["_v"]) & (made.call_id == answered["_id"]), "left")
    return both.select("conv_id", "turn", "call", "call_id", "name", F.to_json("arguments").alias("arguments_json"), valid.alias("valid"), F.coalesce("linked", F.lit(False)).alias("linked"))


def messages(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, position, turn, role, n_calls, n_invalid, linked, message) for each turn.

    n_invalid counts calls whose arguments are no JSON, and with ``schemas`` those that do not fit.
    position counts from 0 in topological order. linked is null for turns that
    are no tool results, else whether the call exists. message is canonical JSON.
    """
    schemas = schemas or {}
    scratch = Scratch(turns.sparkSession)
    parsed = turns.select("conv_id", "turn", "role", "text").withColumn("_j", _parsed())
    result_id = F.when(F.col("role") == "tool", F.try_variant_get("_j", "$.tool_call_id", "string"))
    listed = F.when(F.col("role") == "assistant", F.try_variant_get("_j", "$.tool_calls", "array<variant>"))
    parsed = parsed.withColumn("_id", result_id).withColumn("_calls", listed)

    def wrong(c: Column) -> Column:
        raw = F.coalesce(F.try_variant_get(c, "$.function.arguments", "variant"), F.try_variant_get(c, "$.arguments", "variant"))
        in_text = F.schema_of_variant(raw) == "STRING"
        parsed_text = F.try_parse_json(F.try_variant_get(raw, "$", "string"))
        arguments = F.when(in_text, parsed_text).otherwise(raw)
        name = F.coalesce(F.try_variant_get(c, "$.function.name", "string"), F.try_variant_get(c, "$.name", "string"))
        fails = in_text & parsed_text.isNull()  # no JSON, whatever the tool
        for tool, schema in schemas.items():
            fails = F.when(name == tool, ~validates(arguments, schema)).otherwise(fails)
        return F.coalesce(fails, F.lit(False))

    bad = F.greatest(F.coalesce(F.size(F.filter("_calls", wrong)), F.lit(0)), F.lit(0))
    plain = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role")))
    entries = _with(_entries(F.col("_j")), "role", _string(F.col("role")))
    entries = F.when(F.exists(entries, lambda e: e["key"] == "content"), entries).otherwise(_with(entries, "content", F.lit('""')))
    tool = _object(entries)
    called = _object(_with(entries, "tool_calls", F.concat(F.lit("["), F.array_join(F.transform("_calls", _canonical_call), ","), F.lit("]"))))
    message = F.when(F.col("_id").isNotNull(), tool).when(F.col("_calls").isNotNull(), called).otherwise(plain)
    # Every turn is parsed and formatted once; what follows reads the written table.
    formatted = scratch.write(
        parsed.select(
            "conv_id",
            "turn",
            "role",
            "_id",
            F.transform("_calls", lambda c: F.try_variant_get(c, "$.id", "string")).alias("_made"),
            F.greatest(F.coalesce(F.size("_calls"), F.lit(0)), F.lit(0)).alias("n_calls"),
            bad.alias("n_invalid"),
            F.coalesce("turn", F.lit(_LAST)).alias("_own"),
            message.alias("message"),
        ),
        "turns",
    )
    made = formatted.select("conv_id", "_own", F.explode("_made").alias("_w")).filter("_w is not null")
    first = made.groupBy(F.col("conv_id").alias("_v"), "_w").agg(F.min("_own").alias("_at"))
    results = formatted.filter("_id is not null")
    linked = results.join(first.hint("shuffle_hash"), results.conv_id.eqNullSafe(first["_v"]) & (results["_id"] == first["_w"]), "left").drop("_v", "_w")
    rows = linked.unionByName(formatted.filter("_id is null").withColumn("_at", F.lit(None).cast("long")))
    place = F.greatest("_own", F.coalesce("_at", "_own"))
    spread = F.when(place == _LAST, F.pmod(F.xxhash64("role", "message"), F.lit(NULL_BLOCKS))).otherwise(0)
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "n_calls",
        "n_invalid",
        F.when(F.col("_id").isNotNull(), F.col("_at").isNotNull()).alias("linked"),
        "message",
        (F.floor(place / BLOCK_TURNS) + spread).alias("_block"),
        place.alias("_place"),
        (place != F.col("_own")).cast("int").alias("_late"),
        "_own",
    )
    sizes = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("_v"), F.col("_block").alias("_w"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("_place", "_late", "_own", "role", "message")
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(offsets, numbered.conv_id.eqNullSafe(offsets["_v"]) & (numbered["_block"] == offsets["_w"])).select("conv_id", (F.col("_offset") + F.col("_n")).alias("position"), "turn", "role", "n_calls", "n_invalid", "linked", "message")
