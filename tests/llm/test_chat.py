import json

from archspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
WEATHER = {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "days": {"type": "integer"}, "unit": {"enum": ["C", "F"]}}, "additionalProperties": False}


def call(*calls, content=""):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls], "content": content})


def result(call_id, content):
    return json.dumps({"tool_call_id": call_id, "content": content})


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "weather?"),
        (1, 1, "tool", result("b", "early")),
        (1, 2, "assistant", call(("a", "weather", {"days": 2, "city": "Ulm"}), ("b", "weather", {"days": "two"}))),
        (1, 3, "tool", result("a", {"z": 1, "a": [1, 2]})),
        (1, 4, "tool", result("nobody", "x")),
        (2, 0, "tool", result("a", "other conversation")),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(chat.messages(df, {"weather": WEATHER}).collect(), key=lambda r: (r["conv_id"], r["position"]))
    assert [(r["conv_id"], r["turn"], r["linked"]) for r in got] == [(1, 0, None), (1, 2, None), (1, 1, True), (1, 3, True), (1, 4, False), (2, 0, False)]
    assert [r["position"] for r in got] == [0, 1, 2, 3, 4, 0]
    assert (got[1]["n_calls"], got[1]["n_invalid"]) == (2, 1)
    for r in got:
        parsed = json.loads(r["message"])
        assert r["message"] == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    links = {r["call_id"]: (r["linked"], r["valid"]) for r in chat.link(df, {"weather": WEATHER}).collect()}
    assert links == {"a": (True, True), "b": (True, False)}


def test_validation_cases(spark):
    cases = [('{"city":"a"}', True), ('{"city":1}', False), ("{}", False), ('{"city":"a","days":1.5}', False), ('{"city":"a","unit":"C"}', True), ('{"city":"a","unit":"K"}', False), ('{"city":"a","x":1}', False), ("[1]", False), ("nope", False)]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "function": {"name": "weather", "arguments": a}}]})) for i, (a, _) in enumerate(cases)]
    got = {int(r["call_id"]): r["valid"] for r in chat.link(spark.createDataFrame(rows, SCHEMA), {"weather": WEATHER}).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}


def test_awkward_turns(spark):
    rows = [(None, None, None, None), (1, None, "user", ""), (1, 0, "user", "{not json"), (1, 0, "user", "{not json"), (1, 1, "assistant", '{"tool_calls": "odd"}'), (1, 2, "tool", "plain"), (1, 3, "user", 'quote " and é \n'), (1, 4, "assistant", call(("x", "unknown", {}), ("x", "unknown", {})))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.messages(df, {"weather": WEATHER}).collect()
    assert len(got) == len(rows)
    for r in got:
        json.loads(r["message"])
    ones = sorted((r["position"], r["turn"]) for r in got if r["conv_id"] == 1)
    assert [p for p, _ in ones] == list(range(7))
    assert ones[-1][1] is None
    assert chat.messages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_is_numbered_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 16)
    df = spark.range(200).selectExpr("cast(5 as long) as conv_id", "id as turn", "'user' as role", "'t' as text")
    assert all(r["position"] == r["turn"] for r in chat.messages(df).collect())


def test_arguments_that_are_no_json_are_invalid_without_a_schema(spark):
    text = '{"tool_calls":[{"id":"a","name":"f","arguments":"{broken"},{"id":"b","name":"f","arguments":"{}"},{"id":"c","name":"f","arguments":{"x":1}},{"id":"d","name":"f"}]}'
    turns = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["n_calls"], r["n_invalid"]) for r in chat.messages(turns).collect()}
    assert got == {0: (4, 1), 1: (0, 0)}


def test_all_keys_of_a_tool_turn_stay_and_arguments_are_canonical(spark):
    texts = [
        ("assistant", '{"tool_calls":[{"type":"function","id":"a","function":{"name":"f","strict":true,"arguments":"{\\"b\\": 1,   \\"a\\": {\\"z\\": 1, \\"y\\": 2}}"}},{"name":"g","id":"b","arguments":{"d":1,"c":"{\\" kept"}},7],"refusal":null,"name":"x"}'),
        ("tool", '{"tool_call_id":"{\\"i\\":x","is_error":true,"name":"f","role":"other","content":{"q":[1, 2]}}'),
        ("assistant", '{"tool_calls":[{"id":"c","name":"f","arguments":"no json"}],"content":"t"}'),
        ("tool", "y" * 300_000),
    ]
    turns = spark.createDataFrame([(1, i, *t, "extra") for i, t in enumerate(texts)], SCHEMA + ", message string")
    got = [r["message"] for r in chat.messages(turns).orderBy("turn").collect()]
    assert got[0] == '{"content":"","name":"x","refusal":null,"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"a\\":{\\"y\\":2,\\"z\\":1},\\"b\\":1}","name":"f","strict":true},"id":"a","type":"function"},{"arguments":{"c":"{\\" kept","d":1},"id":"b","name":"g"},7]}'
    assert got[1] == '{"content":{"q":[1,2]},"is_error":true,"name":"f","role":"tool","tool_call_id":"{\\"i\\":x"}'
    assert got[2] == '{"content":"t","role":"assistant","tool_calls":[{"arguments":"no json","id":"c","name":"f"}]}'
    assert got[3] == '{"content":"' + "y" * 300_000 + '","role":"tool"}'


def test_many_turns_without_a_number_are_numbered(spark):
    df = spark.range(3000).selectExpr("cast(5 as long) as conv_id", "if(id < 2000, null, id) as turn", "'user' as role", "cast(id % 50 as string) as text")
    rows = chat.messages(df).collect()
    assert sorted(r["position"] for r in rows) == list(range(3000))
    assert all((r["turn"] is None) == (r["position"] >= 1000) for r in rows)
