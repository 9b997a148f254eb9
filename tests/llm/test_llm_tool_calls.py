"""Tool-call linking against hand-made cases."""

import json

from slotwise.llm import tool_calls as tc

SCHEMA = json.dumps({"type": "object", "required": ["q"], "additionalProperties": False, "properties": {
    "q": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}})


def link(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    s = spark.createDataFrame([("search", SCHEMA)], "name string, schema string")
    return tc.link_calls(c, r, s).collect()


def test_status_errors_and_canonical_json(spark):
    calls = [
        (1, 1, 0, "a", "search", '{"q": "café", "n": 3}', None),
        (1, 1, 0, "a", "search", '{"q": "café", "n": 3}', None),  # the same row again
        (1, 3, 0, "a", "search", '{"q": "later"}', None),  # identifier taken
        (1, 4, 0, "b", "search", '{"n": 12, "x": 1, "tags": ["a", "c"]}', ["a", "zz"]),
        (1, 5, 0, "c", "other", "{}", None),
        (1, 6, 0, "d", "search", "{broken", None),
        (1, 7, 0, None, "search", '"{\\"q\\": \\"in a string\\"}"', None),
        (2, 1, 0, "a", "search", '{"q": "NaN", "n": NaN}', None),
    ]
    results = [(1, 2, "a", "found"), (1, 2, "a", "found"), (1, 9, "a", "again"), (1, 3, "b", "early"), (1, 9, "zz", "lost"), (1, 9, None, "x"), (3, 1, "a", "y")]
    out = link(spark, calls, results)
    got = {(r.conv_id, r.turn, r.call_id, r.status): (list(r.errors), r.canonical) for r in out}
    assert len(out) == len(got) == 12
    assert got[1, 1, "a", "linked"] == ([], '{"arguments":{"n":3,"q":"café"},"id":"a","name":"search","result":"found"}')
    assert got[1, 3, "a", "duplicate_id"][0] == []
    assert got[1, 4, "b", "no_result"][0] == ["enum:$.tags[1]", "maximum:$.n", "required:$.q", "unknown:$.x", "unknown_dependency:zz"]
    assert got[1, 5, "c", "no_result"][0] == ["unknown_tool"]
    assert got[1, 6, "d", "no_result"][0] == ["json:$"]
    assert json.loads(got[1, 7, None, "no_id"][1])["arguments"] == {"q": "in a string"}
    assert got[2, 1, "a", "no_result"][0] == ["json:$"]
    for key in ((1, 9, "a", "repeated_result"), (1, 3, "b", "early_result"), (1, 9, "zz", "orphan_result"), (1, 9, None, "no_id"), (3, 1, "a", "orphan_result")):
        assert key in got


def test_topological_levels_and_cycles(spark):
    chain = [(1, t, 0, f"k{t}", "search", '{"q": "ok"}', [f"k{t + 1}"] if t < 4 else None) for t in range(5)]  # each waits for a later one
    cycle = [(2, 0, 0, "x", "search", '{"q": "ok"}', ["y"]), (2, 1, 0, "y", "search", '{"q": "ok"}', ["x"]), (2, 2, 0, "z", "search", '{"q": "ok"}', None)]
    plain = [(3, t, 0, f"p{t}", "search", '{"q": "ok"}', [f"p{t - 1}"] if t else None) for t in range(4)]
    got = {(r.conv_id, r.call_id): (r.level, list(r.errors)) for r in link(spark, chain + cycle + plain, [])}
    assert [got[1, f"k{t}"][0] for t in range(5)] == [4, 3, 2, 1, 0]
    assert got[2, "x"] == got[2, "y"] == (None, ["cycle"]) and got[2, "z"] == (0, [])
    assert {got[3, f"p{t}"][0] for t in range(4)} == {0}


def test_parse_messages(spark):
    text = '{"tool_calls":[{"id":"a","name":"search","arguments":{"q":"hi"},"depends_on":["z"]},{"id":"b","function":{"name":"search","arguments":"{\\"q\\":\\"yo\\"}"}}]}'
    m = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (1, 3, "assistant", None), (1, 4, "assistant", "{oops")], "conv_id long, turn long, role string, text string")
    calls, results = tc.parse_messages(m)
    got = sorted((r.call_id, r.name, r.arguments, r.depends_on) for r in calls.collect())
    assert got == [("a", "search", '{"q":"hi"}', ["z"]), ("b", "search", '{"q":"yo"}', None)]
    assert [(r.call_id, r.content) for r in results.collect()] == [("a", "r")]


def test_turns_that_begin_like_json(spark):
    call = '{"tool_calls": [{"id": "x", "name": "answer", "arguments": {"prompt": "p", "turn": 5, "words": 1}}]}'
    m = spark.createDataFrame([
        (1, 0, "user", '{"a": 1} what is this?'), (1, 1, "assistant", '{"answer": "an object"}'),
        (1, 2, "user", "{ broken"), (1, 3, "assistant", "{ code }"), (1, 4, "user", "and now?"), (1, 5, "assistant", "\n  " + call),
        (1, 6, "tool", ' \t{"tool_call_id": "x", "content": "done"}'), (1, 7, "tool", "plain output"), (1, 8, "tool", '{"no": "identifier"}'),
    ], "conv_id long, turn long, role string, text string")
    json_calls, json_results = tc.parse_messages(m)
    calls, results = tc.turns_as_traffic(m)
    schemas = spark.createDataFrame([(k, tc.canonical(v)) for k, v in tc.TURN_SCHEMAS.items()], "name string, schema string")
    rows = tc.link_calls(calls.unionByName(json_calls), results.unionByName(json_results), schemas).collect()
    got = sorted((r.turn, r.call_id, r.status, tuple(r.errors)) for r in rows if r.call_id)
    assert got == [(0, "c-1-0", "linked", ()), (2, "c-1-2", "linked", ()), (4, "c-1-4", "no_result", ()), (5, "x", "linked", ())]
    assert sorted((r.turn, r.status) for r in rows if not r.call_id) == [(7, "no_id"), (8, "no_id")]
    made = {r.call_id: json.loads(r.canonical) for r in rows if r.canonical}
    assert made["c-1-0"]["result"] == '{"answer": "an object"}' and made["c-1-2"]["result"] == "{ code }" and made["x"]["result"] == "done"


def test_arguments_that_no_canonical_json_holds(spark):
    deep = "[" * 100_000 + "]" * 100_000
    bad = ['{"q": "\\ud800"}', '{"q": 1e999}', '"{\\"q\\": 1e999}"', deep, "1" * 5000, None, "", '{"q": "ok"} tail']
    out = link(spark, [(1, t, 0, f"c{t}", "search", a, None) for t, a in enumerate(bad)], [])
    got = {r.turn: (list(r.errors), json.loads(r.canonical)["arguments"]) for r in out}
    for t, a in enumerate(bad):
        if t == 2:  # a string whose own text is not JSON stays a string
            assert got[t] == (["type:$"], '{"q": 1e999}')
        else:
            assert got[t] == (["json:$"], a)


def test_schemas_that_are_none(spark):
    texts = {
        "any": "true", "never": "false", "broken": "{", "number": "3", "text": None, "deep": '{"items":' * 50_000 + "{}" + "}" * 50_000,
        "rules": '{"type": ["object", 7], "properties": {"q": {"minLength": "two", "maxLength": 1}}, "required": "q"}',
        "nested": '{"properties": {"q": true, "r": 5}, "additionalProperties": {"type": "integer"}}',
    }
    calls = [(1, t, 0, f"c{t}", name, '{"q": "ok", "r": 1, "s": "x"}', None) for t, name in enumerate(texts)] + [(1, 99, 0, "two", "twice", '{"q": "ok"}', None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    rows = [*texts.items(), ("twice", '{"type": "object"}'), ("twice", '{"type": "array"}'), ("any", "true"), (None, "false")]
    got = {x.name: list(x.errors) for x in tc.link_calls(c, r, spark.createDataFrame(rows, "name string, schema string")).collect()}
    assert got["any"] == [] and got["never"] == ["false:$"] and got["broken"] == got["number"] == got["deep"] == ["schema:$"]
    assert got["text"] == ["unknown_tool"] and got["twice"] == ["several_schemas", "type:$"]
    assert got["rules"] == ["maxLength:$.q", "schema:$", "schema:$.q"]
    assert got["nested"] == ["schema:$.r", "type:$.s"]


def test_null_long_and_clashing_input(spark):
    long = "x" * 300_000
    calls = [(None, None, None, None, None, None, None), (1, 1, 0, "a", "search", json.dumps({"q": long}), [None, "a"]), (None, 1, 0, "a", "search", '{"q": "ok"}', [])]
    results = [(None, None, None, None), (1, 2, "a", long), (1, None, "a", "when?"), (None, 2, "a", "r")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    s = spark.createDataFrame([("search", SCHEMA)], "name string, schema string")
    for extra in ("level", "errors", "status", "own", "first", "result", "several", "__row"):  # columns of the operator's own names
        c, r, s = (x.selectExpr("*", f"1 AS `{extra}`") for x in (c, r, s))
    out = tc.link_calls(c, r, s).collect()
    linked = [x for x in out if x.status == "linked"]
    assert [json.loads(x.canonical)["result"] for x in linked if x.conv_id == 1] == [long]
    assert len(out) == 6 and sorted(x.status for x in out if x.conv_id is not None) == ["early_result", "linked"]
