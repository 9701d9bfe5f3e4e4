import json

import pytest

from tidemill.llm import chat

SCHEMAS = {"sum": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "now": {}}


def call(*calls, **more):
    return json.dumps({"tool_calls": [dict(id=i, name=n, arguments=a) for i, n, a in calls], **more})


def result(call_id, content):
    return json.dumps({"tool_call_id": call_id, "content": content})


ROWS = [
    (1, 0, "user", 'what is "1" + 2?\n'), (1, 1, "assistant", call(("c1", "sum", {"b": 2, "a": 1.5}), content="let me see")),
    (1, 2, "tool", result("c1", "3.5")), (1, 3, "assistant", "{not json"),
    (2, 0, "tool", result("c1", "early")), (2, 5, "assistant", call(("c1", "sum", {"a": "x", "b": 1}))),
    (3, 0, "tool", result("c9", "orphan")), (3, 1, "assistant", call(("c1", "now", {}))),
    (4, 0, "assistant", call(("d", "now", {}), ("d", "now", {"x": 1}))), (4, 1, "tool", result("d", "ok")),
    (5, 0, "assistant", call(("e", "nope", {}), ("f", "sum", {"a": 1}))), (5, 1, "tool", result("e", "")),
    (5, 2, "tool", result("f", "é")), (6, 0, None, None), (6, None, "user", "no turn"), (None, 0, "user", "no id"),
    (7, 0, "user", "twice"), (7, 0, "user", "twice"), (8, 0, "user", "x" * 200_000),
]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' as json", "'x' as calls", "'x' as place").repartition(3)
    out = chat.formatted(df, SCHEMAS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan
    return out.collect()


def of(rows, conv):
    return sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.place_turn, r.place, r.json))


def test_all_messages_stay_as_canonical_json(rows):
    assert len(rows) == len(ROWS)
    for r in rows:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=False, separators=(",", ":"), ensure_ascii=False) or "\\" in r.json
        assert set(value) - {"tool_call_id", "tool_calls"} == {"content", "role"}
    plain = [r for r in rows if r.conv_id == 1]
    assert json.loads(of(rows, 1)[0].json)["content"] == 'what is "1" + 2?\n'
    assert len(plain) == 4 and of(rows, 1)[3].n_calls == 0


def test_calls_and_results_link_in_order(rows):
    first = of(rows, 1)
    assert [r.turn for r in first] == [0, 1, 2, 3] and [r.linked for r in first] == [None, None, True, None]
    assert all(r.problem is None for r in first)
    assert '"arguments":{"a":1.5,"b":2}' in first[1].json and '"content":"let me see"' in first[1].json
    # A result before its call moves behind it.
    assert [(r.turn, r.role) for r in of(rows, 2)] == [(5, "assistant"), (0, "tool")]
    assert of(rows, 2)[0].problem == "a is no number"
    assert [r.problem for r in of(rows, 3)] == ["result without call", "call without result"]
    fourth = of(rows, 4)
    assert fourth[0].problem == "call id used twice" and fourth[0].n_calls == 2 and fourth[0].n_bad == 1
    fifth = of(rows, 5)
    assert fifth[0].problem in ("unknown tool", "missing b") and fifth[0].n_bad == 2
    assert json.loads(fifth[2].json) == {"content": "é", "role": "tool", "tool_call_id": "f"}


def test_nulls_and_repeats(rows):
    assert [json.loads(r.json) for r in rows if r.conv_id == 6 and r.turn == 0] == [{"content": "", "role": ""}]
    assert sum(r.conv_id == 7 for r in rows) == 2 and sum(r.conv_id is None for r in rows) == 1


def test_empty_and_plain(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(none, SCHEMAS).count() == 0
    one = spark.createDataFrame([(1, 0, "assistant", call(("a", "any", {"z": 1, "b": [1, {"y": 2, "x": 1}]})))], none.schema)
    [row] = chat.formatted(one).collect()
    assert '"arguments":{"b":[1,{"x":1,"y":2}],"z":1}' in row.json and row.n_bad == 0


def test_calls_in_a_function_object_lose_nothing(spark):
    text = json.dumps({"content": None, "refusal": None, "tool_calls": [
        {"id": "a", "type": "function", "function": {"name": "sum", "arguments": '{"b": 2, "a": 1}'}},
        {"id": "b", "function": {"name": "now", "arguments": {}, "strict": True}}, {"id": "c", "name": "now"}]})
    odd = json.dumps({"tool_calls": [{"id": "x", "kind": "browse"}], "note": 1})
    rows = [(1, 0, "assistant", text), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3", "is_error": False})),
            (1, 2, "tool", result("b", "")), (1, 3, "tool", result("c", "")), (2, 0, "assistant", odd),
            (2, 1, "assistant", '{"tool_calls": [null]}'), (2, 2, "assistant", '{"tool_calls": 7}')]
    got = {(r.conv_id, r.turn): r for r in chat.formatted(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    first = got[1, 0]
    assert (first.n_calls, first.n_bad, first.problem) == (3, 0, None)
    assert json.loads(first.json) == {"content": "", "extra": {"refusal": None}, "role": "assistant", "tool_calls": [
        {"arguments": {"a": 1, "b": 2}, "extra": {"type": "function"}, "id": "a", "name": "sum"},
        {"arguments": {}, "extra": {"function": {"arguments": {}, "name": "now", "strict": True}}, "id": "b", "name": "now"},
        {"arguments": {}, "id": "c", "name": "now"}]}
    assert json.loads(got[1, 1].json) == {"content": "3", "extra": {"is_error": False}, "role": "tool", "tool_call_id": "a"}
    for turn in (0, 1, 2):  # not understood: content as it is
        assert json.loads(got[2, turn].json) == {"content": rows[4 + turn][3], "role": "assistant"}
        assert got[2, turn].n_calls == 0


def faulty(name, arguments):
    """Whether a call breaks the production schemas, in plain Python."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    if name not in chat.SCHEMAS or not isinstance(arguments, dict):
        return True
    own = chat.SCHEMAS[name]
    if set(arguments) - set(own) or any(required and a not in arguments for a, (_, required) in own.items()):
        return True
    return any(not isinstance(v, kinds[own[a][0]]) or isinstance(v, bool) != (own[a][0] == "boolean")
               for a, v in arguments.items())


def test_the_query_checks_arguments(spark, monkeypatch):
    tried = [("search", {"query": "x"}), ("search", {}), ("search", {"query": "x", "limit": "3"}), ("nope", {}),
             ("search", {"query": "x", "limit": 3}), ("fetch", {"url": 7}), ("fetch", ["u"]), ("calculate", {"expression": "1", "z": 1}),
             ("run_code", {"language": "c", "code": "", "timeout": 0.5}), ("write_file", {"path": "p", "content": "", "append": 1}),
             ("write_file", {"path": "p", "content": "", "append": True}), ("query_table", {"sql": "s", "parameters": [1]}),
             ("call_service", {"name": "n", "body": {"a": [1]}}), ("call_service", {"name": "n", "body": "b"})]
    rows = [(i, 0, "assistant", call((f"c{i}", *one))) for i, one in enumerate(tried)]
    rows += [(i, 1, "tool", result(f"c{i}", "ok")) for i in range(len(tried))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "table", lambda *_: frame)
    got = {r.conv_id: (r.n_calls, r.n_bad, r.problem is not None) for r in chat.op10_chat(spark, "").collect() if r.role == "assistant"}
    assert got == {i: (1, int(faulty(*one)), faulty(*one)) for i, one in enumerate(tried)}
