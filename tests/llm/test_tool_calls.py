"""Tool-call linking on explicit calls."""

import json

from strongbox.llm import tool_calls as tc

SCHEMAS = [("add", "a", "number", True), ("add", "b", "number", True), ("add", "note", "string", False), ("show", "value", "object", True)]


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def turn(*calls):
    return json.dumps({"tool_calls": list(calls)}, indent=1)


def result(i, content="fine"):
    return json.dumps({"content": content, "tool_call_id": i})


def rows_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS name", "'y' AS part", "'z' AS call_id")
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return tc.format_chats(frame, schemas, **options).orderBy("conv_id", "turn", "stage", "part").collect()


def test_links_order_and_checks(spark):
    rows = [
        (1, 0, "user", "do it"),
        (1, 1, "assistant", turn(
            call("c", "show", {"value": {"$ref": "b"}}), call("b", "add", {"b": {"$ref": "a"}, "a": 1}), call("a", "add", {"b": 2, "a": 1.50, "note": "é \"q\""}),
            call("x", "show", {"value": {"$ref": "y"}}), call("y", "show", {"value": {"$ref": "x"}}),
        )),
        (1, 2, "tool", result("a")), (1, 3, "tool", result("b")), (1, 4, "tool", result("nobody")),
        (1, 5, "assistant", turn(call("a", "add", {"a": 1, "b": 1}), call("d", "add", {"a": "1", "b": 2}), call("e", "add", {"a": 1}), call("f", "add", {"a": 1, "b": 2, "z": 0}), call("g", "none", {}), call("h", "add", [1]), call("i", "add", '{"b":2,"a":1}'), call(None, "add", {"a": 1, "b": 2}))),
        (1, 6, "assistant", '{"broken'), (2, 0, "tool", result("late")), (2, 1, "assistant", turn(call("late", "add", {"a": 1, "b": 2}))),
        (None, 0, "assistant", turn(call("q", "add", {}))), (3, None, "user", "where"), (3, 0, None, None), (3, 1, "assistant", '{"tool_calls": []}'),
    ]
    found = rows_of(spark, rows)
    calls = {(r.conv_id, r.turn, r.call_id): (r.stage, r.status) for r in found if r.kind == "call"}
    assert calls[1, 1, "a"] == (0, "ok") and calls[1, 1, "b"] == (1, "ok") and calls[1, 1, "c"] == (2, "unanswered")
    assert calls[1, 1, "x"][1] == calls[1, 1, "y"][1] == "cycle"
    assert calls[1, 5, "a"][1] == "duplicate" and calls[1, 5, "d"][1] == "invalid:type:a" and calls[1, 5, "e"][1] == "invalid:missing:b"
    assert calls[1, 5, "f"][1] == "invalid:unknown:z" and calls[1, 5, "g"][1] == "invalid:function:none" and calls[1, 5, "h"][1] == "invalid:arguments"
    assert calls[1, 5, "i"][1] == "unanswered" and calls[1, 5, None][1] == "unanswered" and calls[2, 1, "late"][1] == "ok"
    results = {(r.conv_id, r.call_id): r.status for r in found if r.kind == "result"}
    assert results == {(1, "a"): "ok", (1, "b"): "ok", (1, "nobody"): "orphan", (2, "late"): "early"}
    told = {r.call_id: r.json for r in found if r.kind == "call" and r.turn == 1 and r.conv_id == 1}
    assert told["a"] == '{"arguments":{"a":1.5,"b":2,"note":"é \\"q\\""},"id":"a","name":"add","role":"assistant"}'
    assert told["b"] == '{"arguments":{"a":1,"b":{"$ref":"a"}},"id":"b","name":"add","role":"assistant"}'
    for r in found:
        text = json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert text == r.json
    messages = [(r.conv_id, r.turn, r.status) for r in found if r.kind == "message"]
    assert (None, 0, "unplaced") in messages and (3, None, "unplaced") in messages and (3, 0, "ok") in messages and (1, 6, "ok") in messages


def test_text_beside_calls_and_empty_lists(spark):
    add = call("a", "add", {"a": 1, "b": 2})
    texts = [{"content": "I add.", "tool_calls": [add]}, {"tool_calls": []}, {"content": "none", "tool_calls": []}, {"content": None, "tool_calls": [dict(add, id="b")]}]
    texts.append({"content": [{"type": "text"}], "tool_calls": [dict(add, id="c")]})
    for options in ({}, {"turns_as_calls": True}):
        found = rows_of(spark, [(1, k, "assistant", json.dumps(t)) for k, t in enumerate(texts)], **options)
        got = [(r.turn, r.part, r.kind, json.loads(r.json).get("content")) for r in found]
        assert got == [
            (0, -1, "message", "I add."), (0, 0, "call", None), (1, 0, "message", ""), (2, 0, "message", "none"), (3, 0, "call", None),
            (4, -1, "message", '[{"type":"text"}]'), (4, 0, "call", None),
        ]


def test_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (2, 1, "assistant", "lost"), (2, 0, "assistant", "first"), (1, 1, "user", "u")]
    found = rows_of(spark, rows, turns_as_calls=True)
    assert len(found) == len(rows)
    got = sorted((r.conv_id, r.turn, r.kind, r.status) for r in found)
    assert got == sorted([(1, 0, "message", "ok"), (1, 2, "result", "ok"), (2, 1, "result", "orphan"), (2, 0, "message", "ok")] + [(1, t, "call", "invalid:function:respond") for t in (1, 1, 3)])
    assert rows_of(spark, [], turns_as_calls=True) == []


def test_a_long_chain_inside_a_turn(spark):
    n = 12
    calls = [call(f"k{i}", "show", {"value": {"$ref": f"k{i - 1}"} if i else {}}) for i in range(n)]
    found = rows_of(spark, [(1, 0, "assistant", turn(*calls[::-1]))])
    assert [r.call_id for r in found] == [f"k{i}" for i in range(n)] and [r.stage for r in found] == list(range(n))


def test_order_over_the_conversation(spark):
    """Uses of later turns, cycles across turns, identifiers that nobody has, chains back through the turns."""
    use = lambda *ids: {"value": [{"$ref": i} for i in ids]}
    long_ = "word " * 200_000
    rows = [
        (1, 1, "assistant", turn(call("a", "show", use("b")), call("p", "show", use("q")))),
        (1, 2, "tool", result("p")),
        (1, 3, "assistant", turn(call("b", "show", use("a")), call("q", "show", use("r")))),
        (1, 5, "assistant", turn(call("r", "show", {"value": {}}), call("s", "show", use("p", "r")), call("u", "show", use("none", "also"))), ),
        (1, 6, "tool", result("p")), (1, 6, "tool", result("r")),
        (1, 7, "assistant", turn(call("p", "show", use("u")), call('odd "id"', "show", {"value": {"text": long_}}), call("v", "show", use('odd "id"')))),
        *((2, k, "assistant", turn(call(f"k{k}", "show", use(f"k{k - 1}") if k else {"value": {}}))) for k in range(40)),
        (3, 0, "assistant", turn(call("x", "show", use("a")))),
    ]
    found = rows_of(spark, rows)
    calls = {(r.conv_id, r.turn, r.call_id): r for r in found if r.kind == "call"}
    said = lambda *k: (calls[k].place, calls[k].stage, calls[k].status)
    assert said(1, 1, "a") == (3, 0, "cycle") and said(1, 3, "b") == (3, 0, "cycle")
    assert said(1, 5, "r") == (5, 0, "invalid:type:value") or calls[1, 5, "r"].status == "ok"
    assert calls[1, 3, "q"].place == 5 and calls[1, 3, "q"].stage == 1 and calls[1, 1, "p"].place == 5 and calls[1, 1, "p"].stage == 2
    assert calls[1, 5, "s"].stage == 3 and calls[1, 5, "u"].status == "lost:also" and calls[1, 7, "p"].status == "duplicate"
    assert calls[1, 7, "v"].stage == 1 and len(calls[1, 7, 'odd "id"'].json) > len(long_) and calls[3, 0, "x"].status == "lost:a"
    assert all((calls[2, k, f"k{k}"].place, calls[2, k, f"k{k}"].stage) == (k, 0) for k in range(40))
    results = {(r.turn, r.call_id): r.status for r in found if r.kind == "result"}
    assert results == {(2, "p"): "early", (6, "p"): "ok", (6, "r"): "ok"}
    # in the order of (place, stage, turn, part) no call stands before one it uses, but for cycles
    order = sorted((r for r in found if r.kind == "call" and r.status not in ("cycle", "duplicate")), key=lambda r: (r.conv_id, r.place, r.stage, r.turn, r.part))
    at = {(r.conv_id, r.call_id): k for k, r in enumerate(order)}
    for r in order:
        for i in (x["$ref"] for x in json.loads(r.json)["arguments"].get("value", []) if isinstance(x, dict) and "$ref" in x):
            assert at.get((r.conv_id, i), -1) < at[r.conv_id, r.call_id]


def test_field_names_with_signs(spark):
    schemas = spark.createDataFrame([("f", "a.b", "number", True), ("f", "c'd", "string", True)], "name string, field string, type string, required boolean")
    texts = [turn(call("x", "f", {"a.b": 1, "c'd": "s"})), turn(call("y", "f", {"a": {"b": 1}, "c'd": "s"})), turn(call("z", "f", {"a.b": None, "c'd": "s"}))]
    rows = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.status for r in tc.format_chats(rows, schemas).collect()}
    assert got == {"x": "unanswered", "y": "invalid:missing:a.b", "z": "invalid:type:a.b"}
