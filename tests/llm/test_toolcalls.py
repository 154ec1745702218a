"""Tool calls: links, order, arguments and canonical JSON."""

import json

from pyspark.sql import functions as F

from tracewell.llm.toolcalls import SCHEMA, link_tool_calls


def call(id, name="search", **arguments):
    return "<tool_call>" + json.dumps({"name": name, "id": id, "arguments": arguments}) + "</tool_call>"


def result(id, content):
    return "<tool_result>" + json.dumps({"id": id, "content": content}) + "</tool_result>"


MESSAGES = [
    (1, 0, "user", "Find it"),
    (1, 1, "assistant", "Sure. " + call("a", q="x", n=3) + call("b", "open", page={"$ref": "a"})),
    (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2, 1]}})),
    (1, 3, "assistant", call("c", "open", page=[{"$ref": "b"}, {"$ref": "a"}]) + result("b", "text é \"q\"")),
    (1, 4, "assistant", call("a", q="again") + "<tool_call>{broken</tool_call>" + call("d", page={"$ref": "nowhere"})),
    (2, 0, "assistant", call("x", q={"$ref": "y"}) + call("y", q={"$ref": "x"}) + call("z", q={"$ref": "x"}) + call("self", q={"$ref": "self"})),
    (2, 1, "assistant", call("a", q="other conversation")),
    (3, 0, None, None), (3, 1, "tool", "not json"), (None, None, "user", "no conversation"), (3, 0, None, None),
]


def linked(spark, schemas=None):
    rows = spark.createDataFrame([(*m, "x", 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, json string, level int")
    return link_tool_calls(rows, schemas).collect()


def test_links_levels_and_errors(spark):
    rows = linked(spark)
    calls = {(r.conv_id, r.turn, r.place): r for r in rows if r.kind == "call"}
    assert {k: (r.id, r.level, r.linked, r.error) for k, r in calls.items()} == {
        (1, 1, 0): ("a", 0, True, None), (1, 1, 1): ("b", 1, True, None), (1, 3, 0): ("c", 2, False, None),
        (1, 4, 0): ("a", 0, False, "duplicate"), (1, 4, 1): (None, None, False, "json"), (1, 4, 2): ("d", 0, False, "reference"),
        (2, 0, 0): ("x", None, False, "cycle"), (2, 0, 1): ("y", None, False, "cycle"), (2, 0, 2): ("z", None, False, "cycle"),
        (2, 0, 3): ("self", None, False, "cycle"), (2, 1, 0): ("a", 0, False, None),
    }
    results = {(r.conv_id, r.turn): (r.id, r.linked, r.error) for r in rows if r.kind == "result"}
    assert results == {(1, 2): ("a", True, None), (1, 3): ("b", True, None)}
    assert sum(r.kind == "message" for r in rows) == len(MESSAGES)


def test_canonical_json(spark):
    rows = linked(spark)
    for r in rows:
        value = json.loads(r.json)
        if r.error != "json":
            assert r.json == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert value["kind"] == r.kind and value.get("conv_id") == r.conv_id
    first = next(r for r in rows if r.kind == "result" and r.turn == 2)
    assert json.loads(first.json)["content"] == {"b": [2, 1], "z": 1}
    assert any(json.loads(r.json).get("content") == 'text é "q"' for r in rows)


def test_arguments_against_schemas(spark):
    schemas = spark.createDataFrame(
        [("search", "q", "string", True), ("search", "n", "integer", False), ("open", "page", "object", True), ("ping", None, None, None)], SCHEMA
    )
    errors = {(r.conv_id, r.turn, r.place): r.error for r in linked(spark, schemas) if r.kind == "call"}
    assert errors[1, 1, 0] is None and errors[1, 1, 1] is None
    assert errors[1, 3, 0] == "type:page"
    more = [(9, k, "assistant", t) for k, t in enumerate([
        call("1", n=1.5, q="a"), call("2", extra=1), call("3", "ping", a=1), call("4", "nothing"), call("5", "ping"), call("6", q=None),
        '<tool_call>{"id":"7","name":"search","arguments":[1]}</tool_call>',
    ])]
    docs = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.error for r in link_tool_calls(docs, schemas).collect() if r.kind == "call"}
    assert got == {0: "type:n", 1: "missing:q,unknown:extra", 2: "unknown:a", 3: "tool:nothing", 4: None, 5: "type:q", 6: "arguments"}


def test_long_chain_and_empty_table(spark):
    chain = "".join(call(str(k), q={"$ref": str(k - 1)} if k else "start") for k in range(12))
    docs = spark.createDataFrame([(1, 0, "assistant", chain)], "conv_id long, turn long, role string, text string")
    got = {r.id: r.level for r in link_tool_calls(docs).where(F.col("kind") == "call").collect()}
    assert got == {str(k): k for k in range(12)}
    assert link_tool_calls(docs.limit(0)).count() == 0


def test_copies_of_one_row_and_null_turns(spark):
    call = '<tool_call>{"id":"a","name":"f","arguments":{}}</tool_call>'
    rows = [(1, 2, "assistant", call)] * 3 + [(1, None, "assistant", call), (1, 3, "user", '<tool_result>{"id":"a","content":1}</tool_result>')]
    found = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = sorted((r.turn is not None, r.error, r.linked) for r in found if r.kind == "call")
    assert calls == [(False, None, True)] + [(True, "duplicate", False)] * 3
    assert [(r.error, r.linked) for r in found if r.kind == "result"] == [(None, True)]


def test_every_branch_of_the_query_is_there(spark):
    from tracewell.llm.queries import op9_tool_call_linking

    rows = op9_tool_call_linking(spark, "/root/testdata/sf0.01").collect()
    errors = {r.error for r in rows}
    assert {None, "json", "duplicate", "reference", "cycle", "tool:absent", "type:n", "missing:limit,unknown:of"} <= errors
    assert max(r.level or 0 for r in rows) >= 2 and {r.linked for r in rows if r.kind == "result"} == {True, False}
