import json
import random
import re

from pyspark.sql import functions as F

from textmill.functions import schemas as S
from textmill.operators import messages as M

SCHEMA = {
    "type": "object", "required": ["topic", "seats", "place"], "additionalProperties": False,
    "properties": {
        "topic": {"type": "string", "minLength": 2, "maxLength": 9, "pattern": "^[A-Z]"}, "seats": {"type": "integer", "minimum": 1, "maximum": 500},
        "price": {"type": ["number", "null"]}, "remote": {"type": "boolean"}, "kind": {"enum": ["a", "b", 3, None, True]},
        "place": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "zip": {"const": "8000"}}, "additionalProperties": False},
        "tags": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}},
    },
}


def plain(v, schema, path=""):
    """A validator that walks the value."""
    shown, out = path or "reply", []
    join = lambda p: f"{path}.{p}" if path else str(p)
    number = isinstance(v, int | float) and not isinstance(v, bool)
    is_ = {"null": v is None, "string": isinstance(v, str), "boolean": isinstance(v, bool), "number": number, "integer": number and v == int(v), "object": isinstance(v, dict), "array": isinstance(v, list)}
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_[k] for k in kinds):
        return [f"{shown}: not {' or '.join(kinds)}"]
    same = lambda x: type(v) is type(x) and v == x or number and isinstance(x, int | float) and not isinstance(x, bool) and v == x
    if "enum" in schema and not any(same(x) for x in schema["enum"]):
        out.append(f"{shown}: not one of " + ", ".join(json.dumps(x) for x in schema["enum"]))
    if "const" in schema and not same(schema["const"]):
        out.append(f"{shown}: not {json.dumps(schema['const'])}")
    if number and "minimum" in schema and v < schema["minimum"]:
        out.append(f"{shown}: less than {schema['minimum']}")
    if number and "maximum" in schema and v > schema["maximum"]:
        out.append(f"{shown}: more than {schema['maximum']}")
    if isinstance(v, str):
        if len(v) < schema.get("minLength", 0):
            out.append(f"{shown}: shorter than {schema['minLength']} characters")
        if len(v) > schema.get("maxLength", 99):
            out.append(f"{shown}: longer than {schema['maxLength']} characters")
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.append(f"{shown}: does not match {schema['pattern']}")
    if isinstance(v, dict):
        out += [f"{join(n)}: missing" for n in schema.get("required", []) if n not in v]
        for n, part in schema.get("properties", {}).items():
            if n in v:
                out += plain(v[n], part, join(n))
        if schema.get("additionalProperties") is False:
            out += [f"{join(n)}: not expected" for n in sorted(v) if n not in schema.get("properties", {})]
    if isinstance(v, list) and "items" in schema:
        for i, x in enumerate(v):
            out += plain(x, schema["items"], join(i))
    return out


def test_compiled_schema_equals_a_plain_validator(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([1, 0, 900, 3.0, 2.5, "Talk", "x", "a long topic", "", True, False, None, [], {}, [1], {"n": 1}, "8000", "b"])
    rows = []
    for _ in range(250):
        d = {"topic": rng.choice(["Talk", value()]), "seats": rng.choice([30, value()]), "place": rng.choice([{"city": "Bern"}, {"city": value(), "zip": value(), "x y": 1}, {}, value()])}
        for name in ("price", "remote", "kind", "extra", "tags"):
            if rng.random() < 0.4:
                d[name] = [{"n": value()}, {"n": 2, "m": 1}, value()] if name == "tags" and rng.random() < 0.7 else value()
        if rng.random() < 0.3:
            d.pop(rng.choice(list(d)))
        rows.append(rng.choice([d, d, d, d, value()]))
    rows += [{"topic": "Talk", "seats": 3, "place": {"city": "Bern", "zip": "8000"}, "price": None, "kind": None, "tags": [{"n": 1}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(-1, None), (-2, "{bad")], "i int, j string")
    got = {r.i: r.e for r in df.select("i", S.schema_errors(F.col("j"), SCHEMA).alias("e")).collect()}
    assert got[-1] == got[-2] == ["reply: not JSON"] and got[len(rows) - 1] == []
    for i, r in enumerate(rows):
        assert got[i] == plain(r, SCHEMA), (r, got[i])
    told = df.filter("i = -2").select(S.validation_message(S.schema_errors(F.col("j"), SCHEMA)).alias("m")).first().m
    assert told == "That reply was not a valid record (reply: not JSON). Reply with the corrected JSON object only."


def test_calls_are_checked_by_their_schemas(spark):
    tools = {"half": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}, "now": {"type": "object", "additionalProperties": False}}
    calls = [("half", '{"x": 4}'), ("half", '{"x": true}'), ("half", '{"y": 1}'), ("half", "[1]"), ("half", None), ("nope", "{}"), (None, "{}"), ("now", "{}")]
    rows = S.call_errors(spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "id int, name string, arguments string"), tools).orderBy("id").collect()
    assert [r.error for r in rows] == [None, "x: not integer", "x: missing; y: not expected", "the arguments are no JSON object", "the arguments are no JSON object", "unknown tool nope; there are: half, now", "unknown tool ; there are: half, now", None]


def test_messages_are_unpacked(spark):
    passages = [{"text": "one", "id": 1}, {"text": "two"}, {"id": 3}]
    thread = [
        {"role": "user", "content": "Result of lookup (c9): 7\nmore"}, {"role": "assistant", "content": None, "raw": json.dumps({"x": [1]}), "tool_calls": [{"id": "c1", "name": "search_docs", "args": {"q": "cats"}}, {"id": "c2", "name": "pay", "args": {}}]},
        {"role": "tool", "tool_call_id": "c1", "is_error": False, "content": json.dumps(json.dumps(passages))}, {"role": "tool", "tool_call_id": "c2", "is_error": True, "content": json.dumps("Error: no")},
        {"role": "assistant", "content": "done", "raw": "{}", "tool_calls": [{"id": "c3", "name": "search_docs", "args": {}}]}, {"role": "tool", "tool_call_id": "c3", "is_error": True, "content": json.dumps(json.dumps(passages))},
        {"role": "tool", "tool_call_id": "zz", "content": "3"}, {"role": "user", "content": "Error from pay (c2): no"},
    ]
    df = spark.createDataFrame([(1, json.dumps(thread)), (2, "[]"), (3, None), (4, '{"a": 1}'), (5, "{bad")], "thread_id int, messages string")
    assert [(r.pos, r.no, r.text) for r in M.retrieved_texts(df).orderBy("pos", "no").collect()] == [(2, 0, "one"), (2, 1, "two"), (2, 2, None)]
    assert [(r.pos, r.no, r.call_id, r.name, json.loads(r.args)) for r in M.tool_calls(df).orderBy("pos", "no").collect()] == [(1, 0, "c1", "search_docs", {"q": "cats"}), (1, 1, "c2", "pay", {}), (4, 0, "c3", "search_docs", {})]
    assert [(r.pos, r.name, r.is_error, json.loads(r.value) if r.pos != 3 else r.value) for r in M.tool_results(df).orderBy("pos").collect()] == [(2, "search_docs", False, passages), (3, "pay", True, "Error: no"), (5, "search_docs", True, passages), (6, None, False, 3)]
    assert [(r.kind, r.name, r.content) for r in M.rendered_results(df).orderBy("pos").collect()] == [("Result of", "lookup", "7\nmore"), ("Error from", "pay", "no")]
    whole = {r.thread_id: json.loads(r.messages) for r in M.adapter_messages(df).collect()}
    want = [{"role": "assistant", "content": m["content"], "raw": json.loads(m["raw"]), "tool_calls": m["tool_calls"]} if m["role"] == "assistant" else m for m in thread]
    assert whole == {1: want}
    reply = spark.createDataFrame([("hi", "end", '{"a": 1}', [("c1", "f", '{"x": 1}')])], "text string, stop string, raw string, calls array<struct<id: string, name: string, args: string>>")
    assert json.loads(M.reply_entries(reply).first().entry) == {"role": "assistant", "content": "hi", "stop": "end", "raw": '{"a": 1}', "tool_calls": [{"id": "c1", "name": "f", "args": {"x": 1}}]}


def test_a_document_is_parsed_once(spark):
    message = S.validation_message(S.schema_errors(F.col("j"), SCHEMA))
    plan = spark.createDataFrame([("{}",)], "j string").select(message.alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 1
