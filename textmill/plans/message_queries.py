"""Schemas, calls and nested messages over the records of events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import schemas as S
from textmill.operators import messages as M
from textmill.plans.registry import query

#: What a record of an event must look like.
EVENT = {
    "type": "object", "required": ["who", "value", "props"], "additionalProperties": False,
    "properties": {
        "who": {"type": "integer", "minimum": 1}, "value": {"type": "number", "maximum": 95}, "type": {"enum": ["view", "click", "purchase", "signup"]},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}}},
    },
}


def _records(t):
    e = t("events")
    record = F.struct(F.col("user_id").alias("who"), "value", F.col("event_type").alias("type"), F.parse_json("props").alias("props"), F.when(F.col("event_id") % 11 == 0, F.col("event_id")).alias("note"))
    return e.select("event_id", F.to_json(record).alias("record"))


_EVENT_SQL = """SELECT event_id, list_filter([CASE WHEN value IS NULL THEN 'value: missing' END, CASE WHEN user_id < 1 THEN 'who: less than 1' END,
    CASE WHEN value > 95 THEN 'value: more than 95' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'type: not one of "view", "click", "purchase", "signup"' END,
    CASE WHEN CAST(props->>'$.k' AS INT) < 5 THEN 'props.k: less than 5' END, CASE WHEN CAST(props->>'$.k' AS INT) > 90 THEN 'props.k: more than 90' END,
    CASE WHEN event_id % 11 = 0 THEN 'note: not expected' END], lambda x: x IS NOT NULL) AS errors FROM events"""


@query("schema_errors", f"SELECT event_id, array_to_string(errors, '; ') AS errors FROM ({_EVENT_SQL})")
def schema_errors(t):
    """What is wrong with each event's record, by its schema."""
    return _records(t).select("event_id", F.array_join(S.schema_errors(F.col("record"), EVENT), "; ").alias("errors"))


@query("validation_message", f"SELECT event_id, 'That reply was not a valid record (' || array_to_string(errors, '; ') || '). Reply with the corrected JSON object only.' AS message FROM ({_EVENT_SQL}) WHERE len(errors) > 0")
def validation_message(t):
    """The retry instruction for each record that is not valid."""
    message = S.validation_message(S.schema_errors(F.col("record"), EVENT))
    return _records(t).select("event_id", message.alias("message")).filter("message IS NOT NULL")


@query("call_errors", """SELECT event_type, error, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown tool ' || event_type || '; there are: click, view'
    WHEN event_type = 'click' AND k > 50 THEN 'k: more than 50' WHEN event_type = 'view' THEN 'k: not expected' END AS error FROM (SELECT event_type, CAST(props->>'$.k' AS INT) AS k FROM events)) WHERE error IS NOT NULL GROUP BY ALL""")
def call_errors(t):
    """Events as calls of tools by their type, with the properties as arguments: faults by tool."""
    tools = {"click": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}, "view": {"type": "object", "additionalProperties": False}}
    calls = t("events").select("event_type", F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return S.call_errors(calls, tools).filter("error IS NOT NULL").groupBy("event_type", "error").agg(F.count(F.lit(1)).alias("n"))


def _threads(t):
    """Each conversation as a thread: what a user says stays, and an assistant's turn is a call with its lines as passages."""
    turn = F.col("turn")
    call = F.concat(F.lit("c"), turn.cast("string"))
    name = F.when(turn % 4 == 1, "search_docs").otherwise("lookup")
    passages = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("text")))
    said = F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), F.array(F.struct(call.alias("id"), name.alias("name"), F.struct(turn.alias("turn")).alias("args"))).alias("tool_calls")))
    quoted = F.get(F.split(F.to_json(F.struct(F.to_json(passages).alias("j"))), '"j":', 2), 1)
    content = F.expr("substring(_q, 1, length(_q) - 1)")
    rows = t("conversations").withColumn("_q", quoted)
    told = F.to_json(F.struct(F.lit("tool").alias("role"), call.alias("tool_call_id"), (turn % 7 == 5).alias("is_error"), content.alias("content")))
    user = F.to_json(F.struct("role", F.col("text").alias("content")))
    each = rows.select("conv_id", "turn", F.explode(F.when(F.col("role") == "user", F.array(user)).otherwise(F.array(said, told))).alias("j"), F.col("role"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.contains("j", F.lit('"tool_call_id"')).alias("b"), "j"))).alias("l"))
    return whole.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("messages"))


@query("retrieved_texts", """SELECT conv_id, turn AS call, i AS no, x AS text FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
    FROM conversations WHERE role <> 'user' AND turn % 4 = 1 AND turn % 7 <> 5)""")
def retrieved_texts(t):
    """The passages that search_docs returned in each thread, from calls that did not fail."""
    threads = _threads(t)
    found = M.retrieved_texts(threads, key="conv_id")
    calls = M.tool_results(threads, key="conv_id").select("conv_id", "pos", F.expr("cast(substring(call_id, 2) AS long)").alias("call"))
    return found.join(calls, ["conv_id", "pos"]).select("conv_id", "call", F.col("no").cast("long").alias("no"), "text")


@query("tool_calls", "SELECT conv_id, 'c' || turn AS call_id, CASE WHEN turn % 4 = 1 THEN 'search_docs' ELSE 'lookup' END AS name, turn FROM conversations WHERE role <> 'user'")
def tool_calls(t):
    """The calls in the assistant messages of each thread, with their argument."""
    return M.tool_calls(_threads(t), key="conv_id").select("conv_id", "call_id", "name", F.get_json_object("args", "$.turn").cast("long").alias("turn"))
