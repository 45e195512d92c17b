"""Nested message lists of threads: their calls, results and the passages in them, unpacked by variant_explode.

A thread has one JSON array of messages. An assistant message has tool_calls (id, name, args), a tool message has
tool_call_id, is_error and content, a JSON string that holds what the tool returned as JSON once more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exploded(df: DataFrame, json, pos: str, value: str) -> DataFrame:
    """df with a row for each element of a JSON array: its place and itself, a VARIANT. What is no array has none."""
    parsed = df.withColumn("_v", F.try_parse_json(json))
    parsed = parsed.withColumn("_v", F.when(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY")), F.col("_v")))
    elements = df.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF(pos, "_name", value)
    return parsed.lateralJoin(elements).drop("_v", "_name")


def _text(v, path: str):
    return F.try_variant_get(v, path, "string")


def entries(threads: DataFrame, key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, pos, role, content, message) of every message; message is the VARIANT itself."""
    each = _exploded(threads.select(key, messages), F.col(messages), "pos", "message")
    m = F.col("message")
    return each.select(key, "pos", _text(m, "$.role").alias("role"), _text(m, "$.content").alias("content"), "message")


def tool_calls(threads: DataFrame, key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, pos, no, call_id, name, args) of the calls in assistant messages; args is JSON text."""
    said = entries(threads, key, messages).filter("role = 'assistant'")
    calls = said.withColumn("_c", F.to_json(F.try_variant_get("message", "$.tool_calls", "variant"))).select(key, F.col("pos").alias("at"), "_c")
    each = _exploded(calls, F.col("_c"), "no", "call")
    c = F.col("call")
    return each.select(key, F.col("at").alias("pos"), "no", _text(c, "$.id").alias("call_id"), _text(c, "$.name").alias("name"), F.to_json(F.try_variant_get(c, "$.args", "variant")).alias("args"))


def tool_results(threads: DataFrame, key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, pos, call_id, name, is_error, value) of tool messages with the name of the call they answer; value is what the
    tool returned, as JSON: the content decoded once. A result of an unknown call has no name."""
    m = F.col("message")
    told = entries(threads, key, messages).filter("role = 'tool'")
    told = told.select(key, "pos", _text(m, "$.tool_call_id").alias("call_id"), F.coalesce(F.try_variant_get(m, "$.is_error", "boolean"), F.lit(False)).alias("is_error"), F.try_parse_json("content").alias("_v"))
    value = F.when(F.schema_of_variant("_v") == "STRING", F.try_variant_get("_v", "$", "string")).otherwise(F.to_json("_v"))
    names = tool_calls(threads, key, messages).groupBy(key, "call_id").agg(F.min_by("name", F.struct("pos", "no")).alias("name"))
    return told.withColumn("value", value).join(names, [key, "call_id"], "left").select(key, "pos", "call_id", "name", "is_error", "value")


def retrieved_texts(threads: DataFrame, tool: str = "search_docs", key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, pos, no, text) of the passages that a tool returned in a thread, without those of failed calls."""
    good = tool_results(threads, key, messages).filter((F.col("name") == tool) & ~F.col("is_error")).select(key, F.col("pos").alias("at"), "value")
    each = _exploded(good, F.col("value"), "no", "passage")
    return each.select(key, F.col("at").alias("pos"), "no", _text(F.col("passage"), "$.text").alias("text"))


def rendered_results(threads: DataFrame, key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, pos, kind, name, content) of tool results that user messages render as ``Result of name (id): content`` or
    ``Error from name (id): content``."""
    told = entries(threads, key, messages).filter("role = 'user'")
    pattern = r"(?s)^(Result of|Error from) (\w+) \([^)]*\): (.*)"
    part = lambda k: F.regexp_extract("content", pattern, k)
    return told.select(key, "pos", part(1).alias("kind"), part(2).alias("name"), part(3).alias("_c"), "content").filter("kind <> ''").select(key, "pos", "kind", "name", F.col("_c").alias("content"))


def reply_entries(replies: DataFrame) -> DataFrame:
    """replies (text, stop, raw, calls array of (id, name, args JSON)) with entry: the assistant message as JSON, raw as a
    string in it."""
    calls = F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.parse_json(c["args"]).alias("args")))
    entry = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), F.col("stop").alias("stop"), F.col("raw").alias("raw"), calls.alias("tool_calls"))
    return replies.withColumn("entry", F.to_json(entry, {"ignoreNullFields": "false"}))


def adapter_messages(threads: DataFrame, key: str = "thread_id", messages: str = "messages") -> DataFrame:
    """(key, messages): the list in the form that adapters take: an assistant message keeps content, tool_calls and its raw
    reply, decoded; the others stay as they are."""
    m = F.col("message")
    said = F.struct(
        F.lit("assistant").alias("role"), F.try_variant_get(m, "$.content", "variant").alias("content"), F.try_parse_json(_text(m, "$.raw")).alias("raw"),
        F.try_variant_get(m, "$.tool_calls", "variant").alias("tool_calls"),
    )
    rows = entries(threads, key, messages).select(key, "pos", F.when(F.col("role") == "assistant", F.to_json(said, {"ignoreNullFields": "false"})).otherwise(F.to_json(m)).alias("j"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "j"))).alias("l"))
    return whole.select(key, F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias(messages))
