"""A compiler from JSON Schema to one Column expression over VARIANT: what is wrong with a document, as messages with paths.

The schema is walked once, on the driver; the expression that comes out of it runs in the JVM for every row. Keywords: type,
properties, required, additionalProperties (false), items, enum, const, minimum, maximum, minLength, maxLength, pattern."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a retry is asked for.
RETRY = ("That reply was not a valid record (", "). Reply with the corrected JSON object only.")
_NONE = "array<string>"


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once for a row, however often it is used and under whatever conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty() -> Column:
    return F.array().cast(_NONE)


def _check(ok: Column, path: Column, message: str) -> Column:
    """One message unless ok; a null counts as wrong."""
    return F.when(F.coalesce(ok, F.lit(False)), _empty()).otherwise(F.array(F.concat(path, F.lit(f": {message}"))))


def _is(v: Column, kind: str) -> Column:
    name = F.schema_of_variant(v)
    number = name.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL"))
    if kind == "null":
        return F.is_variant_null(v)
    if kind == "string":
        return name == "STRING"
    if kind == "boolean":
        return name == "BOOLEAN"
    if kind == "number":
        return number
    if kind == "integer":
        value = F.try_variant_get(v, "$", "double")
        return number & (value == F.floor(value))
    if kind in ("object", "array"):
        return F.startswith(name, F.lit(kind.upper()))
    raise ValueError(f"unknown type {kind!r}")


def _same(v: Column, value) -> Column:
    """Whether v is a plain value of the schema."""
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return _is(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, int | float):
        return _is(v, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return _is(v, "string") & (F.try_variant_get(v, "$", "string") == value)
    raise ValueError("enum and const hold plain values only")


def _field(v: Column, name: str) -> Column:
    if "'" in name or "\\" in name:
        raise ValueError(f"a property may have no quote or backslash in its name: {name!r}")
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _joined(path: Column, part: Column) -> Column:
    return F.when(path == "", part).otherwise(F.concat(path, F.lit("."), part))


def _shown(path: Column) -> Column:
    return F.when(path == "", F.lit("reply")).otherwise(path)


def _property(value: Column, schema: dict, path: Column) -> Column:
    return _once(value, lambda one: F.when(one.isNotNull(), _walk(one, schema, path)).otherwise(_empty()))


def _walk(v: Column, schema: dict, path: Column) -> Column:
    """The messages of a value, an array. What the type rules out is not looked at further."""
    found: list[Column] = []
    add = lambda ok, message: found.append(_check(ok, _shown(path), message))
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if "enum" in schema:
        ok = F.lit(False)
        for value in schema["enum"]:
            ok = ok | _same(v, value)
        add(ok, "not one of " + ", ".join(json.dumps(x) for x in schema["enum"]))
    if "const" in schema:
        add(_same(v, schema["const"]), f"not {json.dumps(schema['const'])}")
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    for key, ok in (("minimum", lambda x: number >= x), ("maximum", lambda x: number <= x)):
        if key in schema:
            add(~_is(v, "number") | ok(float(schema[key])), f"{'less' if key == 'minimum' else 'more'} than {schema[key]}")
    for key, ok in (("minLength", lambda x: F.length(text) >= x), ("maxLength", lambda x: F.length(text) <= x)):
        if key in schema:
            add(~_is(v, "string") | ok(schema[key]), f"{'shorter' if key == 'minLength' else 'longer'} than {schema[key]} characters")
    if "pattern" in schema:
        add(~_is(v, "string") | F.rlike(text, F.lit(schema["pattern"])), f"does not match {schema['pattern']}")
    if "properties" in schema or "required" in schema or schema.get("additionalProperties") is False:
        known, inside = schema.get("properties", {}), []
        for name in schema.get("required", []):
            inside.append(_check(_field(v, name).isNotNull(), _joined(path, F.lit(name)), "missing"))
        for name, part in known.items():
            inside.append(_property(_field(v, name), part, _joined(path, F.lit(name))))
        if schema.get("additionalProperties") is False:
            more = F.array_sort(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, known)).cast(_NONE)))
            inside.append(F.transform(more, lambda k: F.concat(_joined(path, k), F.lit(": not expected"))))
        if inside:
            found.append(F.when(_is(v, "object"), F.concat(*inside)).otherwise(_empty()))
    if "items" in schema:
        every = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        each = F.transform(every, lambda x, i: _walk(x, schema["items"], _joined(path, i.cast("string"))))
        found.append(F.when(_is(v, "array"), F.flatten(each)).otherwise(_empty()))
    rest = F.concat(*found) if found else _empty()
    if not kinds:
        return rest
    right = F.lit(False)
    for kind in kinds:
        right = right | _is(v, kind)
    wrong = F.array(F.concat(_shown(path), F.lit(f": not {' or '.join(kinds)}")))
    return F.when(F.coalesce(right, F.lit(False)), rest).otherwise(wrong)


def schema_errors(document: Column, schema: dict) -> Column:
    """The messages of a JSON text, an array in the order of the schema: empty if it is valid. A null, or what is no JSON, has
    the one message that says so."""
    return _once(F.try_parse_json(document), lambda v: F.when(v.isNull(), F.array(F.lit("reply: not JSON"))).otherwise(_walk(v, schema, F.lit(""))))


def validation_message(errors: Column) -> Column:
    """The retry instruction that lists the messages; null if there are none."""
    return _once(errors, lambda e: F.when(F.size(e) > 0, F.concat(F.lit(RETRY[0]), F.array_join(e, "; "), F.lit(RETRY[1]))))


def call_errors(calls, tools):
    """calls with error: null for a call (name, arguments) that a tool (name, schema) takes, or else what is wrong with it.

    tools: a dictionary of names and the JSON Schemas of their arguments. The schemas become one expression, so no row
    leaves the JVM."""
    name, arguments = F.col("name"), F.col("arguments")
    known = ", ".join(sorted(tools))
    parsed = F.try_parse_json(arguments)
    error = F.when(~F.coalesce(name.isin(*tools) if tools else F.lit(False), F.lit(False)), F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("")), F.lit(f"; there are: {known}")))
    error = error.when(~F.coalesce(_is(parsed, "object"), F.lit(False)), F.lit("the arguments are no JSON object"))
    for tool, schema in sorted(tools.items()):
        found = F.when(name == tool, schema_errors(arguments, schema))
        error = error.when(name == tool, _once(found, lambda e: F.when(F.size(e) > 0, F.array_join(e, "; "))))
    return calls.withColumn("error", error)
