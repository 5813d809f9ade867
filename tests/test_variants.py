"""Schema rules over JSON of any shape against a plain validator."""

import json
import random
import re

import pytest

from textloom.operators import variants as V


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def same(v, w):
    return kind(v) == kind(w) and v == w


def plain(schema, v, pointer="", root=None):
    root = root if root is not None else schema
    if schema is True or schema is False:
        return []
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part] if part else target
        return plain(target, v, pointer, root)
    out, here = [], pointer or "/"
    k = kind(v)
    types = schema.get("type")
    if types is not None:
        types = [types] if isinstance(types, str) else types
        if k not in types and not ("integer" in types and k == "number" and v == int(v)):
            return [(here, f"must be {' or '.join(types)}, is {k}")]
    if "const" in schema and not same(v, schema["const"]):
        out.append((here, f"must be {json.dumps(schema['const'])}"))
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        out.append((here, "must be one of the listed values"))
    tests = {"minLength": ("string", lambda n: len(v) < n), "maxLength": ("string", lambda n: len(v) > n), "pattern": ("string", lambda p: not re.search(p, v)), "minimum": ("number", lambda n: v < n), "maximum": ("number", lambda n: v > n), "minItems": ("array", lambda n: len(v) < n), "maxItems": ("array", lambda n: len(v) > n)}
    out += [(here, f"{key} {schema[key]}") for key, (of, bad) in tests.items() if key in schema and k == of and bad(schema[key])]
    if isinstance(schema.get("items"), dict) and k == "array":
        out += [x for i, e in enumerate(v) for x in plain(schema["items"], e, f"{pointer}/{i}", root)]
    if k == "object":
        out += [(f"{pointer}/{n}", "is required") for n in schema.get("required", []) if n not in v]
        named = schema.get("properties", {})
        out += [x for n, sub in named.items() if n in v for x in plain(sub, v[n], f"{pointer}/{n}", root)]
        if isinstance(schema.get("additionalProperties"), dict):
            out += [x for n, e in v.items() if n not in named for x in plain(schema["additionalProperties"], e, f"{pointer}/{n}", root)]
    out += [x for sub in schema.get("allOf", []) for x in plain(sub, v, pointer, root)]
    if "anyOf" in schema and all(plain(sub, v, pointer, root) for sub in schema["anyOf"]):
        out.append((here, "matches none of anyOf"))
    if "if" in schema:
        out += plain(schema.get("else" if plain(schema["if"], v, pointer, root) else "then", {}), v, pointer, root)
    return out


def values(r, depth=3):
    pick = r.randint(0, 8 if depth else 5)
    if pick < 6:
        return r.choice((None, True, False, 0, 1, -3, 7, 2.5, 3.0, 1e300, "", "a", "abc", "é\U0001f600", "2024-01-01", "x" * 12))
    if pick == 6:
        return [values(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {n: values(r, depth - 1) for n in r.sample(["a", "b", "c", "d e"], r.randint(0, 4))}


SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 5}, "b": {"type": ["string", "null"], "minLength": 1, "maxLength": 3, "pattern": "^a"}}, "additionalProperties": {"type": ["array", "number"], "items": {"type": "string"}, "maxItems": 1}},
    {"anyOf": [{"type": "string"}, {"type": "array", "minItems": 2}, {"const": 7}], "allOf": [{"enum": [None, True, "abc", 3, 7]}]},
    {"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"required": ["c"]}, "else": {"type": "object", "properties": {"b": {"type": "boolean"}}}},
    {"type": ["object", "string", "number"], "properties": {"a": {"$ref": "#"}, "b": {"$ref": "#/definitions/n"}}, "definitions": {"n": {"type": "number"}}},
    {"items": {"items": {"type": "null"}, "maxItems": 1}, "properties": {"a": True}},
    {},
]


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_violations_equal_those_of_a_plain_validator(spark, number):
    r = random.Random(number)
    made = [values(r) for _ in range(150)] + [{"a": 1}, {"a": 1, "c": 0}, {"a": {"a": {"b": "x"}}}, [[None, None]], 7, 7.0]
    schema = SCHEMAS[number]
    rows = [(i, json.dumps(v)) for i, v in enumerate(made)]
    found = V.violations(spark.createDataFrame(rows, "i long, record string"), schema, "record", "i")
    wanted = sorted((i, *x) for i, v in enumerate(made) for x in plain(schema, v))
    assert sorted(map(tuple, found.collect())) == wanted and (wanted or not schema)


def test_text_that_is_no_json(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "{}"), (4, "{}"), (5, "[1,]")]
    found = V.violations(spark.createDataFrame(rows, "i long, record string"), {"type": "object", "required": ["a"]}, "record", "i")
    assert sorted(map(tuple, found.collect())) == [(1, "/", "is not JSON"), (2, "/", "is not JSON"), (3, "/", "is not JSON"), (4, "/a", "is required"), (4, "/a", "is required"), (5, "/", "is not JSON")]
    assert V.violations(spark.createDataFrame([], "i long, record string"), {"type": "object"}, "record", "i").count() == 0
