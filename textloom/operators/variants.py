"""JSON Schema rules over JSON of any shape, held as variants: a value of a wrong type is a violation and not a null."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.regex import let
from textloom.operators.quality import VIOLATIONS

#: Levels to which a schema may refer to itself.
DEEPEST = 12
_KINDS = (("string", ("STRING",)), ("boolean", ("BOOLEAN",)), ("number", ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")), ("array", ("ARRAY",)), ("object", ("OBJECT",)), ("null", ("VOID",)))


def _none() -> Column:
    return F.expr(f"cast(array() as {VIOLATIONS})")


def kind_of(value: Column) -> Column:
    """string, boolean, number, array, object or null: what a variant holds; null for an absent value."""
    held = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    out = F.lit(None).cast("string")
    for kind, names in _KINDS:
        out = F.when(held.isin(*names), F.lit(kind)).otherwise(out)
    return out


def _equals(value: Column, kind: Column, wanted) -> Column:
    """Whether a variant is a given JSON scalar: of the same type and equal."""
    if wanted is None:
        return kind == "null"
    if isinstance(wanted, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return (kind == "number") & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    return (kind == "string") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))


def compile_variant(schema: dict | bool, value: Column, pointer: Column | None = None, root: dict | None = None, level: int = 0) -> Column:
    """array<struct<pointer, message>> of the rules of a JSON Schema that a variant breaks; empty for an absent value.

    Keywords: type (integer is a number without a fraction, as 3.0 is), const, enum (scalars), minLength, maxLength, pattern, minimum, maximum,
    minItems, maxItems, items, required, properties, additionalProperties (a schema, for the keys that properties doesn't
    name), allOf, anyOf, if/then/else and local $ref, which may lead back to itself DEEPEST times.  A wrong type is the only violation of its value; other rules hold
    for the values that they speak of and no others, as the schema language says: minLength says nothing about a number.
    Pointers name keys and the numbers of items from 0; the whole value is /.
    """
    root = root if root is not None else schema
    pointer = F.lit("") if pointer is None else pointer
    if isinstance(schema, bool):
        return _none()
    if "$ref" in schema:
        if level >= DEEPEST:
            return _none()
        target = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part] if part else target
        return compile_variant(target, value, pointer, root, level + 1)
    # A value, its kind and what the rules ask of it are computed once and bound to a name.
    parts = {"v": value, "kind": kind_of(value), "text": F.try_variant_get(value, "$", "string"), "number": F.try_variant_get(value, "$", "double")}
    if "items" in schema or "minItems" in schema or "maxItems" in schema:
        parts["items"] = F.try_variant_get(value, "$", "array<variant>")
    if any(k in schema for k in ("required", "properties", "additionalProperties")):
        parts["fields"] = F.try_variant_get(value, "$", "map<string,variant>")
    return let(F.struct(*[c.alias(k) for k, c in parts.items()]), lambda x: _rules(schema, {k: x[k] for k in parts}, pointer, root, level))


def _rules(schema: dict, of: dict[str, Column], pointer: Column, root: dict, level: int) -> Column:
    below = lambda sub, v, p: compile_variant(sub, v, p, root, level)
    here = F.when(pointer == "", F.lit("/")).otherwise(pointer)
    broken = lambda bad, message, where=here: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(where.alias("pointer"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))).otherwise(_none())
    value, kind, text, number, items, fields = (of.get(k) for k in ("v", "kind", "text", "number", "items", "fields"))
    out: list[Column] = []
    if "const" in schema:
        out.append(broken(~_equals(value, kind, schema["const"]), f"must be {json.dumps(schema['const'])}"))
    if "enum" in schema:
        listed = F.lit(False)
        for x in schema["enum"]:
            listed = listed | _equals(value, kind, x)
        out.append(broken(~listed, "must be one of the listed values"))
    for key, about, bad in (
        ("minLength", "string", lambda n: F.length(text) < n),
        ("maxLength", "string", lambda n: F.length(text) > n),
        ("pattern", "string", lambda p: ~text.rlike(p)),
        ("minimum", "number", lambda n: number < n),
        ("maximum", "number", lambda n: number > n),
        ("minItems", "array", lambda n: F.size(items) < n),
        ("maxItems", "array", lambda n: F.size(items) > n),
    ):
        if key in schema:
            out.append(broken((kind == about) & bad(schema[key]), f"{key} {schema[key]}"))
    # Keys and items are asked for only where there are some: other values make empty arrays.
    if isinstance(schema.get("items"), dict):
        found = F.flatten(F.transform(items, lambda x, i: below(schema["items"], x, F.concat(pointer, F.lit("/"), i.cast("string")))))
        out.append(F.when(kind == "array", F.coalesce(found, _none())).otherwise(_none()))
    named = schema.get("properties", {})
    for name in schema.get("required", []):
        out.append(broken((kind == "object") & ~F.map_contains_key(fields, name), "is required", F.concat(pointer, F.lit(f"/{name}"))))
    for name, sub in named.items():
        out.append(F.when(kind == "object", below(sub, F.try_element_at(fields, F.lit(name)), F.concat(pointer, F.lit(f"/{name}")))).otherwise(_none()))
    if isinstance(more := schema.get("additionalProperties"), dict):
        extra = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(list(named)) if named else F.lit(True))
        found = F.flatten(F.transform(extra, lambda e: below(more, e["value"], F.concat(pointer, F.lit("/"), e["key"]))))
        out.append(F.when(kind == "object", F.coalesce(found, _none())).otherwise(_none()))
    out.extend(below(sub, value, pointer) for sub in schema.get("allOf", []))
    if "anyOf" in schema:
        some = F.lit(False)
        for sub in schema["anyOf"]:
            some = some | (F.size(below(sub, value, pointer)) == 0)
        out.append(broken(~some, "matches none of anyOf"))
    if "if" in schema:
        holds = F.size(below(schema["if"], value, pointer)) == 0
        out.append(F.when(holds, below(schema.get("then", {}), value, pointer)).otherwise(below(schema.get("else", {}), value, pointer)))
    rest = F.concat(*out) if out else _none()
    types = schema.get("type")
    if types is None:
        return F.when(value.isNull(), _none()).otherwise(rest)
    types = [types] if isinstance(types, str) else types
    fits = kind.isin(*[t for t in types if t != "integer"])
    if "integer" in types:
        fits = fits | ((kind == "number") & (number == F.rint(number)))
    wrong = broken(~fits, F.concat(F.lit(f"must be {' or '.join(types)}, is "), kind))
    return F.when(value.isNull(), _none()).when(fits, rest).otherwise(wrong)


def violations(rows: DataFrame, schema: dict, json_col: str, *keys: str) -> DataFrame:
    """(keys, pointer, message): the rules that the JSON text of each row breaks.

    Text that is no JSON is one violation of the whole value, and so is a null.  Repeated rows are reported one by one.
    """
    parsed = rows.select(*keys, F.try_parse_json(F.col(json_col)).alias("_v"))
    not_json = F.array(F.struct(F.lit("/").alias("pointer"), F.lit("is not JSON").alias("message")))
    found = parsed.select(*keys, F.when(F.col("_v").isNull(), not_json).otherwise(compile_variant(schema, F.col("_v"))).alias("_x"))
    return found.select(*keys, F.explode_outer("_x").alias("_x")).filter("_x is not null").select(*keys, "_x.pointer", "_x.message")
