"""Data quality: references, gaps and a JSON-Schema compiler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, name: str) -> DataFrame:
    """(reference, value, n): values of a key that the target doesn't have; values are counted before they are joined."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(target.select(F.col(target_key).alias("value")).distinct(), "value", "left_anti").select(F.lit(name).alias("reference"), F.col("value").cast("string").alias("value"), "n")


VIOLATIONS = "array<struct<pointer:string,message:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {VIOLATIONS})")


def compile_schema(schema: dict, value: Column, kind: T.DataType, pointer: Column | None = None, root: dict | None = None) -> list[Column]:
    """Columns of array<struct<pointer, message>>, one for each rule of a JSON Schema, over a value of Spark type kind.

    Keywords: type, const, enum, minLength, maxLength, pattern, minimum, maximum, minItems, maxItems, items, required,
    properties, additionalProperties (a schema, for fields of structs and keys of maps that properties doesn't name), allOf, anyOf,
    if/then/else and local $ref.  A null of another type fails `type` and nothing else; format is not checked.
    An item's pointer ends in its number from 0.
    """
    root = root or schema
    pointer = F.lit("") if pointer is None else pointer
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return compile_schema(target, value, kind, pointer, root)
    out: list[Column] = []
    below = lambda sub, v, k, p: F.concat(*(compile_schema(sub, v, k, p, root) or [_none()]))
    at = lambda name: F.concat(pointer, F.lit("/"), name.cast("string") if isinstance(name, Column) else F.lit(name))

    def rule(bad: Column, message: str, where: Column | None = None) -> None:
        here = F.when(pointer == "", F.lit("/")).otherwise(pointer) if where is None else where
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(here.alias("pointer"), F.lit(message).alias("message")))).otherwise(_none()))

    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    if types and "null" not in types:
        rule(value.isNull(), f"must be {' or '.join(types)}")
    if "const" in schema:
        rule(value != F.lit(schema["const"]), f"must be {schema['const']}")
    if "enum" in schema:
        rule(~value.isin(*[x for x in schema["enum"] if x is not None]), "must be one of the listed values")
    for key, bad in (
        ("minLength", lambda n: F.length(value) < n),
        ("maxLength", lambda n: F.length(value) > n),
        ("pattern", lambda p: ~value.rlike(p)),
        ("minimum", lambda n: value < n),
        ("maximum", lambda n: value > n),
        ("minItems", lambda n: F.size(value) < n),
        ("maxItems", lambda n: F.size(value) > n),
    ):
        if key in schema:
            rule(bad(schema[key]), f"{key} {schema[key]}")
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    for name in schema.get("required", []):
        rule(value.isNotNull() & (value.getField(name).isNull() if name in fields else F.lit(True)), "is required", at(name))
    named = schema.get("properties", {})
    more = schema.get("additionalProperties")
    for name, type_ in fields.items():
        sub = named.get(name, more if isinstance(more, dict) else None)
        if sub is not None:
            field = value.getField(name)
            # What is absent is the business of `required`.
            out.append(F.when(field.isNotNull(), below(sub, field, type_, at(name))).otherwise(_none()))
    if isinstance(kind, T.MapType) and isinstance(more, dict):
        extra = F.filter(F.map_entries(value), lambda e: ~e["key"].isin(list(named)) if named else F.lit(True))
        out.append(F.coalesce(F.flatten(F.transform(extra, lambda e: below(more, e["value"], kind.valueType, at(e["key"])))), _none()))
    if "items" in schema and isinstance(kind, T.ArrayType):
        out.append(F.coalesce(F.flatten(F.transform(value, lambda x, i: below(schema["items"], x, kind.elementType, at(i)))), _none()))
    for sub in schema.get("allOf", []):
        out.extend(compile_schema(sub, value, kind, pointer, root))
    valid = lambda sub: F.size(below(sub, value, kind, pointer)) == 0
    if "anyOf" in schema:
        some = F.lit(False)
        for sub in schema["anyOf"]:
            some = some | valid(sub)
        rule(~some, "matches none of anyOf")
    if "if" in schema:
        holds = valid(schema["if"])
        out.append(F.when(holds, below(schema.get("then", {}), value, kind, pointer)).otherwise(below(schema.get("else", {}), value, kind, pointer)))
    return out


def violations(rows: DataFrame, schema: dict, *keys: str) -> DataFrame:
    """(keys, pointer, message): the rules that a row breaks."""
    checks = compile_schema(schema, F.struct(*rows.columns), rows.schema)
    found = rows.select(*keys, F.explode_outer(F.concat(*(checks or [_none()]))).alias("_v"))
    return found.filter("_v is not null").select(*keys, "_v.pointer", "_v.message")
