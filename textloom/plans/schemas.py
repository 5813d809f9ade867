"""Queries of JSON whose values may have wrong types: records of events and of turns of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import variants as V
from textloom.plans.registry import query
from textloom.sources.tables import table

# --- events: errors give their amount as text, a sign-up has no props, and the second tag of each is a number
EVENT = {
    "type": "object",
    "required": ["id", "amount", "props", "note"],
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "user": {"type": ["integer", "null"], "maximum": 120},
        "kind": {"enum": ["view", "click", "purchase", "signup"]},
        "amount": {"$ref": "#/definitions/amount"},
        "props": {"type": "object", "required": ["k"], "additionalProperties": {"type": "integer", "maximum": 7}},
        "tags": {"type": "array", "minItems": 2, "items": {"type": "string", "maxLength": 6}},
    },
    "if": {"properties": {"kind": {"const": "purchase"}}},
    "then": {"properties": {"amount": {"minimum": 5}}},
    "definitions": {"amount": {"type": "number", "maximum": 300}},
}


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.floor("value").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind: Column = F.col("event_type")
    parts = {
        "id": F.col("event_id").cast("string"),
        "user": F.col("user_id").cast("string"),
        "kind": quoted(kind),
        "amount": F.when(kind == "error", quoted(amount)).otherwise(amount),
        "props": F.when(kind == "signup", F.lit("null")).otherwise(F.col("props")),
        "tags": F.concat(F.lit("["), quoted(kind), F.lit(","), amount, F.lit("]")),
    }
    fields = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts.items()])
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("record"))


_RECORD = """(SELECT event_id, CAST('{"id":' || event_id || ',"user":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',"kind":' || coalesce('"' || event_type || '"', 'null')
 || ',"amount":' || coalesce(CASE WHEN event_type = 'error' THEN '"' || CAST(floor(value) AS BIGINT) || '"' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END, 'null') || ',"props":' || coalesce(CASE WHEN event_type = 'signup' THEN 'null' ELSE props END, 'null')
 || ',"tags":' || coalesce('["' || event_type || '",' || CAST(floor(value) AS BIGINT) || ']', 'null') || '}' AS JSON) AS j FROM events)"""
_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END"
_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _type(pointer: str, wanted: str, good: str) -> str:
    at = "j->'$" + pointer.replace("/", ".") + "'"
    return f"SELECT event_id, '{pointer}' AS pointer, 'must be {wanted}, is ' || {_KIND.format(at)} AS message FROM r WHERE json_type({at}) NOT IN {good}"


def _bound(pointer: str, message: str, bad: str, more: str = "") -> str:
    at = "j->'$" + pointer.replace("/", ".") + "'"
    return f"SELECT event_id, '{pointer}', '{message}' FROM r WHERE json_type({at}) IN {_NUMBERS} AND CAST({at} AS DOUBLE) {bad} {more}"


@query(f"WITH r AS MATERIALIZED (SELECT * FROM {_RECORD}), t AS (SELECT event_id, unnest(range(CAST(json_array_length(j->'$.tags') AS BIGINT))) AS i, j->'$.tags' AS a FROM r WHERE json_type(j->'$.tags') = 'ARRAY') " + " UNION ALL ".join([
    _type("/user", "integer or null", "('BIGINT', 'UBIGINT', 'NULL')"),
    _type("/amount", "number", _NUMBERS),
    _type("/props", "object", "('OBJECT')"),
    _bound("/id", "minimum 1", "< 1"),
    _bound("/user", "maximum 120", "> 120"),
    _bound("/amount", "maximum 300", "> 300"),
    _bound("/amount", "minimum 5", "< 5", "AND j->>'$.kind' = 'purchase'"),
    "SELECT event_id, '/note', 'is required' FROM r",
    "SELECT event_id, '/kind', 'must be one of the listed values' FROM r WHERE coalesce(j->>'$.kind', '') NOT IN ('view', 'click', 'purchase', 'signup')",
    "SELECT event_id, '/props/k', 'maximum 7' FROM r WHERE json_type(j->'$.props.k') IN ('BIGINT', 'UBIGINT') AND CAST(j->'$.props.k' AS BIGINT) > 7",
    f"SELECT event_id, '/tags/' || i, 'must be string, is ' || {_KIND.format('a->CAST(i AS INT)')} FROM t WHERE json_type(a->CAST(i AS INT)) <> 'VARCHAR'",
    "SELECT event_id, '/tags/' || i, 'maxLength 6' FROM t WHERE json_type(a->CAST(i AS INT)) = 'VARCHAR' AND length(a->>CAST(i AS INT)) > 6",
]))
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.violations(event_records(spark, sf_dir), EVENT, "record", "event_id")


# --- turns: assistants number theirs in text, and system turns have no length
TURN = {
    "type": "object",
    "required": ["turn", "body"],
    "properties": {
        "turn": {"type": "integer", "maximum": 5},
        "role": {"enum": ["user", "assistant"]},
        "body": {"type": "object", "required": ["text", "n"], "properties": {"text": {"type": "string", "minLength": 60, "maxLength": 900, "pattern": "[.]$"}, "n": {"type": "integer", "minimum": 50}}},
    },
    "anyOf": [{"properties": {"role": {"const": "user"}}}, {"properties": {"body": {"properties": {"text": {"minLength": 400}}}}}],
}


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.when(F.col("role") == "assistant", F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    # Null fields are left out by to_json, so they are absent and not null.
    body = F.to_json(F.struct("text", F.when(F.col("role") != "system", F.length("text")).alias("n")))
    record = F.concat(F.lit('{"turn":'), turn, F.lit(',"role":"'), F.col("role"), F.lit('","body":'), body, F.lit("}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("record"))


@query("""SELECT conv_id, turn, '/turn' AS pointer, 'must be integer, is string' AS message FROM conversations WHERE role = 'assistant'
 UNION ALL SELECT conv_id, turn, '/turn', 'maximum 5' FROM conversations WHERE role <> 'assistant' AND turn > 5 UNION ALL SELECT conv_id, turn, '/role', 'must be one of the listed values' FROM conversations WHERE role NOT IN ('user', 'assistant')
 UNION ALL SELECT conv_id, turn, '/body/text', 'is required' FROM conversations WHERE text IS NULL UNION ALL SELECT conv_id, turn, '/body/n', 'is required' FROM conversations WHERE role = 'system' OR text IS NULL
 UNION ALL SELECT conv_id, turn, '/body/text', 'minLength 60' FROM conversations WHERE length(text) < 60 UNION ALL SELECT conv_id, turn, '/body/text', 'maxLength 900' FROM conversations WHERE length(text) > 900
 UNION ALL SELECT conv_id, turn, '/body/text', 'pattern [.]$' FROM conversations WHERE NOT regexp_matches(text, '[.]$') UNION ALL SELECT conv_id, turn, '/body/n', 'minimum 50' FROM conversations WHERE role <> 'system' AND length(text) < 50
 UNION ALL SELECT conv_id, turn, '/', 'matches none of anyOf' FROM conversations WHERE role <> 'user' AND length(text) < 400""")
def turn_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.violations(turn_records(spark, sf_dir), TURN, "record", "conv_id", "turn")
