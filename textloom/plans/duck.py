"""Fragments of DuckDB SQL that mirror the Column functions; used to check them."""

from __future__ import annotations

import json

from textloom.functions import text as T
from textloom.functions.regex import B


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re(pattern: str) -> str:
    """A pattern of this library, for RE2: its word boundaries are ASCII already."""
    return q(pattern.replace(B, r"\b"))


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _fields(ddl: str) -> list[str]:
    """Fields of a DDL string: cut at commas outside brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _shape(kind: str):
    """A DDL type as DuckDB's JSON functions name it."""
    kind = kind.strip()
    inner = kind[kind.find("<") + 1 : -1]
    if kind.startswith("array<"):
        return [_shape(inner)]
    if kind.startswith("map<"):
        return "MAP(" + ",".join(_TYPES[x] for x in _fields(inner)) + ")"
    if kind.startswith("struct<"):
        return {n.strip(): _shape(k) for n, _, k in (f.partition(":") for f in _fields(inner))}
    return _TYPES[kind]


def rows(values: list[dict], ddl: str) -> str:
    """A subquery with the rows that sources.tables.literal gives Spark."""
    shape = {n: _shape(k) for n, _, k in (f.partition(" ") for f in _fields(" ".join(ddl.split())))}
    return f"(SELECT unnest(r) FROM (SELECT unnest(from_json({q(json.dumps(values))}, {q(json.dumps([shape]))})) AS r))"


def whole(t: str = "text") -> str:
    return f"coalesce({t}, '')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {re(pattern)}))"


def extract(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {re(pattern)})"


def trim(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def rnd(x: str, d: int) -> str:
    f = float(10**d)
    return f"(floor(({x}) * {f}::DOUBLE + 0.5::DOUBLE) / {f}::DOUBLE)"


def sentences(t: str = "text") -> str:
    x = rf"regexp_replace(regexp_replace({whole(t)}, '\r\n?', chr(10), 'g'), '\n+', ' ' || chr(10) || ' ', 'g')"
    x = rf"regexp_replace({trim(x)}, '(?:^|\n)\s*[-*•]\s+', chr(1) || '- ', 'g')"
    x = rf"regexp_replace({x}, '(^|\n|[.!?]\s)\s*(\d{{1,2}})\.\s+', '\1\2' || chr(2) || chr(1), 'g')"
    x = rf"regexp_replace({x}, '(^|\n|[.!?]\s)\s*(\d{{1,2}})\)\s+', '\1\2' || chr(1), 'g')"
    x = rf"""regexp_replace({x}, '([.!?])\s+([A-Z0-9"''(\[]|\x01)', '\1' || chr(3) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({x}, chr(3)), lambda s: {trim('translate(s, chr(1) || chr(2), chr(32) || chr(46))')}), lambda s: s <> '')"


def lengths(t: str = "text") -> str:
    return f"list_transform({sentences(t)}, lambda s: {count('s', T.WORD)})"


def total(a: str) -> str:
    return f"coalesce(list_sum({a}), 0)"


def mean(a: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN {total(a)}::DOUBLE / len({a}) ELSE 0.0::DOUBLE END"


def median(a: str) -> str:
    s = f"list_sort({a})"
    return f"CASE WHEN len({a}) > 0 THEN ({s}[(len({a}) + 1) // 2] + {s}[len({a}) // 2 + 1]) / 2.0::DOUBLE ELSE 0.0::DOUBLE END"


def stdev(a: str) -> str:
    n = f"len({a})"
    return f"CASE WHEN {n} > 1 THEN sqrt(CAST({n} * CAST({total(f'list_transform({a}, lambda v: v * v)')} AS BIGINT) - CAST({total(a)} AS BIGINT) * CAST({total(a)} AS BIGINT) AS DOUBLE) / ({n} * ({n} - 1))) ELSE 0.0::DOUBLE END"


def variation(a: str) -> str:
    return f"CASE WHEN {total(a)} > 0 THEN ({stdev(a)}) / ({mean(a)}) ELSE 0.0::DOUBLE END"


def pronouns(which: str, t: str = "text") -> str:
    return rf"len(regexp_extract_all({whole(t)}, {q('(?i)' + chr(92) + 'b(?:' + which + ')' + chr(92) + 'b')}))"


def paragraphs(t: str = "text") -> str:
    return rf"list_filter(list_transform(string_split_regex({whole(t)}, '\n\s*\n'), lambda p: {trim('p')}), lambda p: p <> '')"


def first_line(t: str = "text") -> str:
    return f"coalesce(list_filter(list_transform(string_split({whole(t)}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')[1], '')"


def sentence_at(t: str, at: str, size: str) -> str:
    """The sentence around `size` characters from the 0-based place `at` on, white space collapsed."""
    return rf"trim(regexp_replace(string_split(substr({t}, 1, {at}), '.')[-1] || substr({t}, {at} + 1, {size}) || string_split(substr({t}, {at} + {size} + 1), '.')[1], '\s+', ' ', 'g'))"


def numbers(t: str = "text") -> str:
    return rf"regexp_extract_all({whole(t)}, '(?i)\b[0-9][0-9,.]*\s?(?:{T.UNITS}|k|m|bn)?\b')"


def claim_numbers(t: str = "text") -> str:
    return rf"list_transform(regexp_extract_all({whole(t)}, '(?i)\b[0-9]+(?:[.,][0-9]+)?\s?(?:{T.UNITS})?\b'), lambda x: {trim('x')})"


def imperatives(t: str = "text") -> str:
    return rf"list_filter({sentences(t)}, lambda s: regexp_matches(s, '(?i)^(?:[0-9]{{1,2}}[.)]\s+|[-*•]\s+)?(?:{T.VERBS})\b'))"


def normalised(t: str = "text") -> str:
    return rf"regexp_replace(translate(lower({whole(t)}), '‘’“”–—', chr(39) || chr(39) || chr(34) || chr(34) || '--'), '\s+', ' ', 'g')"


def hook_key(t: str = "text") -> str:
    return trim(f"regexp_replace(lower({first_line(t)}), '[^a-z0-9 ]', '', 'g')")


def words(t: str) -> str:
    return extract(t, T.WORD)


def grams(t: str = "text", n: int = 4) -> str:
    w = words(f"lower({whole(t)})")
    return f"(SELECT list_distinct(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) FROM (SELECT {w} AS w))"


EMOJI = T.EMOJI
STYLE = {
    "chars": f"length({whole()})",
    "words": count(whole(), T.WORD),
    "sentences": "len(l)",
    "mean_sentence_words": rnd(mean("l"), 2),
    "median_sentence_words": rnd(median("l"), 2),
    "length_variance": rnd(variation("l"), 3),
    "paragraphs": f"len({paragraphs()})",
    "emoji": count(whole(), T.EMOJI),
    "hashtags": count(whole(), T.HASHTAG),
    "questions": count(whole(), r"\?"),
    "numbers": f"len({numbers()})",
    "first_person": pronouns(T.FIRST),
    "second_person": pronouns(T.SECOND),
    "third_person": pronouns(T.THIRD),
    **{k: count(whole(), p) for k, p in T.COUNTS.items()},
    "contractions": rf"len(regexp_extract_all({whole()}, '(?i)\b[A-Za-z0-9_]+''(?:s|t|re|ve|ll|d|m)\b'))",
}


def style(source: str = "documents", keep: str = "doc_id, source, text") -> str:
    """A subquery with keep and the style fields."""
    return f"(SELECT * EXCLUDE (l), {', '.join(f'{v} AS {k}' for k, v in STYLE.items())} FROM (SELECT {keep}, {lengths()} AS l FROM {source}))"
