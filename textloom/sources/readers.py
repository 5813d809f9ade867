"""Readers: posts as JSON lines and files, voice samples, and settings in a YAML subset."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.regex import trim
from textloom.sources.tables import literal


def parse_history(lines: DataFrame, column: str = "value") -> DataFrame:
    """Posts of JSON lines: objects with a text, or bare strings.  Lines that don't parse or have no text are dropped.

    Works on batches and streams alike.  Columns: id, text, pillar, archetype, proof_refs, seq.
    """
    v = lines.select(*[c for c in lines.columns if c != column], F.try_parse_json(column).alias("_v")).filter("_v is not null")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    text = F.when(F.schema_of_variant("_v").startswith("OBJECT"), get("$.text", "string")).otherwise(get("$", "string"))
    kept = [c for c in lines.columns if c != column]
    out = v.select(*kept, get("$.id", "string").alias("id"), text.alias("text"), get("$.pillar", "string").alias("pillar"), get("$.archetype", "string").alias("archetype"), get("$.proof_refs", "array<string>").alias("proof_refs"), get("$.seq", "bigint").alias("seq"))
    return out.filter("text is not null")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_history(spark.read.text(path))


def read_drafts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All *.json files of a folder, one post each; unreadable ones are dropped."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED").option("multiLine", True).json(folder)


def voice_samples(text: Column) -> Column:
    """array<string>: sections under '## Sample N' headings, without comments and rules, of 80 characters or more."""
    parts = F.slice(F.split(text, r"(?m)^##\s+Sample\s+\d+\s*$"), 2, 10_000)
    body = lambda s: trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?s)\n##.*$", ""), r"(?s)<!--.*?-->", ""), r"(?m)^---\s*$", ""))
    return F.filter(F.transform(parts, body), lambda s: F.length(s) >= 80)


class SettingsError(ValueError):
    pass


def load_settings(source: str):
    """A settings file: nested maps and lists by indentation, flow lists, quoted and block scalars, comments.

    Anchors, aliases, tags, several documents, flow maps that aren't empty, complex keys and tabs raise SettingsError.
    """
    lines = source.replace("\r\n", "\n").split("\n")
    rows: list[tuple[int, str, int]] = []
    for i, raw in enumerate(lines):
        if re.match(r" *\t", raw):
            raise SettingsError(f"line {i + 1}: tab")
        body = _uncommented(raw)
        if body.strip() == "---" and not rows:
            continue
        if body.strip() in ("---", "..."):
            raise SettingsError(f"line {i + 1}: several documents")
        if body.strip():
            rows.append((len(body) - len(body.lstrip(" ")), body.strip(), i))
    value, at = _block(rows, 0, rows[0][0] if rows else 0, lines)
    if at < len(rows):
        raise SettingsError(f"line {rows[at][2] + 1}: indentation")
    return value


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(s: str):
    s = s.strip()
    if s[:1] in "&*!":
        raise SettingsError(f"not supported: {s}")
    if s[:1] == "?" and s[1:2] in ("", " "):
        raise SettingsError(f"complex key: {s}")
    if s[:1] == "{":
        if s.replace(" ", "") != "{}":
            raise SettingsError(f"flow map: {s}")
        return {}
    if s[:1] == "[":
        if s[-1] != "]":
            raise SettingsError(f"open list: {s}")
        return [_scalar(x) for x in _split(s[1:-1])]
    if len(s) > 1 and s[0] == s[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1])
    if len(s) > 1 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    low = s.lower()
    if low in ("", "~", "null"):
        return None
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", s):
        return float(s)
    return s


def _split(s: str) -> list[str]:
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[begin:i])
            begin = i + 1
    return [x for x in [*out, s[begin:]] if x.strip()]


def _key(s: str) -> tuple[str, str] | None:
    m = re.match(r"""("[^"]*"|'[^']*'|[^\s"'\[{][^:]*?(?::[^\s:][^:]*?)*)\s*:(?:\s+(.*)|$)""", s)
    return (str(_scalar(m[1])) if m[1][0] in "\"'" else m[1], m[2] or "") if m else None


def _block(rows: list, at: int, indent: int, lines: list[str]):
    if at >= len(rows):
        return None, at
    if rows[at][1] == "-" or rows[at][1].startswith("- "):
        out = []
        while at < len(rows) and rows[at][0] == indent and (rows[at][1] == "-" or rows[at][1].startswith("- ")):
            rest = rows[at][1][1:].strip()
            if not rest:
                value, at = _block(rows, at + 1, rows[at + 1][0], lines) if at + 1 < len(rows) and rows[at + 1][0] > indent else (None, at + 1)
            elif _key(rest) and rest[0] not in "[{":
                inner = indent + len(rows[at][1]) - len(rest)
                rows[at] = (inner, rest, rows[at][2])
                value, at = _block(rows, at, inner, lines)
            else:
                value, at = _value(rest, rows, at, indent, lines)
            out.append(value)
        return out, at
    if _key(rows[at][1]) is None:
        return _scalar(rows[at][1]), at + 1
    out = {}
    while at < len(rows) and rows[at][0] == indent and (found := _key(rows[at][1])):
        key, rest = found
        if rest:
            out[key], at = _value(rest, rows, at, indent, lines)
        elif at + 1 < len(rows) and (rows[at + 1][0] > indent or rows[at + 1][0] == indent and rows[at + 1][1].startswith("-")):
            out[key], at = _block(rows, at + 1, rows[at + 1][0], lines)
        else:
            out[key], at = None, at + 1
    return out, at


def _value(rest: str, rows: list, at: int, indent: int, lines: list[str]):
    if rest in ("|", ">", "|-", ">-", "|+", ">+"):
        first = rows[at][2] + 1
        end = first
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip(" ")) > indent):
            end += 1
        body = lines[first:end]
        pad = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
        body = [x[pad:] for x in body]
        while body and not body[-1].strip():
            body.pop()
        text = "\n".join(body) if rest[0] == "|" else " ".join(x.strip() for x in body)
        at += 1
        while at < len(rows) and rows[at][2] < end:
            at += 1
        return text + ("" if rest.endswith("-") else "\n"), at
    return _scalar(rest), at + 1


#: Settings files of a persona.
PERSONA_FILES = ("identity", "audience", "voice", "pov-map", "proof", "offers", "keywords")
RUBRIC_FILES = ("profile-rubric", "post-rubric", "brand-consistency")


def _files(spark: SparkSession, folder: str, pattern: str) -> dict[str, str]:
    """name -> whole text of a folder's files; empty if there is no such folder.  Spark reads them, so the folder may lie in any store."""
    try:
        rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select("_metadata.file_name", "value").collect()
    except AnalysisException:
        return {}
    return {r["file_name"]: r["value"] for r in rows}


def load_persona(spark: SparkSession, root: str) -> dict:
    """A persona's settings by file and its voice samples; a file that isn't there is None.

    root holds the files, or a folder named persona with them.
    """
    folder = f"{root.rstrip('/')}/persona"
    found = _files(spark, folder, "*.yaml")
    if not found:
        folder = root
        found = _files(spark, folder, "*.yaml")
    out: dict = {name: load_settings(found[f"{name}.yaml"]) if f"{name}.yaml" in found else None for name in PERSONA_FILES}
    text = _files(spark, folder, "voice-samples.md").get("voice-samples.md", "")
    out["voice-samples"] = spark.range(1).select(voice_samples(F.lit(text))).first()[0]
    return out


def load_rubric(spark: SparkSession, root: str) -> dict:
    """The three rubric documents in a folder, or in its folder named rubric; one that isn't there is None."""
    found = _files(spark, f"{root.rstrip('/')}/rubric", "*.yaml") or _files(spark, root, "*.yaml")
    return {name: load_settings(found[f"{name}.yaml"]) if f"{name}.yaml" in found else None for name in RUBRIC_FILES}


def persona_row(persona_id: str, persona: dict) -> dict:
    """The settings of load_persona as a row of operators.persona.PERSONA; parts that aren't there are null."""
    part = lambda name: persona.get(name) or {}
    identity, pov, proof, offers, voice = (part(x) for x in ("identity", "pov-map", "proof", "offers", "voice"))
    return {
        "persona_id": persona_id,
        "profile": identity.get("profile"), "positioning": identity.get("positioning"), "publish": identity.get("publish"),
        "primary_keyword": (part("keywords").get("primary") or {}).get("keyword"), "require_permission": (proof.get("policy") or {}).get("require_client_permission"),
        "proof": proof.get("entries"), "assets": proof.get("assets"), "beliefs": pov.get("beliefs"), "hot_takes": pov.get("hot_takes"), "pillars": pov.get("pillars"),
        "segments": part("audience").get("segments"), "primary_segment": part("audience").get("primary"), "ladder": offers.get("ladder"), "paid_offers": offers.get("paid_offers"),
        "voice": {"target_words": (voice.get("sentence") or {}).get("target_words"), "min_length_variance": (voice.get("sentence") or {}).get("min_length_variance"), "emoji": (voice.get("formatting") or {}).get("emoji") not in (None, False, "none", 0)} if voice else None,
        "samples": persona.get("voice-samples"),
    }


def read_personas(spark: SparkSession, roots: dict[str, str], ddl: str) -> DataFrame:
    """One row for each persona id and root, typed by operators.persona.PERSONA."""
    return literal(spark, [persona_row(i, load_persona(spark, root)) for i, root in roots.items()], ddl)
