"""Queries of the profile rubric and the import checks, over literal profiles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from textloom.functions import text as T
from textloom.operators import profiles as P
from textloom.plans import duck as D
from textloom.plans import fixtures as X
from textloom.plans.registry import fixture
from textloom.sources.tables import literal

_P = D.rows(X.PROFILES, X.PROFILE_DDL)
_HEAD, _ABOUT = "coalesce(headline, '')", "coalesce(about, '')"
_ROLES, _FEATURED = "coalesce(experience, [])", "coalesce(featured, [])"
_PARTS = f"list_filter(list_concat([headline, about], {{}}), lambda x: x IS NOT NULL AND x <> '')"
_LISTS = "coalesce(e.bullets, []::VARCHAR[])"
#: What a reader sees, and what the import reads.
_SEEN = f"array_to_string({_PARTS.format(f'list_concat(flatten(list_transform({_ROLES}, lambda e: list_concat([e.title, e.company], {_LISTS}))), list_transform({_FEATURED}, lambda f: concat_ws(chr(32), f.title, f.description)))')}, chr(10))"
_COPY = f"array_to_string({_PARTS.format(f'flatten(list_transform({_ROLES}, lambda e: list_concat([e.description], {_LISTS})))')}, chr(10))"


def _profiles(spark: SparkSession) -> DataFrame:
    return literal(spark, X.PROFILES, X.PROFILE_DDL)


def _any(items: str, name: str, condition: str) -> str:
    return f"len(list_filter({items}, lambda {name}: coalesce({condition}, false))) > 0"


def _matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {D.re(pattern)})"


# --- import checks
_NUM = rf"list_transform(regexp_extract_all(v, '(?i)\b\d[\d,]*(?:\.\d+)?\s?(?:{T.UNITS})?\b'), lambda x: {D.trim(f"regexp_replace({D.trim('x')}, '[,.]+$', '')")})"
_YEAR = "regexp_matches(regexp_replace({}, '[^0-9]', '', 'g'), '^(19|20)[0-9]{{2}}$')"
_YEARS = f"list_filter(list_transform({_ROLES}, lambda e: regexp_extract(coalesce(e.period, concat_ws(' ', e.\"start\", e.\"end\")), '\\b(?:19|20)[0-9]{{2}}\\b')), lambda y: y <> '')"
_NAMES = "list_filter(string_split_regex(coalesce(custom_url_slug, ''), '[-_]'), lambda x: x <> '')"
_IMPORT = {
    "headline_present": "h <> ''",
    "headline_not_placeholder": f"h <> '' AND NOT {_matches('h', P.PLACEHOLDER)}",
    "headline_not_just_a_name": f"h <> '' AND NOT (len(string_split_regex(h, '\\s+')) <= 5 AND len({_NAMES}) > 0 AND len(list_filter({_NAMES}, lambda x: NOT contains(lower({_HEAD}), lower(x)))) = 0)",
    "about_length_plausible": f"length({_ABOUT}) BETWEEN 500 AND 2600",
    "about_not_duplicate_headline": "NOT (a <> '' AND a = h)",
    "about_paragraph_structure": f"NOT (length({_ABOUT}) > 200 AND NOT contains({_ABOUT}, chr(10)) AND NOT regexp_matches({_ABOUT}, '\\s{{3,}}'))",
    "experience_monotonic": "len(list_filter(range(1, len(y)), lambda i: y[i + 1] > y[i])) = 0",
    "experience_has_detail": _any(_ROLES, "e", "coalesce(len(e.bullets), 0) > 0 OR length(coalesce(e.description, '')) > 20"),
    "experience_present": f"len({_ROLES}) > 0",
    "skills_present": "coalesce(len(skills), 0) > 0",
    "featured_parsed": f"NOT ({_any(_FEATURED, 'f', "coalesce(f.title, '') = '' AND coalesce(f.url, '') = '' AND coalesce(f.description, '') = ''")})",
    "contact_present": _any("coalesce(map_values(contact), [])", "c", "c <> ''"),
    "numbers_present": _any(_NUM, "x", f"NOT {_YEAR.format('x')}"),
    "no_template_leftovers": f"NOT ({_matches(_HEAD, P.TEMPLATE)} OR {_matches(_ABOUT, P.TEMPLATE)} OR {_any(_ROLES, 'e', _matches("coalesce(e.description, '')", P.TEMPLATE))})",
    "reads_as_individual": f"NOT {_matches(f"{_HEAD} || ' ' || {_ABOUT}", P.AGENCY)}",
}
_SEVERITY = {"about_length_plausible": f"CASE WHEN {_ABOUT} <> '' THEN 'warn' ELSE 'blocker' END"}
_CHECKED = (
    f"m AS MATERIALIZED (SELECT *, {D.trim(_HEAD)} AS h, {D.trim(_ABOUT)} AS a, {_YEARS} AS y, {_COPY} AS v FROM {_P} p), f AS ("
    + " UNION ALL ".join(f"SELECT id, '{c}' AS check_id, {_SEVERITY.get(c, f"'{s}'")} AS severity, coalesce({_IMPORT[c]}, false) AS passed FROM m" for c, s in P.IMPORT)
    + ")"
)


@fixture(f"WITH {_CHECKED} SELECT * FROM f")
def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verify_import(_profiles(spark))


@fixture(f"WITH {_CHECKED} SELECT id, count(*) FILTER (WHERE passed) AS passed, count(*) AS checks, CASE WHEN count(*) FILTER (WHERE NOT passed AND severity = 'blocker') > 0 THEN 'unsound' WHEN count(*) FILTER (WHERE NOT passed AND severity = 'warn') > 0 THEN 'usable_with_caveats' ELSE 'sound' END AS verdict FROM f GROUP BY id")
def import_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.import_verdict(P.verify_import(_profiles(spark)))


_AT = "length(string_split_regex(v, '\\b' || regexp_escape(value))[1])"


@fixture(f"""WITH t AS (SELECT DISTINCT id, v, unnest({_NUM}) AS value FROM (SELECT id, {_COPY} AS v FROM {_P} p))
 SELECT id, value, regexp_matches(value, '(?i)%|percent|x\\b|hours?|hrs?|days?|weeks?|months?|years?') AS has_unit, {_YEAR.format('value')} AS structural, {D.sentence_at('v', _AT, 'length(value)')} AS context FROM t""")
def number_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_contexts(_profiles(spark))


# --- profile rubric
_S = X.SETTINGS


def _has(t: str, needle: str | None) -> str:
    return f"contains(lower(coalesce({t}, '')), {D.q(needle.lower())})" if needle else "false"


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts or ["false"]) + ")"


_PREVIEW = f"substr({_ABOUT}, 1, 210)"
_BELIEVED = [e for e in _S["proof"] if e["claim"] and e["tier"]]
_NAMED = ", ".join(D.q(o["name"]) for o in _S["paid_offers"] if o["featured_slot"])
_STYLE = {k: v.replace("coalesce(text, '')", "seen") for k, v in D.STYLE.items()}
_NEAR = " + ".join(f"{w}::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(({_STYLE[k]}) - {_S['sample_style'][k]}::DOUBLE) / greatest(abs({_STYLE[k]}), {_S['sample_style'][k]}::DOUBLE, 1.0::DOUBLE)))" for k, w in T.STYLE_WEIGHTS)
_SLUG = "coalesce(custom_url_slug, '')"
_RUBRIC = {
    "pc1": _or([_has("headline", t) for t in _S["role_titles"]]),
    "pc2": _has("headline", _S["primary_keyword"]),
    "pc3": f"regexp_matches({_HEAD}, '(?i)\\b(for|that|so that|helps?|enables?|which)\\b') OR {_any('n', 'x', f"x <> '' AND contains({_HEAD}, x)")}",
    "pc4": f"NOT regexp_matches({_PREVIEW}, '(?i)\\b(I|my|me)\\b') AND ({_has(_PREVIEW, _S['problem'])} OR {_has(_PREVIEW, _S['method'])})",
    "pc5": _or([_has("headline", _S["method"]), _has(_PREVIEW, _S["method"])]),
    "pc6": _has("about", _S["differentiator"]),
    "ps1": "len(list_distinct(list_filter(n, lambda x: NOT regexp_matches(x, '^[0-9]{4}$')))) >= 3",
    "ps2": f"len(list_filter({_ROLES}[1:3], lambda e: NOT coalesce(len(e.bullets) > 0 AND len(list_filter(e.bullets, lambda b: regexp_matches(b, '[0-9]'))) >= 0.6 * len(e.bullets), false))) = 0",
    "ps3": _any(_FEATURED, "f", "contains(lower(coalesce(f.kind, '')), 'case') OR regexp_matches(coalesce(f.title, ''), '(?i)case study')"),
    "ps4": str(bool(_BELIEVED) and all(e["source"] and not (_S["require_permission"] and e["permission"] == "requested") for e in _BELIEVED)).lower(),
    "sc1": _has("headline", _S["primary_keyword"]),
    "sc2": _or([_has(_PREVIEW, k) for k in _S["secondary_keywords"]]),
    "sc3": _any("coalesce(skills, [])[1:3]", "s", _has("s", _S["primary_keyword"])),
    "sc4": f"{_SLUG} <> '' AND NOT regexp_matches({_SLUG}, '^[0-9]+$') AND NOT regexp_matches(coalesce(publicIdentifier, ''), '^[0-9]{{5,}}$')",
    "cm1": "true", "cm2": "true",
    "cm3": f"length({_ABOUT}) >= 500",
    "cm4": f"len({_ROLES}) >= 3",
    "cm5": "coalesce(len(education), 0) + coalesce(len(licenses), 0) >= 1",
    "cm6": f"len({_FEATURED}) >= 5",
    "cm7": _any("coalesce(map_values(contact), [])", "c", "c <> ''"),
    "rb1": f"length({_HEAD}) BETWEEN 1 AND 220",
    "rb2": f"length({_ABOUT}) BETWEEN 1 AND 2600 AND regexp_matches({_PREVIEW}, '[.!?…,;:—-]\\s*$')",
    "rb3": f"coalesce(list_max(list_transform({D.paragraphs('about')}, lambda x: length(x))), 0) <= 180",
    "rb4": f"{D.mean('l')} <= 20",
    "cv1": f"{_or([_matches(_ABOUT, c) for c in P.CALLS])} AND NOT {_or([_matches(_ABOUT, '(?i)' + chr(92) + 'b' + re.escape(f)) for f in _S['forbid']])}",
    "cv2": "true",
    "cv3": _any(_FEATURED, "f", f"f.title IN ({_NAMED})"),
    "cv4": "true",
    "pcx1": f"NOT {_or([_has('seen', w) for w in _S['avoid']])}",
    "pcx2": " + ".join(f"{_or([_has('seen', w) for w in re.split(r'\W+', x.lower()) if len(w) > 4])}::INT" for x in _S["promises"]) + " >= 2",
    "pcx3": f"{D.rnd('0.0::DOUBLE + ' + _NEAR, 3)} >= 0.6",
}
_SCORED = (
    f"q AS MATERIALIZED (SELECT *, {D.claim_numbers('seen')} AS n FROM (SELECT *, {_SEEN} AS seen, {D.lengths('about')} AS la FROM {_P} p)),"
    f" m AS MATERIALIZED (SELECT * EXCLUDE (la), la AS l, {D.lengths('seen')} AS ls FROM q), f AS ("
    + " UNION ALL ".join(
        f"SELECT id, '{c.id}' AS check_id, {i} AS rubric_pos, '{c.dimension}' AS dimension, '{c.severity}' AS severity, {c.points} AS points, coalesce({_RUBRIC[c.id]}, false) AS passed FROM "
        + ("m" if c.id != "pcx3" else "(SELECT * EXCLUDE (l, ls), ls AS l FROM m)")
        for i, c in enumerate(P.RUBRIC)
    )
    + ")"
)


@fixture(f"WITH {_SCORED} SELECT * FROM f")
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_profiles(_profiles(spark), X.SETTINGS)[0].drop("judged", "measured")


_BAND = "CASE " + " ".join(f"WHEN score BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in P.BANDS) + " ELSE 'unclassified' END"


@fixture(f"WITH {_SCORED}, t AS (SELECT id, sum(CASE WHEN passed THEN points ELSE 0 END)::BIGINT AS score, count(*) FILTER (WHERE severity = 'blocker' AND NOT passed) AS b FROM f GROUP BY id) SELECT id, score, CASE WHEN b > 0 THEN least(score, 59) ELSE score END AS total, b > 0 AND score > 59 AS capped, {_BAND} AS band FROM t")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_profiles(_profiles(spark), X.SETTINGS)[1]
