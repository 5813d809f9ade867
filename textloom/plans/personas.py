"""Queries of personas: gaps, references, publishing, voice, look-ups, over literal personas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import persona as P
from textloom.operators import sourcing as Q
from textloom.plans import duck as D
from textloom.plans import fixtures as X
from textloom.plans.registry import fixture, query
from textloom.sources.tables import literal

_P = D.rows(X.PERSONAS, X.PERSONA_DDL)


def _personas(spark: SparkSession) -> DataFrame:
    return literal(spark, X.PERSONAS, X.PERSONA_DDL)


def _blank(x: str) -> str:
    return f"coalesce({x}, '') = ''"


_THERE = "profile IS NOT NULL"
_FILLED = f"list_filter(coalesce(proof, []), lambda e: NOT ({_blank('e.claim')}) AND NOT ({_blank('e.tier')}))"
_IDS = "list_transform(coalesce({0}, []), lambda x: coalesce(x.id, ''))"
_GAPS = [
    ("identity", True, "profile IS NULL"),
    *[(f"profile.{k}", k != "timezone", f"{_THERE} AND {_blank(f'profile.{k}')}") for k in ("display_name", "role_title", "domain", "timezone")],
    ("profile.domain_format", True, f"NOT regexp_matches(profile.domain, '^[a-z0-9]+(-[a-z0-9]+)*$') AND NOT ({_blank('profile.domain')})"),
    *[(f"positioning.{k}", True, f"{_THERE} AND {_blank(f'positioning.{k}')}") for k in ("statement", "problem", "method", "differentiator")],
    ("keywords.primary.keyword", True, f"{_THERE} AND {_blank('primary_keyword')}"),
    ("proof.entries", False, f"{_THERE} AND len({_FILLED}) < 3"),
    ("offers.paid_offers", True, f"{_THERE} AND len(list_filter(coalesce(paid_offers, []), lambda o: NOT ({_blank('o.name')}) AND NOT ({_blank('o.outcome')}) AND NOT ({_blank('o.price_model')}))) = 0"),
    ("voice.samples", False, f"{_THERE} AND coalesce(len(samples), 0) < 3"),
    ("pov-map.beliefs", False, f"{_THERE} AND len(list_filter(coalesce(beliefs, []), lambda b: NOT ({_blank('b.claim')}))) < 3"),
    ("pov-map.pillars.weight_sum", True, f"{_THERE} AND abs(coalesce(list_sum(list_transform(pillars, lambda x: coalesce(x.weight, 0))), 0) - 1) > 0.02"),
]


def _each(part: str, gap: str, blocks: bool, condition: str) -> str:
    return f"SELECT persona_id, {gap} AS gap, {str(blocks).lower()} AS blocks FROM (SELECT persona_id, require_permission, unnest({part}) AS e FROM p) WHERE {condition}"


def _refs(part: str, refs: str, known: str, name: str, more: str) -> str:
    """References of a part's entries that are not among the known ids."""
    return f"SELECT persona_id, {name} || ' -> ' || r AS {more} FROM (SELECT persona_id, known, e, unnest({refs}) AS r FROM (SELECT persona_id, {known} AS known, unnest(coalesce({part}, [])) AS e FROM p)) WHERE NOT list_contains(known, r)"


_GAP_ROWS = f"p AS MATERIALIZED (SELECT * FROM {_P} x), g AS (" + " UNION ALL ".join(
    [f"SELECT persona_id, '{g}' AS gap, {str(b).lower()} AS blocks FROM p WHERE {c}" for g, b, c in _GAPS]
    + [
        _each(_FILLED, "'proof.' || e.id || '.source'", True, _blank("e.source")),
        _each(_FILLED, "'proof.' || e.id || '.permission'", False, "coalesce(require_permission, false) AND coalesce(e.permission, '') = 'requested'"),
        _each("coalesce(ladder, [])", "'offers.' || e.id || '.cta_text'", True, _blank("e.cta_text")),
        _refs("pillars", "e.maps_to_beliefs", _IDS.format("beliefs"), "'pov-map.' || e.id || '.maps_to_beliefs'", "gap, true AS blocks"),
        _each("coalesce(beliefs, [])", "'pov-map.' || e.id || '.evidence_refs'", False, "coalesce(e.confidence, '') = 'high' AND coalesce(len(e.evidence_refs), 0) = 0"),
    ]
) + ")"


@fixture(f"WITH {_GAP_ROWS} SELECT * FROM g")
def persona_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gaps(_personas(spark))


_EVIDENCE = _IDS.format("proof")


@fixture(f"WITH p AS (SELECT * FROM {_P} x) " + " UNION ALL ".join([
    _refs("beliefs", "e.evidence_refs", _EVIDENCE, "'belief ' || coalesce(e.id, '')", "reference, 'blocker' AS severity"),
    _refs("hot_takes", "e.evidence_refs", _EVIDENCE, "'hot take ' || coalesce(e.id, '')", "reference, 'warn' AS severity"),
    _refs("paid_offers", "e.proof_refs", _EVIDENCE, "'offer ' || coalesce(e.name, '')", "reference, 'warn' AS severity"),
    _refs("assets", "e.proof_refs", f"list_concat({_EVIDENCE}, {_IDS.format('assets')})", "'asset ' || coalesce(e.id, '')", "reference, 'warn' AS severity"),
    f"SELECT persona_id, 'audience.primary', 'blocker' FROM p WHERE NOT list_contains({_IDS.format('segments')}, coalesce(primary_segment, '?'))",
    _refs("ladder", "e.serves", _IDS.format("pillars"), "'rung ' || coalesce(CAST(e.rung AS VARCHAR), '')", "reference, 'warn' AS severity"),
]))
def persona_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.references(_personas(spark))


_AUTO = "coalesce(publish.mode, '') = 'auto'"


@fixture(f"WITH {_GAP_ROWS} SELECT persona_id, 'auto_needs_no_approval' AS rule, 'warn' AS severity FROM p WHERE {_AUTO} AND coalesce(publish.approval_required, false) UNION ALL SELECT persona_id, 'auto_without_timezone', 'blocker' FROM p WHERE {_AUTO} AND {_blank('profile.timezone')} UNION ALL SELECT persona_id, 'auto_with_gaps', 'blocker' FROM p WHERE {_AUTO} AND persona_id IN (SELECT persona_id FROM g WHERE blocks)")
def persona_publishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.publishing(_personas(spark))


_VOICED = D.style(f"(SELECT persona_id, voice, unnest(samples) AS text FROM {_P} x)", "persona_id, voice, text")


@fixture(f"""WITH a AS (SELECT persona_id, any_value(voice) AS voice, count(*) AS n, avg(mean_sentence_words) AS m, avg(length_variance) AS v, count(*) FILTER (WHERE emoji > 0)::DOUBLE AS e, count(*) FILTER (WHERE hashtags > 0)::DOUBLE AS h FROM {_VOICED} GROUP BY persona_id),
 b AS (SELECT *, coalesce(voice.target_words, 14.0) AS target, abs(m - coalesce(voice.target_words, 14.0)) / coalesce(voice.target_words, 14.0) AS off FROM a)
 SELECT persona_id, 'voice.mean_sentence_words' AS finding, CASE WHEN off > 0.7 THEN 'blocker' ELSE 'warn' END AS severity, {D.rnd('m', 3)} AS measured FROM b WHERE off > 0.4
 UNION ALL SELECT persona_id, 'voice.length_variance', 'warn', {D.rnd('v', 3)} FROM b WHERE v < coalesce(voice.min_length_variance, 0.35)
 UNION ALL SELECT persona_id, 'voice.emoji_conflict', 'warn', e FROM b WHERE NOT coalesce(voice.emoji, false) AND e > 0
 UNION ALL SELECT persona_id, 'voice.hashtag_usage', 'nice', h FROM b WHERE h < n / 2""")
def persona_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.voice(_personas(spark))


_ASKED = "(SELECT persona_id, unnest(['h0', 'h2', 'h7', 'h99']) AS ref FROM p)"


@fixture(f"WITH p AS (SELECT * FROM {_P} x), e AS (SELECT persona_id, unnest(proof) AS e FROM p) SELECT a.persona_id, a.ref, e.e.claim AS claim, e.e.permission AS permission FROM {_ASKED} a LEFT JOIN e ON a.persona_id = e.persona_id AND a.ref = e.e.id")
def proof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _personas(spark)
    asked = people.select("persona_id", F.explode(F.array(*map(F.lit, ("h0", "h2", "h7", "h99")))).alias("ref"))
    return P.lookup(asked, people, "proof").select("persona_id", "ref", F.col("entry.claim").alias("claim"), F.col("entry.permission").alias("permission"))


@fixture(f"WITH p AS (SELECT * FROM {_P} x), e AS (SELECT persona_id, unnest(segments) AS e FROM p) SELECT p.persona_id, primary_segment AS ref, e.e.id IS NOT NULL AS found FROM p LEFT JOIN e ON p.persona_id = e.persona_id AND p.primary_segment = e.e.id")
def primary_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primary_segment(_personas(spark)).select("persona_id", "ref", F.col("entry").isNotNull().alias("found"))


_NUMBER = r"'\b\d+(?:[.,]\d+)?\b'"
_TEXTS = "concat_ws(chr(10), claim, context, subject, source, period, metric.unit, metric.period, metric.baseline)"
KNOWN = f"(SELECT DISTINCT unnest(list_concat(regexp_extract_all({_TEXTS}, {_NUMBER}), CASE WHEN metric.value IS NULL THEN [] WHEN metric.value = floor(metric.value) THEN [CAST(CAST(metric.value AS BIGINT) AS VARCHAR)] ELSE [CAST(metric.value AS VARCHAR)] END)) AS value FROM {D.rows(X.PROOF, X.PROOF_DDL)} x)"


def known(spark: SparkSession) -> DataFrame:
    return Q.registry_numbers(literal(spark, X.PROOF, X.PROOF_DDL), "metric", "claim", "context", "subject", "source", "period")


@fixture(f"SELECT value FROM {KNOWN}")
def known_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known(spark)


@fixture(f"SELECT DISTINCT unnest(regexp_extract_all(concat_ws(chr(10), positioning.method, positioning.statement, profile.domain, profile.role_title, primary_keyword), {_NUMBER})) AS value FROM {_P} x")
def structural_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _personas(spark).select("positioning.method", "positioning.statement", "profile.domain", "profile.role_title", "primary_keyword")
    return Q.registry_numbers(names, *names.columns)


@query(f"SELECT doc_id, word, n, CAST(r AS INT) AS rank FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS r FROM (SELECT doc_id, unnest({D.words(f"lower({D.whole()})")}) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN ({', '.join(D.q(w) for w in T.STOPWORDS)}) GROUP BY doc_id, word) WHERE r <= 12")
def dominant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.lexicon import dominant
    from textloom.sources.tables import table

    return dominant(table(spark, sf_dir, "documents"))
