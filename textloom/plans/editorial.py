"""Queries of posts on their way out: hard blocks, gate, queue, calendar, drift of a history, and its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.phrases import HARD_BANS
from textloom.functions.text import claim_numbers
from textloom.operators import drift as H
from textloom.operators import planning as G
from textloom.operators import posts as P
from textloom.operators import sourcing as Q
from textloom.operators.lexicon import hook_families
from textloom.plans import duck as D
from textloom.plans import fixtures as X
from textloom.plans import history as Y
from textloom.plans import personas as U
from textloom.plans.lexicons import HOOK_SQL
from textloom.plans.registry import SQL, fixture, query
from textloom.sources import readers, sinks
from textloom.sources.tables import literal, table

_POSTS, _PROOF = D.rows(X.POSTS, X.POST_DDL), D.rows(X.PROOF, X.PROOF_DDL)
PUBLISHING = P.Publishing(mode="draft", approval_required=True, require_permission=True)


def _posts(spark: SparkSession) -> DataFrame:
    return literal(spark, X.POSTS, X.POST_DDL)


def _proof(spark: SparkSession) -> DataFrame:
    return literal(spark, X.PROOF, X.PROOF_DDL)


# --- hard blocks
_CLEAN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_TAKEN = f"""known AS {U.KNOWN}, p AS MATERIALIZED (SELECT * FROM {_POSTS} x), v AS (SELECT id, {D.whole()} AS t, {D.claim_numbers()} AS n FROM p),
 k AS (SELECT id, t, CAST(i - 1 AS INT) AS pos, n[i] AS value, regexp_replace(n[i], '[^0-9.,]', '', 'g') AS bare FROM (SELECT id, t, n, unnest(generate_series(1, len(n))) AS i FROM v)),
 o AS (SELECT id, pos, value, t, strpos(t, value) - 1 AS a FROM k WHERE bare <> '' AND NOT regexp_matches(bare, '{Q.STRUCTURAL}') AND bare NOT IN (SELECT value FROM known) AND value NOT IN (SELECT value FROM known)),
 c AS (SELECT row_number() OVER () AS r, id, pos, value, {D.trim("string_split(substr(t, 1, a), '.')[-1] || value || string_split(substr(t, a + length(value) + 1), '.')[1]")} AS claim FROM o),
 e AS (SELECT id AS entry, permission, list_distinct(list_filter(string_split({_CLEAN.format("coalesce(claim, '')")}, ' '), lambda x: length(x) > 3)) AS w FROM {_PROOF} y),
 s AS (SELECT r, entry, permission, len(list_filter(w, lambda x: contains({_CLEAN.format('claim')}, x)))::DOUBLE / len(w) AS s FROM c, e WHERE len(w) > 0),
 b AS (SELECT r, entry, permission, s FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, entry) AS i FROM s) WHERE i = 1 AND s >= 0.4)"""


@fixture(f"WITH {_TAKEN} SELECT id, pos, value, claim, entry, {D.rnd('s', 3)} AS score FROM c LEFT JOIN b USING (r)")
def nearest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = Q.unsourced(_posts(spark), U.known(spark), "id")
    return Q.nearest_claim(claims, _proof(spark), "id", "claim").select("id", "pos", "value", "claim", "entry", P.round_half_up(F.col("score"), 3).alias("score"))


_SELF = " OR ".join(f"contains(lower({D.whole()}), {D.q(p)})" for p in HARD_BANS if P.SELF.search(p))
_SIGNED = "len(list_filter(coalesce(approvals, []), lambda a: a.decision IN ('approved', 'edited'))) > 0"
_BLOCKS = f"""{_TAKEN}, n AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE permission IN ('requested', 'denied')) AS d FROM c LEFT JOIN b USING (r) GROUP BY id),
 hb AS (SELECT p.id, coalesce(n, 0) AS needs_source, concat_ws(',', CASE WHEN n > 0 THEN 'hb1' END, CASE WHEN d > 0 THEN 'hb2' END, CASE WHEN {_SELF} THEN 'hb3' END, CASE WHEN status = 'published' THEN 'hb5' END,
 CASE WHEN status IN ('queued', 'published') AND NOT ({_SIGNED}) AND NOT coalesce(gate_bypassed, false) THEN 'hb6' END) AS hard_blocks FROM p LEFT JOIN n USING (id))"""


@fixture(f"WITH {_BLOCKS} SELECT * FROM hb")
def hard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blocked(_posts(spark), U.known(spark), _proof(spark), PUBLISHING)


# --- gate and queue
def _gated(spark: SparkSession) -> DataFrame:
    posts = _posts(spark).join(hard_blocks(spark, "").select("id", "hard_blocks"), "id")
    signed = F.exists(F.coalesce("approvals", F.expr("array()")), lambda a: a["decision"].isin("approved", "edited"))
    ready = posts.withColumns({"approved": signed, "total": F.col("score.total"), "least_score": F.lit(75.0), "allowed_visibility": F.array(F.lit("PUBLIC")), "allowed_feed": F.array(F.lit("MAIN_FEED"))})
    return H.approved_rows(ready)


_GATE = f"""{_BLOCKS}, gate AS (SELECT p.*, hard_blocks, CASE WHEN status <> 'approved' THEN 'status is ' || status WHEN hard_blocks <> '' THEN 'hard blocks present: ' || hard_blocks WHEN NOT ({_SIGNED}) THEN 'no approval'
 WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 'empty text' WHEN score.total IS NULL THEN 'no score' WHEN score.total < 75 THEN 'score too low' WHEN visibility <> 'PUBLIC' THEN 'visibility not allowed' WHEN feed_distribution <> 'MAIN_FEED' THEN 'feed distribution not allowed' END AS reject_reason FROM p JOIN hb USING (id))"""


@fixture(f"WITH {_GATE} SELECT id, reject_reason FROM gate")
def queue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark).select("id", "reject_reason")


@fixture(f"WITH {_GATE} SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS exported, count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected FROM gate")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.status(_gated(spark)).select("exported", "rejected")


_CELLS = {
    "date": "substr(scheduled_for, 1, 10)", "time": "substr(scheduled_for, 12, 5)", "belief_refs": "array_to_string(belief_refs, ' ')", "proof_refs": "array_to_string(proof_refs, ' ')", "hook_family": "hook_pattern", "hook_brief": "notes", "body": "text", "image_url": "''",
    "visibility": "coalesce(visibility, 'PUBLIC')", "feed_distribution": "coalesce(feed_distribution, 'MAIN_FEED')", "score": "score.total", "published_at": "published.at", "published_url": "published.url",
    "approvals": """'[' || array_to_string(list_transform(approvals, lambda a: '{' || concat_ws(',', '"decision":"' || a.decision || '"', '"at":"' || a.at || '"', '"by":"' || a.by || '"') || '}'), ',') || ']'""",
}


@fixture(f"WITH {_GATE} SELECT " + ", ".join(f"coalesce(CAST({_CELLS.get(c, c)} AS VARCHAR), '') AS {c}" for c in sinks.QUEUE) + " FROM gate WHERE reject_reason IS NULL")
def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.queue_rows(_gated(spark).filter("reject_reason is null"))


# --- calendar
_CLAIMS = {"b1": "Owners close faster than tools", "b2": "A step that nobody reads is not a step, however long the sentence that says so has grown over the years", "b3": None}
HOT = {"take": "Meetings cause late closes", "line": ""}


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.slots(spark, Y.START, Y.DAYS, Y._pillars(spark, sf_dir), ["h1", "h2", "h3"], Y.RUNGS, ("08:30", "12:00"), ("b1", "b2", "b3"), claims={k: v for k, v in _CLAIMS.items() if v}, hot_take=HOT, segment="s1")


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"


_BELIEF = "CASE belief_ref " + " ".join(f"WHEN '{k}' THEN {D.q(v)}" for k, v in _CLAIMS.items() if v) + " END"
_TOLD = {"opinion": D.q(G.BRIEFS["opinion"][0].replace("{take}", HOT["take"])), **{k: D.q(v[0]) for k, v in G.BRIEFS.items() if len(v) == 1}}
for _kind, _mark, _value in (("framework", "{belief}", _cut("b", 80)), ("myth_busting", "{assumption}", _cut(f"coalesce(b, {D.q(HOT['take'])})", 90))):
    _before, _after = G.BRIEFS[_kind][0].split(_mark)
    _TOLD[_kind] = f"coalesce({D.q(_before)} || ({_value}) || {D.q(_after)}, {D.q(G.BRIEFS[_kind][1])})"
_BRIEF = "CASE archetype " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TOLD.items()) + " END"
_ROW = {"belief_refs": "belief_ref", "proof_refs": "proof_ref", "segment": "'s1'", "hook_brief": _BRIEF, "status": "'planned'", "title": "''", "score": "''", "published_url": "''", "notes": "''"}


@query(f"SELECT {', '.join(f"coalesce(CAST({_ROW.get(c, c)} AS VARCHAR), '') AS {c}" for c in sinks.CALENDAR)} FROM (SELECT *, {_BELIEF} AS b FROM ({SQL['slots']}))")
def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.calendar_rows(_slots(spark, sf_dir))


@query(f"""WITH s AS ({SQL['slots']}), w AS (SELECT 'p' || (r_regionkey + 1) AS key, [0.40::DOUBLE, 0.25, 0.20, 0.10, 0.05][r_regionkey + 1] AS weight FROM region)
 SELECT 'pillar' AS kind, key, {D.rnd('weight', 3)} AS planned, {D.rnd('count(s.id)::DOUBLE / (SELECT count(*) FROM s)', 3)} AS actual, count(s.id) AS count FROM w LEFT JOIN s ON s.pillar = key GROUP BY key, weight
 UNION ALL SELECT 'archetype', archetype, NULL, {D.rnd('count(*)::DOUBLE / (SELECT count(*) FROM s)', 3)}, count(*) FROM s GROUP BY archetype""")
def plan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distribution(_slots(spark, sf_dir), Y._pillars(spark, sf_dir))


@query(f"SELECT CAST(claim_level AS VARCHAR) AS claim_level, coalesce(label, '') AS label, count(*) AS count FROM ({SQL['slots']}) s LEFT JOIN {D.rows(X.LADDER, X.LADDER_DDL)} l ON l.level = s.claim_level GROUP BY ALL")
def claim_level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.labelled_levels(_slots(spark, sf_dir), literal(spark, X.LADDER, X.LADDER_DDL))


#: A plan that breaks the rules: eight of eleven slots of one archetype, the rest not actionable.
_LOPSIDED = [{"archetype": "story"}] * 8 + [{"archetype": a} for a in ("question", "how_to", "opinion")]
_LOP = D.rows(_LOPSIDED, "archetype string")
_ACT = ", ".join(f"'{a}'" for a in G.ACTIONABLE)


@fixture(f"""WITH s AS (SELECT archetype, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM {_LOP} x GROUP BY archetype), a AS (SELECT count(*) FILTER (WHERE archetype IN ({_ACT}))::DOUBLE / count(*) AS share FROM {_LOP} x)
 SELECT 'archetype_share' AS rule, archetype AS subject, 'warn' AS severity FROM s WHERE share > {G.MOST_SHARE} + 0.02 UNION ALL SELECT 'actionable_share', 'plan', 'warn' FROM a WHERE share < {G.LEAST_ACTIONABLE}
 UNION ALL SELECT 'thin_proof', 'plan', 'warn' FROM (SELECT count(*) AS n FROM {_PROOF} x) WHERE n < 3 UNION ALL SELECT 'no_hot_takes', 'plan', 'nice'""")
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plan_violations(literal(spark, _LOPSIDED, "archetype string"), _proof(spark).count(), 3, 0)


# --- drift of a history
_HISTORY = D.rows(X.HISTORY, X.HISTORY_DDL)
_SAMPLE_WORDS = 9.0
_SHARE3 = "count(*)::DOUBLE / any_value(n)"


def _weights(planned: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in planned.items()) + ") AS w(pillar, weight)"


def _drift(history: str, planned: dict[str, float], words: float) -> str:
    return f"""WITH l AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY seq DESC) AS r FROM {history} x) WHERE r <= 30),
 h AS (SELECT l.*, n FROM l JOIN (SELECT feed, count(*) AS n FROM l GROUP BY feed HAVING count(*) >= 3) USING (feed)),
 st AS (SELECT feed, avg(mean_sentence_words) AS words, avg(CASE WHEN first_person = 0 THEN second_person::DOUBLE ELSE second_person::DOUBLE / first_person END) AS ratio, sum(emoji)::DOUBLE / count(*) AS emoji FROM {D.style('h', 'feed, text')} GROUP BY feed),
 tv AS (SELECT feed, sum(abs(coalesce(c, 0)::DOUBLE / n - weight)) / 2 AS m FROM (SELECT DISTINCT feed, n FROM h) CROSS JOIN {_weights(planned)} LEFT JOIN (SELECT feed, pillar, count(*) AS c FROM h GROUP BY feed, pillar) USING (feed, pillar) GROUP BY feed),
 op AS (SELECT feed, sum(CASE WHEN c >= 3 THEN c ELSE 0 END)::DOUBLE / any_value(n) AS m FROM (SELECT feed, n, {D.hook_key()} AS k, count(*) AS c FROM h GROUP BY feed, n, k) GROUP BY feed),
 ar AS (SELECT feed, archetype AS s, {_SHARE3} AS m FROM h WHERE archetype IS NOT NULL GROUP BY feed, archetype),
 pr AS (SELECT feed, s, {_SHARE3} AS m FROM (SELECT feed, n, unnest(proof_refs) AS s FROM h) GROUP BY feed, s),
 gr AS (SELECT feed, seq, len(g) AS c, unnest(g) AS gram FROM (SELECT feed, seq, {D.grams()} AS g FROM h)),
 wp AS (SELECT feed, max(o) AS m FROM (SELECT a.feed, count(*)::DOUBLE / (a.c + b.c - count(*)) AS o FROM gr a JOIN gr b ON a.feed = b.feed AND a.gram = b.gram AND a.seq < b.seq GROUP BY a.feed, a.seq, b.seq, a.c, b.c) GROUP BY feed),
 al AS (SELECT feed, 'pillar_distribution' AS "check", '' AS subject, m FROM tv WHERE m > 0.2 UNION ALL SELECT feed, 'mean_sentence_words', '', abs(words - {words}) / {words} FROM st WHERE abs(words - {words}) / {words} > 0.25
  UNION ALL SELECT feed, 'person_ratio_low', '', {D.rnd('ratio', 2)} FROM st WHERE {D.rnd('ratio', 2)} < 1.2::DOUBLE UNION ALL SELECT feed, 'person_ratio_high', '', {D.rnd('ratio', 2)} FROM st WHERE {D.rnd('ratio', 2)} > 6.0::DOUBLE UNION ALL SELECT feed, 'emoji', '', emoji FROM st WHERE emoji > 0.5
  UNION ALL SELECT feed, 'hook_reuse', '', m FROM op WHERE m > 0.15 UNION ALL SELECT feed, 'archetype', s, m FROM ar WHERE m > 0.25 UNION ALL SELECT feed, 'proof_reuse', s, m FROM pr WHERE m > 0.2 UNION ALL SELECT feed, 'repetition', '', m FROM wp WHERE m > 0.25)
 SELECT feed, "check", subject, {D.rnd('m', 3)} AS measured FROM al"""


@fixture(_drift(_HISTORY, X.PLANNED, _SAMPLE_WORDS))
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.report(literal(spark, X.HISTORY, X.HISTORY_DDL), "feed", "seq", X.PLANNED, _SAMPLE_WORDS)


#: Sources are feeds, languages their pillars, hooks their archetypes, and the numbers of a document its proof.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
_FEEDS = f"(SELECT source AS feed, doc_id AS seq, text, lang AS pillar, {HOOK_SQL}[1] AS archetype, list_distinct({D.claim_numbers()}) AS proof_refs FROM documents)"


@query(_drift(_FEEDS, LANGUAGES, 12.0))
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    feeds = table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("seq"), "text", F.col("lang").alias("pillar"), F.get(hook_families(text), F.lit(0)).alias("archetype"), F.array_distinct(claim_numbers(text)).alias("proof_refs"))
    return H.report(feeds, "feed", "seq", LANGUAGES, 12.0)


# --- readers
_LINES = D.rows([{"value": x} for x in X.LINES], "value string")
_OBJ = "json_type(j) = 'OBJECT'"


@fixture(f"""SELECT j->>'$.id' AS id, text, j->>'$.pillar' AS pillar, j->>'$.archetype' AS archetype, array_to_string(CAST(j->'$.proof_refs' AS VARCHAR[]), ',') AS proof_refs, CAST(j->>'$.seq' AS BIGINT) AS seq
 FROM (SELECT j, CASE WHEN {_OBJ} THEN j->>'$.text' ELSE j->>'$' END AS text FROM (SELECT CASE WHEN value <> '' AND json_valid(value) THEN value::JSON END AS j FROM {_LINES} x)) WHERE text IS NOT NULL""")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = literal(spark, [{"value": x} for x in X.LINES], "value string")
    return readers.parse_history(lines).withColumn("proof_refs", F.array_join("proof_refs", ","))


_SAMPLES = D.rows([{"id": i, "text": t} for i, t in enumerate(X.SAMPLES)], "id int, text string")
_BODY = D.trim(r"regexp_replace(regexp_replace(regexp_replace(s, '\n##[\s\S]*$', ''), '<!--[\s\S]*?-->', '', 'g'), '(?m)^---\s*$', '', 'g')")


@fixture(rf"SELECT id, body FROM (SELECT id, {_BODY} AS body FROM (SELECT id, unnest(string_split_regex(text, '(?m)^##\s+Sample\s+\d+\s*$')[2:]) AS s FROM {_SAMPLES} x)) WHERE length(body) >= 80")
def voice_sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = literal(spark, [{"id": i, "text": t} for i, t in enumerate(X.SAMPLES)], "id int, text string")
    return texts.select("id", F.explode(readers.voice_samples(F.col("text"))).alias("body"))
