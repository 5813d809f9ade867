"""Queries of similarity, sourcing and the post rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import round_half_up
from textloom.operators import posts as P
from textloom.operators import rules as R
from textloom.operators import similarity as S
from textloom.operators import sourcing as Q
from textloom.plans import duck as D
from textloom.plans import lexicons as X
from textloom.plans.registry import query
from textloom.sources.tables import table

# --- similarity
_PAIRS = f"""WITH last AS (SELECT source, doc_id, {D.grams()} AS g FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 30),
 e AS (SELECT source, doc_id, len(g) AS n, unnest(g) AS gram FROM last),
 p AS (SELECT a.source, a.doc_id AS i, b.doc_id AS j, count(*)::DOUBLE / (a.n + b.n - count(*)) AS o FROM e a JOIN e b ON a.source = b.source AND a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.source, a.doc_id, b.doc_id, a.n, b.n)"""


@query(f"{_PAIRS} SELECT source, i, j, {D.rnd('o', 3)} AS overlap FROM p WHERE o > 0.25")
def ngram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.window_pairs(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id")
    return pairs.filter("overlap > 0.25").withColumn("overlap", round_half_up(F.col("overlap"), 3))


@query(f"{_PAIRS} SELECT source, i, j, {D.rnd('o', 3)} AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o DESC, i, j) AS r FROM p) WHERE r = 1")
def worst_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.window_pairs(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id")
    best = Window.partitionBy("source").orderBy(F.desc("overlap"), "i", "j")
    return pairs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("source", "i", "j", round_half_up(F.col("overlap"), 3).alias("overlap"))


@query(f"""WITH a AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, {D.grams()} AS g FROM benchmark)),
 b AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM (SELECT doc_id, {D.grams()} AS g FROM documents)),
 o AS (SELECT item_id, doc_id, count(*)::DOUBLE / (a.n + b.n - count(*)) AS o FROM a JOIN b USING (gram) GROUP BY item_id, doc_id, a.n, b.n),
 m AS (SELECT item_id, o, doc_id AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, doc_id) AS r FROM o) WHERE r = 1)
 SELECT item_id, {D.rnd('coalesce(o, 0.0)', 3)} AS overlap, nearest FROM benchmark LEFT JOIN m USING (item_id)""")
def max_overlap_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.worst_overlap(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


_NEAR = f"""hg AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, {D.grams()} AS g FROM benchmark)), pg AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM (SELECT doc_id, {D.grams()} AS g FROM documents)),
 po AS (SELECT doc_id, item_id, count(*)::DOUBLE / (hg.n + pg.n - count(*)) AS o FROM pg JOIN hg USING (gram) GROUP BY doc_id, item_id, hg.n, pg.n),
 near AS (SELECT doc_id, {D.rnd('o', 3)} AS overlap, item_id AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, item_id) AS r FROM po WHERE o >= 0.25::DOUBLE) WHERE r = 1)"""


def _near(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None) -> DataFrame:
    posts = table(spark, sf_dir, "documents").select("doc_id", "text") if posts is None else posts
    return S.overlaps_of_least(posts, table(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")


@query(f"WITH {_NEAR} SELECT doc_id, overlap, nearest FROM near")
def repeats_of_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)


# --- sourcing
_KNOWN = f"(SELECT DISTINCT unnest([t, regexp_replace(t, '[^0-9.,]', '', 'g')]) AS value FROM (SELECT unnest({D.claim_numbers()}) AS t FROM benchmark))"
_TOKENS = f"(SELECT doc_id, t, pos, v[pos] AS value, regexp_replace(v[pos], '[^0-9.,]', '', 'g') AS bare FROM (SELECT doc_id, t, v, unnest(generate_series(1, len(v))) AS pos FROM (SELECT doc_id, {D.whole()} AS t, {D.claim_numbers()} AS v FROM documents)))"
_HEAD, _TAIL = "substr(t, 1, strpos(t, value) - 1)", "substr(t, strpos(t, value) + length(value))"
_CLAIM = D.trim(f"CASE WHEN contains({_HEAD}, '.') THEN right({_HEAD}, strpos(reverse({_HEAD}), '.') - 1) ELSE {_HEAD} END || value || string_split({_TAIL}, '.')[1]")
UNSOURCED = f"(SELECT doc_id, CAST(pos - 1 AS INT) AS pos, value, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '…' ELSE c END AS claim FROM (SELECT *, {_CLAIM} AS c FROM {_TOKENS} WHERE bare <> '' AND NOT regexp_matches(bare, '{Q.STRUCTURAL}') AND bare NOT IN (SELECT value FROM known) AND value NOT IN (SELECT value FROM known)))"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query(f"WITH known AS {_KNOWN} SELECT doc_id, pos, value, claim FROM {UNSOURCED}")
def unsourced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unsourced(table(spark, sf_dir, "documents"), Q.known_numbers(_registry(spark, sf_dir), "text"))


_CLEAN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH s AS (SELECT doc_id, pos - 1 AS pos, {_CLEAN.format('l[pos]')} AS c FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS pos FROM (SELECT doc_id, {D.sentences()} AS l FROM documents))),
 e AS (SELECT item_id, w, len(w) AS size FROM (SELECT item_id, list_distinct(list_filter(string_split({_CLEAN.format(D.whole())}, ' '), lambda x: length(x) > 3)) AS w FROM benchmark) WHERE len(w) > 0),
 h AS (SELECT item_id, size, unnest(w) AS word FROM e), t AS (SELECT DISTINCT c FROM s), met AS (SELECT c, word FROM t JOIN (SELECT DISTINCT word FROM h) ON contains(c, word)),
 o AS (SELECT c, item_id, count(*)::DOUBLE / size AS o FROM met JOIN h USING (word) GROUP BY c, item_id, size), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o DESC, item_id) AS r FROM o WHERE o >= 0.4::DOUBLE) WHERE r = 1)
 SELECT doc_id, CAST(pos AS INT) AS pos, item_id AS entry, {D.rnd('o', 3)} AS score FROM s JOIN b USING (c)""")
def claims_in_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "claim")).filter("claim is not null")
    found = Q.nearest_claim(sentences, _registry(spark, sf_dir), only_found=True)
    return found.select("doc_id", "pos", "entry", round_half_up(F.col("score"), 3).alias("score"))


@query(f"SELECT DISTINCT unnest([t, regexp_replace(t, '[^0-9.,]', '', 'g')]) AS value FROM (SELECT unnest({D.claim_numbers()}) AS t FROM documents)")
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.known_numbers(table(spark, sf_dir, "documents"), "text")


# --- post rubric: documents are posts, labels their approval, benchmark the registry of evidence
def _measures(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    posts = table(spark, sf_dir, "documents").select("doc_id", "text") if posts is None else posts
    return P.measure(posts, Q.known_numbers(_registry(spark, sf_dir), "text"), _near(spark, sf_dir, posts.select("doc_id", "text")), keep=keep)


_RATIO = "CASE WHEN f = 0 THEN s::DOUBLE / greatest(w, 1) * 100 ELSE (s::DOUBLE / greatest(w, 1) * 100) / (f::DOUBLE / greatest(w, 1) * 100) END"
_DICTN = lambda k: f"(SELECT count(*) FROM {X.DICT} WHERE kind = '{k}' AND contains(lower({D.whole()}), phrase))"
_SELF = f"(SELECT count(*) > 0 FROM {X.DICT} WHERE kind = 'hard' AND contains(lower({D.whole()}), phrase) AND regexp_matches(phrase, 'as an ai|ai.generated|language model'))"
MEASURES = f"""{_NEAR}, known AS {_KNOWN}, u AS (SELECT doc_id, count(*) AS m FROM {UNSOURCED} GROUP BY doc_id),
 b AS (SELECT doc_id, text, {D.lengths()} AS l, {X.CTA_SQL} AS c, {D.first_line()} AS fl, {D.pronouns(T.FIRST)} AS f, {D.pronouns(T.SECOND)} AS s, {D.count(D.whole(), T.WORD)} AS w FROM documents),
 m AS (SELECT doc_id, length(fl) AS hook_chars, {D.count('fl', T.WORD)} AS hook_words, len({X.HOOK_SQL}) AS hook_families, {D.rnd(D.mean('l'), 2)} AS mean_sentence_words, {D.rnd(D.variation('l'), 3)} AS variation,
 coalesce(list_max(list_transform({D.paragraphs()}, lambda x: length(x))), 0) AS longest_paragraph, len({D.imperatives()}) AS imperatives, {_DICTN('hard')} AS hard_bans, {_DICTN('soft')} AS soft_tells,
 {D.rnd(_RATIO, 2)} AS second_to_first, len(c) AS ctas, {D.rnd(X._CR, 4)} AS cta_ratio, {D.STYLE['hashtags']} AS hashtags, {D.STYLE['emoji']} AS emoji,
 regexp_matches({D.whole()}, '(?m)^\\s*#{{1,6}}\\s|^.*\\|.*\\||\\*\\*[^*\\n]+\\*\\*') AS markdown, {_DICTN('authority')} AS authority, coalesce(m, 0) AS needs_source, coalesce(overlap, 0.0::DOUBLE) AS overlap, {_SELF} AS self_reference FROM b LEFT JOIN u USING (doc_id) LEFT JOIN near USING (doc_id))"""
_COLS = "doc_id, hook_chars, hook_words, hook_families, mean_sentence_words, variation, longest_paragraph, imperatives, hard_bans, soft_tells, second_to_first, ctas, cta_ratio, hashtags, emoji, markdown, authority, needs_source, overlap, self_reference"
_PASS = {
    "h1": "hook_chars <= 130 AND hook_words <= 18", "h2": "hook_families > 0", "s2": "needs_source = 0", "st1": "mean_sentence_words <= 18", "st2": "variation >= 0.35::DOUBLE", "st3": "longest_paragraph <= 180", "vd1": "imperatives > 0",
    "vd3": "overlap < 0.25", "vm1": "hard_bans = 0", "vm2": "soft_tells <= 1", "vm3": "second_to_first BETWEEN 1.2::DOUBLE AND 6.0::DOUBLE", "ct1": "ctas = 1", "ct2": "cta_ratio > 0.6::DOUBLE", "ff1": "hashtags BETWEEN 3 AND 5", "ff2": "emoji <= 0", "ff3": "NOT markdown",
}
_MEASURED = {"h1": "hook_chars", "h2": "hook_families", "s2": "needs_source", "st3": "longest_paragraph", "vd1": "imperatives", "vm1": "hard_bans", "vm2": "soft_tells", "ct1": "ctas", "ff1": "hashtags", "ff2": "emoji"}
FINDINGS = MEASURES + ", f AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c.id}' AS check_id, {i} AS rubric_pos, '{c.dimension}' AS dimension, '{c.severity}' AS severity, {c.points} AS points, {str(c.judged).lower()} AS judged, {'false' if c.judged else _PASS[c.id]} AS passed, CAST({_MEASURED.get(c.id, 'NULL')} AS VARCHAR) AS measured FROM m"
    for i, c in enumerate(R.POST)
) + ")"
_SUMS = "sum(CASE WHEN passed THEN points ELSE 0 END)::BIGINT AS {}, sum(CASE WHEN NOT judged THEN points ELSE 0 END)::BIGINT AS {}"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(_measures(spark, sf_dir), *P.checks())


@query(f"WITH {MEASURES} SELECT {_COLS} FROM m")
def post_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir)


@query(f"WITH {FINDINGS} SELECT * FROM f")
def post_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"WITH {FINDINGS} SELECT *, CASE WHEN points_possible > 0 THEN {D.rnd('points_earned::DOUBLE / points_possible', 3)} ELSE 0.0 END AS ratio FROM (SELECT doc_id, dimension, {_SUMS.format('points_earned', 'points_possible')}, sum(CASE WHEN judged THEN points ELSE 0 END)::BIGINT AS judged_points_pending FROM f GROUP BY doc_id, dimension)")
def post_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dimensions(_findings(spark, sf_dir))


_BAND = "CASE " + " ".join(f"WHEN {{0}} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in R.POST_BANDS) + " ELSE 'unclassified' END"


@query(f"""WITH {FINDINGS}, t AS (SELECT doc_id, {_SUMS.format('earned', 'possible')} FROM f GROUP BY doc_id),
 h AS (SELECT doc_id, concat_ws(',', CASE WHEN needs_source > 0 THEN 'hb1' END, CASE WHEN self_reference THEN 'hb3' END) AS hard_blocks FROM m),
 c AS (SELECT *, {D.rnd('earned::DOUBLE / possible * 100', 1)} AS computed_score FROM t JOIN h USING (doc_id))
 SELECT doc_id, earned, possible, computed_score, hard_blocks, CASE WHEN hard_blocks <> '' THEN 0.0 ELSE computed_score END AS total, CASE WHEN hard_blocks <> '' THEN 'reject' ELSE {_BAND.format('computed_score')} END AS band FROM c""")
def post_scores(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    no = F.lit(False)
    return R.scored(_measures(spark, sf_dir, posts, keep), P.checks()[0], P.hard_blocks(F.col("needs_source") > 0, F.col("self_reference"), no, no), keys=("doc_id", *keep))


_RANK = "row_number() OVER (PARTITION BY doc_id ORDER BY passed, CASE severity WHEN 'blocker' THEN 0 WHEN 'warn' THEN 1 WHEN 'nice' THEN 2 ELSE 3 END, points DESC, rubric_pos)"


@query(f"WITH {FINDINGS} SELECT doc_id, check_id, passed, points, CAST({_RANK} AS INT) AS rank FROM f")
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered(_findings(spark, sf_dir)).select("doc_id", "check_id", "passed", "points", "rank")


@query(f"WITH {FINDINGS} SELECT doc_id, check_id, points, CAST(rank AS INT) AS rank FROM (SELECT *, {_RANK} AS rank FROM f WHERE NOT passed AND NOT judged) WHERE rank <= 6")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered(_findings(spark, sf_dir).filter("not passed and not judged")).filter("rank <= 6").select("doc_id", "check_id", "points", "rank")


_SEV = "CASE WHEN check_id IN ('s2', 'vm1') THEN 'blocker' ELSE severity END"


@query(f"WITH {FINDINGS}, t AS (SELECT doc_id, sum(CASE WHEN passed THEN points ELSE 0 END)::BIGINT AS score, count(*) FILTER (WHERE {_SEV} = 'blocker' AND NOT passed) AS b FROM f GROUP BY doc_id) SELECT doc_id, score, CASE WHEN b > 0 THEN least(score, 59) ELSE score END AS total, b > 0 AND score > 59 AS capped, {_BAND.format('score')} AS band FROM t")
def cap_and_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).withColumn("severity", F.when(F.col("check_id").isin("s2", "vm1"), F.lit("blocker")).otherwise(F.col("severity")))
    return R.capped(found)
