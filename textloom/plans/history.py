"""Queries of drift, analytics, quality, planning and export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import round_half_up
from textloom.operators import drift as H
from textloom.operators import planning as G
from textloom.operators import quality as K
from textloom.operators.similarity import total_variation
from textloom.plans import duck as D
from textloom.plans import posts as PQ
from textloom.plans.registry import SQL, fixture, query
from textloom.sources.tables import table


# --- shares and drift
@query(f"SELECT source, count(*) AS n, {D.rnd('count(*)::DOUBLE / sum(count(*)) OVER ()', 6)} AS share FROM documents GROUP BY source")
def pillar_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shares(table(spark, sf_dir, "documents").select("source"), "source").withColumn("share", round_half_up(F.col("share"), 6))


@query(f"""WITH a AS (SELECT event_type AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM events GROUP BY 1), p AS (SELECT DISTINCT event_type AS k, 1.0::DOUBLE / (SELECT count(DISTINCT event_type) FROM events) AS s FROM events)
 SELECT {D.rnd('sum(abs(coalesce(a.s, 0) - coalesce(p.s, 0))) / 2', 6)} AS tvd FROM a FULL JOIN p USING (k)""")
def tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = H.shares(table(spark, sf_dir, "events").select("event_type"), "event_type")
    planned = actual.select("event_type", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("share"))
    return total_variation(planned, actual, "event_type").select(round_half_up(F.col("tvd"), 6).alias("tvd"))


@query(f"SELECT source, lang, n, {D.rnd('s', 6)} AS share FROM (SELECT source, lang, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) AS s FROM documents GROUP BY source, lang) WHERE s > 0.25")
def archetype_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shares(table(spark, sf_dir, "documents").select("source", "lang"), "lang", within=("source",)).filter("share > 0.25").withColumn("share", round_half_up(F.col("share"), 6))


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30)"


@query(f"SELECT user_id, event_type, n, {D.rnd('s', 6)} AS share FROM (SELECT user_id, event_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS s, sum(count(*)) OVER (PARTITION BY user_id) AS w FROM {_LAST} GROUP BY user_id, event_type) WHERE w >= 3 AND s > 0.2")
def drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = H.last_posts(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id")
    found = H.shares(last, "event_type", within=("user_id",)).withColumn("_w", F.sum("n").over(Window.partitionBy("user_id")))
    return found.filter("_w >= 3 and share > 0.2").select("user_id", "event_type", "n", round_half_up(F.col("share"), 6).alias("share"))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e.select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("seen"), F.count_if(F.col("event_type") == "click").over(w).alias("clicks"))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rolling_drift over the events as a stream: each file is read once, and the state is what the next batch needs."""
    from textloom.sources import shared
    from textloom.streaming import windows

    schema = table(spark, sf_dir, "events").schema
    # A pattern, as the table may be one file or a folder of files.
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/event[s].parquet")
    rolled = windows.last_posts(events.select("event_id", "user_id", "ts", (F.col("event_type") == "click").alias("mark")), "user_id", ["ts", "event_id"], "mark")
    out = shared.folder(spark, "rolling")
    windows.run(rolled, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rolled.schema).parquet(f"{out}/rows").select("event_id", "user_id", "seen", F.col("marked").alias("clicks"))


@query(f"SELECT hook_key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {D.hook_key()} AS hook_key FROM documents) GROUP BY hook_key HAVING count(*) >= 3")
def first_line_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("doc_id", T.hook_key(F.col("text")).alias("hook_key"))
    return keys.groupBy("hook_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n >= 3")


_LASTD = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 30)"


@query(f"SELECT source, reused, posts, {D.rnd('reused::DOUBLE / greatest(posts, 1)', 3)} AS rate FROM (SELECT source, sum(CASE WHEN n >= 3 THEN n ELSE 0 END)::BIGINT AS reused, sum(n)::BIGINT AS posts FROM (SELECT source, {D.hook_key()} AS k, count(*) AS n FROM {_LASTD} GROUP BY source, k) GROUP BY source)")
def opening_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = H.last_posts(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id")
    return H.opening_reuse(last, "source", T.hook_key(F.col("text")))


@query(f"""WITH p AS (SELECT source, mean_sentence_words AS m, emoji, CASE WHEN first_person = 0 THEN second_person::DOUBLE ELSE second_person::DOUBLE / first_person END AS q FROM {D.style(_LASTD)}),
 a AS (SELECT source, count(*) AS posts, {D.rnd("CAST(sum(CAST(floor(m * 1000.0::DOUBLE + 0.5) AS BIGINT)) AS DOUBLE) / 1000.0::DOUBLE / count(*)", 3)} AS mean_words, {D.rnd("CAST(sum(CAST(floor(q * 1000000.0::DOUBLE + 0.5) AS BIGINT)) AS DOUBLE) / 1000000.0::DOUBLE / count(*)", 2)} AS person_ratio, {D.rnd("sum(emoji)::DOUBLE / count(*)", 3)} AS emoji FROM p GROUP BY source)
 SELECT *, abs(mean_words - 14) / 14 > 0.25 AS sentence_drift, person_ratio < 1.2::DOUBLE AS ratio_low, person_ratio > 6.0::DOUBLE AS ratio_high, emoji > 0.5::DOUBLE AS emoji_drift FROM a WHERE posts >= 3""")
def voice_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = T.style_profile(H.last_posts(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id"))
    q = F.when(F.col("first_person") == 0, F.col("second_person").cast("double")).otherwise(F.col("second_person") / F.col("first_person"))
    exact = lambda c, f: F.sum(F.floor(c * F.lit(f) + 0.5)).cast("double") / F.lit(f) / F.count(F.lit(1))
    a = last.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), round_half_up(exact(F.col("mean_sentence_words"), 1000.0), 3).alias("mean_words"), round_half_up(exact(q, 1000000.0), 2).alias("person_ratio"), round_half_up(F.sum("emoji") / F.count(F.lit(1)), 3).alias("emoji"))
    return a.filter("posts >= 3").select("*", (F.abs(F.col("mean_words") - 14) / 14 > 0.25).alias("sentence_drift"), (F.col("person_ratio") < 1.2).alias("ratio_low"), (F.col("person_ratio") > 6.0).alias("ratio_high"), (F.col("emoji") > 0.5).alias("emoji_drift"))


@query(f"SELECT event_type, count(*) AS n, {D.rnd('sum(CAST(floor(value * 10000 + 0.5) AS BIGINT))::DOUBLE / 10000 / count(*)', 3)} AS value_per_event, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events WHERE value IS NOT NULL GROUP BY event_type")
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    mean = F.sum(F.floor(F.col("value") * 10000 + 0.5)).cast("double") / 10000 / F.count(F.lit(1))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), round_half_up(mean, 3).alias("value_per_event"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


# --- quality
@query("""SELECT 'orders.o_custkey' AS reference, CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
 UNION ALL SELECT 'lineitem.l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey UNION ALL SELECT 'labels.doc_id', CAST(doc_id AS VARCHAR), count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id
 UNION ALL SELECT 'nation.n_regionkey', CAST(n_regionkey AS VARCHAR), count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) GROUP BY n_regionkey
 UNION ALL SELECT 'documents.doc_id', CAST(doc_id AS VARCHAR), count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id UNION ALL SELECT 'customer.c_custkey', CAST(c_custkey AS VARCHAR), count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_custkey""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"), ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey")]
    found = [K.dangling(t(a).select(k), k, t(b).select(j), j, f"{a}.{k}") for a, k, b, j in refs]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("""WITH g AS (SELECT count(*) AS docs, count(text) AS with_text, count(*) FILTER (WHERE length(coalesce(text, '')) < 500) AS short, count(DISTINCT source) AS sources, count(*) FILTER (WHERE lang IS NULL) AS no_lang FROM documents)
 SELECT 'short_texts' AS gap, 'warn' AS severity, short AS n FROM g WHERE short > 0 UNION ALL SELECT 'no_text', 'blocker', docs - with_text FROM g WHERE docs > with_text UNION ALL SELECT 'few_sources', 'blocker', sources FROM g WHERE sources < 3 UNION ALL SELECT 'no_lang', 'warn', no_lang FROM g WHERE no_lang > 0""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    g = d.agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("with_text"), F.count_if(F.length(T.whole(F.col("text"))) < 500).alias("short"), F.countDistinct("source").alias("sources"), F.count_if(F.col("lang").isNull()).alias("no_lang"))
    rules = [("short_texts", "warn", F.col("short"), F.col("short") > 0), ("no_text", "blocker", F.col("docs") - F.col("with_text"), F.col("docs") > F.col("with_text")), ("few_sources", "blocker", F.col("sources"), F.col("sources") < 3), ("no_lang", "warn", F.col("no_lang"), F.col("no_lang") > 0)]
    rows = F.array(*[F.struct(F.lit(n).alias("gap"), F.lit(s).alias("severity"), v.alias("n"), c.alias("hit")) for n, s, v, c in rules])
    return g.select(F.explode(rows).alias("x")).filter("x.hit").select("x.gap", "x.severity", "x.n")


DOC_SCHEMA = {
    "type": "object", "required": ["doc_id", "text", "source"],
    "properties": {"doc_id": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 20, "maxLength": 20000}, "lang": {"enum": ["en", "de", "fr"]}, "source": {"pattern": "^src[0-9]$"}, "n_chars": {"type": "integer", "maximum": 50000}},
    "allOf": [{"if": {"properties": {"lang": {"const": "en"}}}, "then": {"properties": {"n_chars": {"maximum": 12000}}}}],
}


@query("""SELECT doc_id, '/text' AS pointer, 'minLength 20' AS message FROM documents WHERE length(text) < 20 UNION ALL SELECT doc_id, '/text', 'maxLength 20000' FROM documents WHERE length(text) > 20000 UNION ALL SELECT doc_id, '/text', 'is required' FROM documents WHERE text IS NULL
 UNION ALL SELECT doc_id, '/lang', 'must be one of the listed values' FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT doc_id, '/source', 'pattern ^src[0-9]$' FROM documents WHERE NOT regexp_matches(source, '^src[0-9]$') UNION ALL SELECT doc_id, '/source', 'is required' FROM documents WHERE source IS NULL
 UNION ALL SELECT doc_id, '/n_chars', 'maximum 50000' FROM documents WHERE n_chars > 50000 UNION ALL SELECT doc_id, '/n_chars', 'maximum 12000' FROM documents WHERE (lang = 'en' OR lang IS NULL) AND n_chars > 12000""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.violations(table(spark, sf_dir, "documents"), DOC_SCHEMA, "doc_id")


_TITLE, _H1 = "regexp_extract(html, '<title>([^<]*)</title>', 1)", "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_XC = [
    ("title_present", "blocker", f"{_TITLE} <> ''", lambda t, h, n: t != ""),
    ("title_not_placeholder", "blocker", f"NOT regexp_matches({_TITLE}, '(?i)^(?:untitled|home|log ?in|sign ?in)')", lambda t, h, n: ~t.rlike("(?i)^(?:untitled|home|log ?in|sign ?in)")),
    ("heading_present", "warn", f"{_H1} <> ''", lambda t, h, n: h != ""),
    ("heading_is_title", "nice", f"starts_with({_H1}, {_TITLE})", lambda t, h, n: h.startswith(t)),
    ("length_plausible", "warn", "length(html) BETWEEN 1000 AND 50000", lambda t, h, n: n.between(1000, 50000)),
    ("no_template_leftovers", "blocker", "NOT regexp_matches(html, '\\{\\{|\\[your ')", None),
]
_XU = " UNION ALL ".join(f"SELECT page_id, '{n}' AS check_id, '{s}' AS severity, {q} AS passed FROM pages" for n, s, q, _ in _XC)


def _extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, n = F.col("_t"), F.col("_h"), F.col("_n")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("_t"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("_h"), F.length("html").alias("_n"), (~F.col("html").rlike(r"\{\{|\[your ")).alias("_ok"))
    return p.select("page_id", F.explode(F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), (f(t, h, n) if f else F.col("_ok")).alias("passed")) for i, s, _, f in _XC])).alias("x")).select("page_id", "x.*")


@query(_XU)
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extraction(spark, sf_dir)


@query(f"SELECT page_id, count(*) FILTER (WHERE passed) AS passed, count(*) AS checks, CASE WHEN count(*) FILTER (WHERE NOT passed AND severity = 'blocker') > 0 THEN 'unsound' WHEN count(*) FILTER (WHERE NOT passed AND severity = 'warn') > 0 THEN 'usable_with_caveats' ELSE 'sound' END AS verdict FROM ({_XU}) GROUP BY page_id")
def extraction_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)) > 0
    verdict = F.when(bad("blocker"), "unsound").when(bad("warn"), "usable_with_caveats").otherwise("sound")
    return _extraction(spark, sf_dir).groupBy("page_id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("checks"), verdict.alias("verdict"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, previous FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderdate < previous")
def order_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.withColumn("previous", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("o_orderdate < previous")


# --- approval gate
def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # A post that isn't approved is refused by its status, so only approved ones are scored.
    approved = labels.filter("quality = 1").select("doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(approved) if approved.count() <= MOST_BROADCAST else approved, "doc_id")
    # Only whether a text is empty goes through the joins, not the text.
    empty = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") == ""
    scores = PQ.post_scores(spark, sf_dir, texts.withColumn("_some", F.when(empty, "").otherwise("-")), ("_some",)).select("doc_id", F.col("_some").alias("text"), F.col("hard_blocks").alias("_blocks"), "total")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left").join(scores, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("draft")
    blocks = F.when(F.col("quality") == 1, F.concat_ws(",", F.nullif("_blocks", F.lit("")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    shown = F.when(F.col("source") == "src3", "CONNECTIONS").otherwise("PUBLIC")
    ready = rows.select("doc_id", "text", "source", "lang", "total", status.alias("status"), blocks.alias("hard_blocks"), (F.col("quality") == 1).alias("approved"), shown.alias("visibility"), F.lit(40.0).alias("least_score"), F.array(F.lit("PUBLIC")).alias("allowed_visibility"))
    return H.approved_rows(ready)


#: Identifiers of approved posts that are broadcast at most, counted first; beyond, Spark shuffles.
MOST_BROADCAST = 1_000_000


_SCORES = f"""WITH {PQ.FINDINGS}, t AS (SELECT doc_id, {PQ._SUMS.format('earned', 'possible')} FROM f GROUP BY doc_id),
 sc AS (SELECT doc_id, CASE WHEN needs_source > 0 THEN 'hb1' END AS hb1, CASE WHEN self_reference THEN 'hb3' END AS hb3, CASE WHEN needs_source > 0 OR self_reference THEN 0.0 ELSE {D.rnd('earned::DOUBLE / possible * 100', 1)} END AS score FROM t JOIN m USING (doc_id)),
 lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 g AS (SELECT d.doc_id, d.text, d.source, d.lang, CASE WHEN quality = 1 THEN score END AS total, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'draft' END AS status, CASE WHEN quality = 1 THEN concat_ws(',', hb1, hb3, CASE WHEN toxic = 1 THEN 'toxic' END) END AS hard_blocks, CASE WHEN source = 'src3' THEN 'CONNECTIONS' ELSE 'PUBLIC' END AS visibility FROM documents d JOIN sc USING (doc_id) LEFT JOIN lb USING (doc_id)),
 r AS (SELECT *, CASE WHEN status <> 'approved' THEN 'status is ' || status WHEN hard_blocks <> '' THEN 'hard blocks present: ' || hard_blocks WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 'empty text' WHEN total < 40 THEN 'score too low' WHEN visibility <> 'PUBLIC' THEN 'visibility not allowed' END AS reject_reason FROM g)"""


@query(f"{_SCORES} SELECT doc_id, status, total, hard_blocks, reject_reason FROM r")
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", "status", "total", "hard_blocks", "reject_reason")


@query(f"{_SCORES} SELECT CAST(doc_id AS VARCHAR) AS id, source AS pillar, lang AS archetype, status, text AS body, '' AS image_url, visibility, 'MAIN_FEED' AS feed_distribution, total AS score FROM r WHERE reject_reason IS NULL")
def export_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _gated(spark, sf_dir).filter("reject_reason is null").drop("text").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("pillar"), F.col("lang").alias("archetype"), "status", F.col("text").alias("body"), F.lit("").alias("image_url"), "visibility", F.lit("MAIN_FEED").alias("feed_distribution"), F.col("total").alias("score"))


# --- planning: the regions are pillars
START, DAYS = date(2026, 1, 5), 30
_WEIGHTS = (0.40, 0.25, 0.20, 0.10, 0.05)
_SPINE = "(SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS idx, CAST(d AS DATE) AS date FROM generate_series(DATE '2026-01-05', DATE '2026-02-03', INTERVAL 1 DAY) AS g(d) WHERE isodow(d) <= 5)"


def _pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.array(*[F.lit(w) for w in _WEIGHTS]), (F.col("r_regionkey") + 1).cast("int"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("ord"), F.concat(F.lit("p"), (F.col("r_regionkey") + 1).cast("string")).alias("id"), weight.alias("weight"), F.expr("cast(array() as array<string>)").alias("maps_to_beliefs"))


@fixture(f"SELECT idx, date FROM {_SPINE}")
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.date_spine(spark, START, DAYS)


_ARCH = "[" + ", ".join(f"'{a}'" for a in G.ARCHETYPES) + "]"


@fixture(f"SELECT idx, {_ARCH}[idx % 10 + 1] AS archetype FROM {_SPINE}")
def archetype_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.date_spine(spark, START, DAYS).select("idx", G.archetype_at(F.col("idx")).alias("archetype"))


_POOL = "(SELECT CAST(row_number() OVER (ORDER BY r_regionkey, k) - 1 AS INT) AS pos, 'p' || (r_regionkey + 1) AS pillar FROM (SELECT r_regionkey, unnest(generate_series(1, CAST(floor([0.40::DOUBLE, 0.25, 0.20, 0.10, 0.05][r_regionkey + 1] * 22 + 0.5) AS INT))) AS k FROM region))"


@query(f"SELECT pos, pillar FROM {_POOL} UNION ALL SELECT CAST(p AS INT), 'p' || (p % 5 + 1) FROM generate_series((SELECT count(*) FROM {_POOL}), 21) AS g(p)")
def pillar_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pillar_pool(_pillars(spark, sf_dir), 22)


RUNGS = [
    {"rung": 1, "serves": ["p1", "p2", "p3", "p4", "p5"], "archetypes": ["opinion", "question", "observation"]},
    {"rung": 2, "serves": ["p1", "p2"], "archetypes": ["how_to", "framework", "checklist"]},
    {"rung": 4, "serves": ["p1", "p3"], "archetypes": ["case_study", "announcement"], "needs_proof": True},
]


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.slots(spark, START, DAYS, _pillars(spark, sf_dir), ["h1", "h2", "h3"], RUNGS, ("08:30", "12:00"), ("b1", "b2", "b3"))


_PICK = "p[(idx + 1) % len(p) + 1]"
_HOOK = "CASE archetype " + " ".join(f"WHEN '{a}' THEN '{h}'" for a, h in G.HOOK_BY_ARCHETYPE.items()) + " END"
_RUNG = "CASE " + " ".join(f"WHEN pillar IN {tuple(r['serves'])} AND archetype IN {tuple(r['archetypes'])}{' AND proof_ref IS NOT NULL' if r.get('needs_proof') else ''} THEN {r['rung']}" for r in RUNGS) + " ELSE 1 END"


@query(f"""WITH RECURSIVE spine AS {_SPINE}, pool AS (SELECT list(pillar ORDER BY pos) AS p FROM ({SQL['pillar_pool']})),
 r AS (SELECT 0 AS idx, p[1] AS pillar FROM pool UNION ALL
  SELECT idx + 1, CASE WHEN {_PICK} <> pillar THEN {_PICK} ELSE coalesce(p[list_filter(range(len(p)), lambda i: p[i + 1] <> pillar AND p[(idx + 1 + i) % len(p) + 1] <> pillar)[1] + 1], {_PICK}) END FROM r, pool WHERE idx < (SELECT count(*) - 1 FROM spine)),
 a AS (SELECT idx, date, pillar, {_ARCH}[idx % 10 + 1] AS archetype FROM spine JOIN r USING (idx)),
 b AS (SELECT *, CASE WHEN archetype IN ('opinion', 'question') THEN NULL ELSE ['h1', 'h2', 'h3'][idx % 3 + 1] END AS proof_ref FROM a)
 SELECT 'slot-2026-01-05-' || lpad(CAST(idx + 1 AS VARCHAR), 3, '0') AS id, idx, date, ['08:30', '12:00'][idx % 2 + 1] AS time, pillar, archetype, ['b1', 'b2', 'b3'][idx % 3 + 1] AS belief_ref, proof_ref, {_RUNG} AS offer_rung, {_HOOK} AS hook_family,
 CASE WHEN archetype IN ('opinion', 'question') THEN 1 WHEN archetype = 'announcement' THEN 4 WHEN archetype = 'myth_busting' AND proof_ref IS NULL THEN 1 WHEN proof_ref IS NULL THEN 2 ELSE 3 END AS claim_level FROM b""")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).drop("segment", "hook_brief")
