"""Queries of many personas: each supplier has a calendar, whose pillars are the places of its lines in orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import calendars as C
from textloom.operators import planning as G
from textloom.plans.registry import query
from textloom.sources.tables import table

# What all suppliers have alike.
RUNGS = ((1, ("p1", "p2", "p3", "p4"), ("opinion", "question", "observation"), False), (2, ("p5", "p6", "p7"), ("how_to", "framework", "checklist"), False), (4, ("p4", "p5"), ("case_study", "announcement"), True))
TIMES = ("08:30", "12:00", "17:45")


def _strings(values) -> F.Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persona for each supplier: start, days and posts a day by its key, a pillar for each line number with its share of the lines, proof by its nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("way"))
    n = lines.groupBy("l_suppkey", "way").agg(F.count(F.lit(1)).alias("n"))
    ways = n.groupBy("l_suppkey").agg(F.sum("n").alias("_all"), F.sort_array(F.collect_list(F.struct("way", "n"))).alias("_ways"))
    pillar = lambda w: F.struct(w["way"].alias("id"), (w["n"] / F.col("_all")).alias("weight"), F.when(w["way"] == "p4", _strings(("b7", "b8"))).otherwise(_strings(())).alias("beliefs"))
    rungs = F.array(*[F.struct(F.lit(r).alias("rung"), _strings(s).alias("serves"), _strings(a).alias("archetypes"), F.lit(p).alias("needs_proof")) for r, s, a, p in RUNGS])
    k = F.col("s_suppkey")
    proof = F.slice(_strings(("h1", "h2", "h3", "h4")), 1, (F.col("s_nationkey") % 5).cast("int"))
    return (
        table(spark, sf_dir, "supplier").join(ways, F.col("l_suppkey") == k, "left").select(
            "s_suppkey", F.date_add(F.lit("2026-01-01").cast("date"), (k % 11).cast("int")).alias("start"), (F.lit(7) + k % 30).cast("int").alias("days"),
            F.when(k % 2 == 0, _strings(("Mon", "Tue", "Wed", "Thu", "Fri"))).otherwise(_strings(("Tue", "Sat"))).alias("weekdays"), (F.lit(1) + k % 3).cast("int").alias("per_day"),
            _strings(TIMES).alias("times"), F.transform("_ways", pillar).alias("pillars"), proof.alias("proof"), F.when(F.col("s_nationkey") > 4, _strings(("b1", "b2", "b3"))).otherwise(_strings(())).alias("beliefs"), rungs.alias("rungs"),
        )
    )


_N = "(SELECT l_suppkey, 'p' || CAST(l_linenumber AS VARCHAR) AS way, count(*) AS n FROM lineitem GROUP BY ALL)"
_DAYS = "CASE WHEN s_suppkey % 2 = 0 THEN [1, 2, 3, 4, 5] ELSE [2, 6] END"
_HOOK = "CASE archetype " + " ".join(f"WHEN '{a}' THEN '{h}'" for a, h in G.HOOK_BY_ARCHETYPE.items()) + " END"
_RUNG = "CASE " + " ".join(f"WHEN pillar IN {s} AND archetype IN {a}{' AND proof_ref IS NOT NULL' if p else ''} THEN {r}" for r, s, a, p in RUNGS) + " ELSE 1 END"
_LEVEL = "CASE WHEN archetype IN ('opinion', 'question') THEN 1 WHEN archetype = 'announcement' THEN 4 WHEN archetype = 'myth_busting' THEN CASE WHEN proof_ref IS NOT NULL THEN 3 ELSE 1 END WHEN proof_ref IS NOT NULL THEN 3 ELSE 2 END"
_OWN = "pool[(r.idx + 1) % len(pool) + 1]"
CALENDARS = f"""p AS MATERIALIZED (SELECT s_suppkey, DATE '2026-01-01' + CAST(s_suppkey % 11 AS INT) AS start, CAST(7 + s_suppkey % 30 AS INT) AS days, CAST(1 + s_suppkey % 3 AS INT) AS per_day, ['h1', 'h2', 'h3', 'h4'][1:s_nationkey % 5] AS proof,
  CASE WHEN s_nationkey > 4 THEN ['b1', 'b2', 'b3'] ELSE []::VARCHAR[] END AS beliefs, coalesce(ways, []) AS ways, coalesce(shares, []) AS shares
  FROM supplier LEFT JOIN (SELECT l_suppkey, list(way ORDER BY way) AS ways, list(share ORDER BY way) AS shares FROM (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY l_suppkey) AS share FROM {_N}) GROUP BY l_suppkey) ON l_suppkey = s_suppkey),
 d AS (SELECT s_suppkey, per_day, start, ways, shares, list_filter(list_transform(range(days), lambda i: start + CAST(i AS INT)), lambda x: list_contains({_DAYS}, isodow(x))) AS dates FROM p),
 f AS (SELECT *, len(dates) * per_day AS total FROM d),
 o AS (SELECT *, flatten(list_transform(range(len(ways)), lambda i: list_transform(range(CAST(floor(shares[i + 1] * total + 0.5) AS BIGINT)), lambda j: ways[i + 1]))) AS rounded FROM f),
 q AS MATERIALIZED (SELECT s_suppkey, per_day, start, dates, total, list_concat(rounded, list_transform(range(len(rounded), greatest(total, len(rounded))), lambda i: ways[i % len(ways) + 1])) AS pool FROM o WHERE len(ways) > 0 AND total > 0),
 r AS (SELECT s_suppkey, 0 AS idx, pool[1] AS pillar FROM q UNION ALL
  SELECT r.s_suppkey, r.idx + 1, CASE WHEN {_OWN} <> pillar THEN {_OWN} ELSE coalesce(pool[list_filter(range(len(pool)), lambda i: pool[i + 1] <> pillar AND pool[(r.idx + 1 + i) % len(pool) + 1] <> pillar)[1] + 1], {_OWN}) END FROM r JOIN q USING (s_suppkey) WHERE r.idx + 1 < total),
 b AS (SELECT r.s_suppkey, r.idx, r.pillar, q.start, q.dates[r.idx // q.per_day + 1] AS date, {[*G.ARCHETYPES]}[r.idx % 10 + 1] AS archetype, p.proof, p.beliefs FROM r JOIN q USING (s_suppkey) JOIN p USING (s_suppkey)),
 c AS (SELECT *, CASE WHEN pillar = 'p4' THEN ['b7', 'b8'][idx % 2 + 1] WHEN len(beliefs) > 0 THEN beliefs[idx % len(beliefs) + 1] END AS belief_ref, CASE WHEN archetype NOT IN ('opinion', 'question') AND len(proof) > 0 THEN proof[idx % len(proof) + 1] END AS proof_ref FROM b),
 k AS MATERIALIZED (SELECT s_suppkey, 'slot-' || strftime(start, '%Y-%m-%d') || '-' || lpad(CAST(idx + 1 AS VARCHAR), 3, '0') AS id, CAST(idx AS INT) AS idx, CAST(date AS DATE) AS date, {[*TIMES]}[idx % 3 + 1] AS time, pillar, archetype, belief_ref, proof_ref, {_RUNG} AS offer_rung, {_HOOK} AS hook_family, {_LEVEL} AS claim_level FROM c)"""


@query(f"WITH RECURSIVE {CALENDARS} SELECT * FROM k")
def supplier_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calendars(personas(spark, sf_dir), "s_suppkey")


_ACT = ", ".join(f"'{a}'" for a in G.ACTIONABLE)


@query(f"""WITH RECURSIVE {CALENDARS}, n AS (SELECT s_suppkey, count(*) AS n, count(*) FILTER (WHERE archetype IN ({_ACT})) AS act FROM k GROUP BY s_suppkey)
 SELECT s_suppkey, 'archetype_share' AS rule, archetype AS subject, 'warn' AS severity FROM (SELECT s_suppkey, archetype, count(*) AS c FROM k GROUP BY ALL) JOIN n USING (s_suppkey) WHERE c::DOUBLE / n > 0.27::DOUBLE
 UNION ALL SELECT s_suppkey, 'actionable_share', 'plan', 'warn' FROM n WHERE act::DOUBLE / n < {G.LEAST_ACTIONABLE}::DOUBLE
 UNION ALL SELECT s_suppkey, 'no_eligible_dates', 'plan', 'blocker' FROM p WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n)
 UNION ALL SELECT s_suppkey, 'thin_proof', 'plan', 'warn' FROM p WHERE len(proof) < 3 UNION ALL SELECT s_suppkey, 'no_beliefs', 'plan', 'warn' FROM p WHERE len(beliefs) = 0
 UNION ALL SELECT s_suppkey, 'starved_pillar', way, 'warn' FROM (SELECT s_suppkey, unnest(ways) AS way FROM p) AS y WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.s_suppkey = y.s_suppkey AND k.pillar = y.way)""")
def calendar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = personas(spark, sf_dir)
    return C.broken_rules(C.calendars(people, "s_suppkey"), people, "s_suppkey")
