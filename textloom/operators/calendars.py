"""Calendars of many personas in one plan: a persona is a row, its calendar a fold over arrays of that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.planning import ACTIONABLE, HOOK_BY_ARCHETYPE, LEAST_ACTIONABLE, MOST_SHARE, archetype_at, claim_level, dealt

#: Columns of a persona beside its key: beliefs are ids, and a rung serves pillars with archetypes, perhaps only where there is proof.
PERSONA = (
    "start date, days int, weekdays array<string>, per_day int, times array<string>, pillars array<struct<id:string,weight:double,beliefs:array<string>>>, "
    "proof array<string>, beliefs array<string>, rungs array<struct<rung:int,serves:array<string>,archetypes:array<string>,needs_proof:boolean>>"
)
_STRINGS = "cast(array() as array<string>)"


def eligible(start: Column, days: Column, weekdays: Column) -> Column:
    """array<date>: the days of a window that fall on the weekdays (Mon to Sun)."""
    window = F.when(days > 0, F.sequence(start, F.date_add(start, days - 1))).otherwise(F.expr("cast(array() as array<date>)"))
    return F.filter(window, lambda d: F.array_contains(weekdays, F.date_format(d, "E")))


def apportioned(pillars: Column, total: Column) -> Column:
    """array<string>: each pillar as often as its weight says, rounded half up; what that leaves open is dealt in turn, by place."""
    rounded = F.flatten(F.transform(pillars, lambda p: F.array_repeat(p["id"], F.greatest(F.lit(0), F.floor(F.coalesce(p["weight"], F.lit(0.0)) * total + 0.5)).cast("int"))))
    places = F.when((F.size(rounded) < total) & (F.size(pillars) > 0), F.sequence(F.size(rounded), total - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.concat(rounded, F.transform(places, lambda i: F.get(pillars, i % F.size(pillars))["id"]))


def _turn(values: Column, idx: Column) -> Column:
    return F.when(F.size(values) > 0, F.get(values, (idx % F.size(values)).cast("int")))


def calendars(personas: DataFrame, key: str) -> DataFrame:
    """One row per slot: key, id, idx, date, time, pillar, archetype, belief_ref, proof_ref, offer_rung, hook_family, claim_level.

    personas: key and the columns of PERSONA.  A persona's days, its pool of pillars and their rotation are arrays of its row, so
    calendars of any number of personas are one projection: nothing is counted before, shuffled or gathered, and a persona's slots
    lie where its row does.  A persona without eligible days or pillars has no slots; null lists count as empty, a null start or number of days
    makes no days and a null per_day counts as 1.  Personas that repeat have a calendar each.
    """
    empty = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})"))
    days = personas.select(
        F.col(key).alias("_key"), "start", F.coalesce("per_day", F.lit(1)).alias("per_day"), empty("times", "array<string>").alias("times"),
        empty("pillars", "array<struct<id:string,weight:double,beliefs:array<string>>>").alias("pillars"), empty("proof", "array<string>").alias("proof"), empty("beliefs", "array<string>").alias("beliefs"),
        F.coalesce("rungs", F.expr("cast(array() as array<struct<rung:int,serves:array<string>,archetypes:array<string>,needs_proof:boolean>>)")).alias("rungs"),
        F.coalesce(eligible(F.col("start"), F.col("days"), empty("weekdays", "array<string>")), F.expr("cast(array() as array<date>)")).alias("_days"),
    )
    pooled = days.withColumn("_total", F.size("_days") * F.col("per_day")).withColumn("_pool", apportioned(F.col("pillars"), F.col("_total")))
    # The pool is a column of its own before the fold reads it at every slot.
    turned = pooled.withColumn("_dealt", dealt(F.col("_pool"), F.col("_total")))
    idx = F.col("idx")
    rows = turned.select("_key", "start", "per_day", "times", "pillars", "proof", "beliefs", "rungs", "_days", F.posexplode_outer("_dealt").alias("idx", "pillar")).filter("idx is not null")
    placed = rows.withColumn("archetype", archetype_at(idx)).withColumn("date", F.get("_days", F.floor(idx / F.col("per_day")).cast("int")))
    mine = F.get(F.filter("pillars", lambda p: p["id"] == F.col("pillar")), F.lit(0))["beliefs"]
    belief = F.coalesce(_turn(mine, idx), _turn(F.col("beliefs"), idx))
    ref = F.when(~F.col("archetype").isin("opinion", "question"), _turn(F.col("proof"), idx))
    told = placed.withColumn("belief_ref", belief).withColumn("proof_ref", ref)
    fits = lambda r: F.array_contains(r["serves"], F.col("pillar")) & F.array_contains(r["archetypes"], F.col("archetype")) & (~F.coalesce(r["needs_proof"], F.lit(False)) | F.col("proof_ref").isNotNull())
    first = F.get(F.filter("rungs", lambda r: r["rung"] == 1), F.lit(0))["rung"]
    rung = F.coalesce(F.get(F.filter("rungs", fits), F.lit(0))["rung"], first)
    hook = F.create_map(*[F.lit(x) for kv in HOOK_BY_ARCHETYPE.items() for x in kv])[F.col("archetype")]
    slot = F.concat(F.lit("slot-"), F.date_format("start", "yyyy-MM-dd"), F.lit("-"), F.lpad((idx + 1).cast("string"), 3, "0"))
    return told.select(
        F.col("_key").alias(key), slot.alias("id"), "idx", "date", _turn(F.col("times"), idx).alias("time"), "pillar", "archetype", "belief_ref", "proof_ref", rung.alias("offer_rung"), hook.alias("hook_family"), claim_level(F.col("archetype"), F.col("proof_ref").isNotNull()).alias("claim_level")
    )


def broken_rules(planned: DataFrame, personas: DataFrame, key: str) -> DataFrame:
    """(key, rule, subject, severity): the rules that each persona's calendar breaks; planned has key, pillar and archetype.

    Slots are counted by archetype before they are gathered, so a persona is a handful of rows wherever it is
    judged.  A pillar with a weight and no slot is starved.
    """
    n = planned.groupBy(key, "archetype", "pillar").agg(F.count(F.lit(1)).alias("_n"))
    one = n.groupBy(key).agg(
        F.sum("_n").alias("_all"),
        F.sum(F.when(F.col("archetype").isin(*ACTIONABLE), F.col("_n")).otherwise(0)).alias("_act"),
        F.collect_list(F.struct("archetype", "_n")).alias("_archetypes"),
        F.collect_set("pillar").alias("_pillars"),
    )
    both = personas.select(key, "pillars", "proof", "beliefs").join(one, key, "left")
    rule = lambda name, subject, severity, hit: F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("rule"), subject.alias("subject"), F.lit(severity).alias("severity")))
    plan, strings = F.lit("plan"), F.expr(_STRINGS)
    of = lambda a: F.aggregate(F.filter("_archetypes", lambda x: x["archetype"] == a), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    kinds = F.array_distinct(F.transform("_archetypes", lambda x: x["archetype"]))
    over = F.transform(F.filter(kinds, lambda a: of(a) / F.col("_all") > MOST_SHARE + 0.02), lambda a: rule("archetype_share", a, "warn", F.lit(True)))
    starved = F.transform(F.filter("pillars", lambda p: (p["weight"] > 0) & ~F.array_contains(F.coalesce("_pillars", strings), p["id"])), lambda p: rule("starved_pillar", p["id"], "warn", F.lit(True)))
    simple = F.array(
        rule("actionable_share", plan, "warn", F.col("_act") / F.col("_all") < LEAST_ACTIONABLE),
        rule("no_eligible_dates", plan, "blocker", F.col("_all").isNull()),
        rule("thin_proof", plan, "warn", F.size(F.coalesce("proof", strings)) < 3),
        rule("no_beliefs", plan, "warn", F.size(F.coalesce("beliefs", strings)) == 0),
    )
    none = F.expr("cast(array() as array<struct<rule:string,subject:string,severity:string>>)")
    found = F.filter(F.concat(simple, F.coalesce(over, none), F.coalesce(starved, none)), lambda x: x.isNotNull())
    return both.select(key, F.explode_outer(found).alias("_f")).filter("_f is not null").select(key, "_f.*")
