"""Calendar planning: date spine, archetypes, pillars, slots and the plan's own rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.regex import round_half_up, trim
from textloom.sources.tables import literal

# Archetypes in the order in which slots are dealt, those a reader can act on, hooks.
ARCHETYPES = ("how_to", "framework", "observation", "checklist", "case_study", "myth_busting", "opinion", "story", "question", "announcement")
ACTIONABLE = ("framework", "how_to", "case_study", "checklist", "myth_busting", "observation")
HOOK_BY_ARCHETYPE = {"case_study": "proof-first", "how_to": "number-list", "framework": "demonstrable", "checklist": "number-list", "opinion": "wrong-belief", "myth_busting": "wrong-belief", "observation": "observation", "story": "story-open", "question": "direct-question", "announcement": "consequence"}
MOST_SHARE, LEAST_ACTIONABLE = 0.25, 0.35
# What a slot's writer is told; {belief}, {take} and {assumption} are filled in, the second text stands in where they are missing.
BRIEFS = {
    "opinion": ("Argue: {take}", "Argue one belief from pov-map, hedged as opinion."),
    "framework": ('Teach the named method, with the belief "{belief}" as the spine.', "Teach the named method as a sequence the reader can reuse."),
    "how_to": ("A numbered procedure the reader can follow today. No step may be aspirational.",),
    "case_study": ("Situation, intervention, measured result. Every number from proof.yaml.",),
    "observation": ("A pattern noticed across real work, framed as observation not law.",),
    "myth_busting": ('Take the belief that "{assumption}" is wrong, and say why.', 'Take the belief that "a common assumption" is wrong, and say why.'),
    "story": ("One event, one decision, one consequence. No moral stated explicitly.",),
    "question": ("A specific question whose answer would change something for the reader.",),
    "announcement": ("Only if it concerns the person, not a product release.",),
    "checklist": ("A list where each item is verifiable as done or not done.",),
}


def date_spine(spark: SparkSession, start: date, days: int, weekdays: tuple[str, ...] = ("Mon", "Tue", "Wed", "Thu", "Fri")) -> DataFrame:
    """(idx, date): the eligible days of the window, numbered from 0."""
    all_days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.date_add(F.lit(start), days - 1))).alias("date"))
    kept = all_days.filter(F.date_format("date", "E").isin(*weekdays))
    return kept.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("idx"), "date")


def archetype_at(idx: Column) -> Column:
    """Archetype of a slot: an even deal over the list.

    A ceiling on the share of one archetype changes nothing in an even deal: the counts differ by one at
    most, so where any is above the ceiling, none is below it to take a slot.
    """
    return F.element_at(F.array(*[F.lit(a) for a in ARCHETYPES]), (idx % len(ARCHETYPES) + 1).cast("int"))


def pillar_pool(pillars: DataFrame, total: int) -> DataFrame:
    """(pos, pillar): each pillar as often as its weight says, rounded half up, then in turn until `total`."""
    n = F.floor(F.col("weight") * total + 0.5).cast("int")
    full = pillars.withColumn("_n", n).filter("_n > 0").select("ord", "id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("k"))
    one = Window.partitionBy(F.lit(0))
    ranked = full.select((F.row_number().over(one.orderBy("ord", "k")) - 1).alias("pos"), F.col("id").alias("pillar"))
    # What rounding leaves open is dealt in turn, by place.
    ids = pillars.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("_ids"))
    open_ = list(range(ranked.count(), total))
    spare = ids.select("_ids", F.explode(F.array(*map(F.lit, open_)) if open_ else F.expr("cast(array() as array<int>)")).alias("pos")).select("pos", F.get("_ids", F.col("pos") % F.size("_ids")).alias("pillar"))
    return ranked.select(F.col("pos").cast("int").alias("pos"), "pillar").unionByName(spare)


def rotation(pool: DataFrame, total: int) -> DataFrame:
    """(idx, pillar) of `total` slots, dealt from the pool (pos, pillar) so that neighbours differ where they can.

    A slot takes the pool's pillar at its own place.  If that is the pillar of the slot before, it takes the first pillar of
    the pool that differs from it and whose distance from the slot's place does not lead to it either; else its own after all.
    One array of the slots' few hundred pillars is folded inside an expression.
    """
    one = pool.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pillar"))), lambda x: x["pillar"]).alias("_pool"))
    return one.select(F.posexplode(dealt(F.col("_pool"), F.lit(total))).alias("idx", "pillar"))


def dealt(pool: Column, total: Column) -> Column:
    """array<string> of the pillars of `total` slots, dealt from an array of pillars by the rule of rotation(); empty for an empty one."""
    size = F.size(pool)

    def deal(done: Column, idx: Column) -> Column:
        own = F.get(pool, idx % size)
        fits = lambda p, i: F.when((p != done["last"]) & (F.get(pool, (idx + i) % size) != done["last"]), p)
        other = F.get(F.filter(F.transform(pool, fits), lambda p: p.isNotNull()), F.lit(0))
        pick = F.when(own.eqNullSafe(done["last"]), F.coalesce(other, own)).otherwise(own)
        return F.struct(pick.alias("last"), F.concat(done["all"], F.array(pick)).alias("all"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.expr("cast(array() as array<string>)").alias("all"))
    slots_ = F.when((total > 0) & (size > 0), F.sequence(F.lit(0), total - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(slots_, start, deal, lambda done: done["all"])


def claim_level(archetype: Column, has_proof: Column) -> Column:
    return (
        F.when(archetype.isin("opinion", "question"), 1)
        .when(archetype == "announcement", 4)
        .when(archetype == "myth_busting", F.when(has_proof, 3).otherwise(1))
        .otherwise(F.when(has_proof, 3).otherwise(2))
    )


def brief(archetype: Column, belief: Column, take: Column, line: Column) -> Column:
    """What the writer of a slot is told; belief is the claim of the slot's belief, take and line those of the first hot take."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
    parts = {
        "{take}": F.when(take.isNotNull() | line.isNotNull(), F.coalesce(F.nullif(line, F.lit("")), take)),
        "{belief}": cut(trim(belief), 80),
        "{assumption}": cut(trim(F.coalesce(belief, take)), 90),
    }
    out = F.lit("")
    for kind, texts in BRIEFS.items():
        said = F.lit(texts[0])
        for mark, value in parts.items():
            if mark in texts[0]:
                before, after = texts[0].split(mark)
                said = F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(texts[1]))
        out = F.when(archetype == kind, said).otherwise(out)
    return out


def slots(
    spark: SparkSession, start: date, days: int, pillars: DataFrame, proof: list[str], rungs: list[dict], times: tuple[str, ...] = ("08:30",), beliefs: tuple[str, ...] = (),
    per_day: int = 1, claims: dict[str, str] | None = None, hot_take: dict | None = None, segment: str | None = None,
) -> DataFrame:
    """One row per slot: id, idx, date, time, pillar, segment, archetype, belief_ref, proof_ref, offer_rung, hook_family, hook_brief, claim_level.

    pillars: (ord, id, weight, maps_to_beliefs); claims: belief id -> claim; hot_take: its take and line.  Each eligible day
    has per_day slots.
    """
    days_ = date_spine(spark, start, days)
    total = days_.count() * per_day
    at = lambda values, idx: F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int")) if values else F.lit(None).cast("string")
    idx = F.col("idx")
    spine = days_.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1)))).select((F.col("idx") * per_day + F.col("k")).cast("int").alias("idx"), "date")
    order = rotation(pillar_pool(pillars, total), total)
    # A calendar has some hundred slots and a persona a few pillars; Spark broadcasts by its own measure.
    base = spine.join(order, "idx").select("idx", "date", "pillar", archetype_at(idx).alias("archetype")).join(pillars.select(F.col("id").alias("pillar"), "maps_to_beliefs"), "pillar", "left")
    own = F.when(F.size("maps_to_beliefs") > 0, F.element_at("maps_to_beliefs", (idx % F.size("maps_to_beliefs") + 1).cast("int"))).otherwise(at(beliefs, idx))
    ref = F.when(F.col("archetype").isin("opinion", "question"), F.lit(None).cast("string")).otherwise(at(proof, idx))
    rung = F.lit(next((r["rung"] for r in rungs if r["rung"] == 1), None))
    for r in reversed(rungs):
        fits = F.col("pillar").isin(*r["serves"]) & F.col("archetype").isin(*r["archetypes"])
        if r.get("needs_proof"):
            fits = fits & ref.isNotNull()
        rung = F.when(fits, F.lit(r["rung"])).otherwise(rung)
    lookup = lambda d, key: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[key] if d else F.lit(None).cast("string")
    hot = hot_take or {}
    told = brief(F.col("archetype"), lookup(claims or {}, F.col("belief_ref")), F.lit(hot.get("take")).cast("string"), F.lit(hot.get("line")).cast("string"))
    return base.withColumn("belief_ref", own).select(
        F.concat(F.lit(f"slot-{start.isoformat()}-"), F.lpad((idx + 1).cast("string"), 3, "0")).alias("id"), "idx", "date", at(list(times), idx).alias("time"), "pillar", F.lit(segment).cast("string").alias("segment"), "archetype", "belief_ref", ref.alias("proof_ref"), rung.alias("offer_rung"),
        lookup(HOOK_BY_ARCHETYPE, F.col("archetype")).alias("hook_family"), told.alias("hook_brief"), claim_level(F.col("archetype"), ref.isNotNull()).alias("claim_level"),
    )


def distribution(planned: DataFrame, pillars: DataFrame) -> DataFrame:
    """(kind, key, planned, actual, count): each pillar's share in the plan beside its weight, and the shares of archetypes.

    A pillar without a slot has count 0; a slot's pillar that is not among the pillars is left out.
    """
    n = lambda key: planned.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    total = max(1, planned.count())
    mine = pillars.select(F.col("id").alias("key"), "weight").join(n("pillar"), "key", "left").select(F.lit("pillar").alias("kind"), "key", round_half_up(F.col("weight"), 3).alias("planned"), F.coalesce("count", F.lit(0)).alias("count"))
    kinds = n("archetype").select(F.lit("archetype").alias("kind"), "key", F.lit(None).cast("double").alias("planned"), "count")
    return mine.unionByName(kinds).select("kind", "key", "planned", round_half_up(F.col("count") / F.lit(total), 3).alias("actual"), "count")


def labelled_levels(planned: DataFrame, ladder: DataFrame) -> DataFrame:
    """(claim_level, label, count): slots of each claim level with its label of the ladder (level, label), compared as strings; empty without one."""
    n = planned.groupBy(F.col("claim_level").cast("string").alias("claim_level")).agg(F.count(F.lit(1)).alias("count"))
    return n.join(ladder.select(F.col("level").cast("string").alias("claim_level"), "label"), "claim_level", "left").select("claim_level", F.coalesce("label", F.lit("")).alias("label"), "count")


def next_monday(day: Column) -> Column:
    """The first Monday after a day; a calendar without a start begins there."""
    return F.next_day(day, "Mon")


def plan_violations(planned: DataFrame, n_proof: int, n_beliefs: int, n_hot_takes: int, n_gaps: int = 0) -> DataFrame:
    """(rule, subject, severity) of the rules that a plan breaks."""
    spark = planned.sparkSession
    n = planned.groupBy("archetype").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    over = n.filter(F.col("n") / F.col("all") > MOST_SHARE + 0.02).select(F.lit("archetype_share").alias("rule"), F.col("archetype").alias("subject"), F.lit("warn").alias("severity"))
    act = planned.agg((F.count_if(F.col("archetype").isin(*ACTIONABLE)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("s"), F.count(F.lit(1)).alias("n"))
    low = act.filter(f"s < {LEAST_ACTIONABLE}").select(F.lit("actionable_share").alias("rule"), F.lit("plan").alias("subject"), F.lit("warn").alias("severity"))
    none = act.filter("n = 0").select(F.lit("no_eligible_dates").alias("rule"), F.lit("plan").alias("subject"), F.lit("blocker").alias("severity"))
    known = [("thin_proof", "plan", "warn", n_proof < 3), ("no_beliefs", "plan", "warn", n_beliefs == 0), ("no_hot_takes", "plan", "nice", n_hot_takes == 0), ("persona_incomplete", "plan", "blocker", n_gaps > 0)]
    rest = literal(spark, [dict(zip(("rule", "subject", "severity"), k)) for k in known if k[3]], "rule string, subject string, severity string")
    return over.unionByName(low).unionByName(none).unionByName(rest)
