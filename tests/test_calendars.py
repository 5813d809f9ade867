"""Calendars of many personas against a plain one at a time, and against the calendar of a single persona."""

import math
import random
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from textloom.operators import calendars as C
from textloom.operators import planning as G

SCHEMA = "who string, " + C.PERSONA
NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def plain(p):
    days = [p["start"] + timedelta(i) for i in range(p["days"] or 0)] if p["start"] else []
    days = [d for d in days if NAMES[d.weekday()] in (p["weekdays"] or [])]
    per_day = p["per_day"] or 1
    pillars, total = p["pillars"] or [], len(days) * per_day
    pool = [x["id"] for x in pillars for _ in range(max(0, math.floor((x["weight"] or 0) * total + 0.5)))]
    pool += [pillars[i % len(pillars)]["id"] for i in range(len(pool), total) if pillars]
    out, last = [], None
    for i in range(total if pool else 0):
        pick = pool[i % len(pool)]
        if pick == last:
            pick = next((x for j, x in enumerate(pool) if x != last and pool[(i + j) % len(pool)] != last), pick)
        last = pick
        archetype = G.ARCHETYPES[i % 10]
        turn = lambda v: v[i % len(v)] if v else None
        own = next(x["beliefs"] for x in pillars if x["id"] == pick)
        ref = None if archetype in ("opinion", "question") else turn(p["proof"])
        rungs = p["rungs"] or []
        fits = [r["rung"] for r in rungs if pick in r["serves"] and archetype in r["archetypes"] and not (r["needs_proof"] and ref is None)] + [r["rung"] for r in rungs if r["rung"] == 1]
        out.append((p["who"], i, days[i // per_day], turn(p["times"]), pick, archetype, turn(own) or turn(p["beliefs"]), ref, fits[0] if fits else None))
    return out


def people():
    r = random.Random(2)
    made = []
    for i in range(40):
        pillars = [{"id": f"p{k}", "weight": r.choice((0.5, 0.3, 0.2, 0.0, None)), "beliefs": r.choice(([], None, [f"b{k}", "x"]))} for k in range(r.randint(0, 5))]
        rungs = [{"rung": k, "serves": r.sample(["p0", "p1", "p2", "p3"], 2), "archetypes": r.sample(G.ARCHETYPES, 4), "needs_proof": r.choice((True, False, None))} for k in (3, 1, 2)[: r.randint(0, 3)]]
        made.append({"who": f"w{i}", "start": date(2026, 1, 1) + timedelta(r.randint(0, 20)), "days": r.choice((0, 1, 9, 30, 45)), "weekdays": r.choice((list(NAMES[:5]), ["Sun"], [])), "per_day": r.choice((1, 2, 3, None)),
                     "times": r.choice((["08:30"], ["a", "b"], [])), "pillars": pillars, "proof": r.choice(([], ["h1"], ["h1", "h2", "h3"])), "beliefs": r.choice((["b"], [], None)), "rungs": rungs})
    nothing = dict.fromkeys(made[0])
    return made + [nothing | {"who": "none"}, made[3] | {"who": "twice"}, made[3] | {"who": "twice"}, nothing | {"who": "nulls", "start": date(2026, 1, 5), "days": 7, "weekdays": list(NAMES), "pillars": [{"id": "p0", "weight": 1.0, "beliefs": None}]}]


def test_every_persona_gets_its_own_calendar(spark):
    rows = people()
    found = C.calendars(spark.createDataFrame(rows, SCHEMA).repartition(5), "who").collect()
    got = [(r["who"], r["idx"], r["date"], r["time"], r["pillar"], r["archetype"], r["belief_ref"], r["proof_ref"], r["offer_rung"]) for r in found]
    assert sorted(got, key=repr) == sorted((x for p in rows for x in plain(p)), key=repr) and len(got) > 300


def test_no_shuffle_and_no_python(spark):
    plan = C.calendars(spark.createDataFrame(people(), SCHEMA), "who")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_one_persona_equals_the_single_calendar(spark):
    weights = (0.40, 0.25, 0.20, 0.10, 0.05)
    rungs = [{"rung": 1, "serves": ["p1", "p2"], "archetypes": ["opinion"], "needs_proof": False}]
    row = {"who": "a", "start": date(2026, 1, 5), "days": 30, "weekdays": list(NAMES[:5]), "per_day": 1, "times": ["08:30"], "pillars": [{"id": f"p{i + 1}", "weight": w, "beliefs": []} for i, w in enumerate(weights)], "proof": ["h1", "h2"], "beliefs": ["b1"], "rungs": rungs}
    many = C.calendars(spark.createDataFrame([row], SCHEMA), "who")
    pillars = spark.createDataFrame([(i, f"p{i + 1}", w, []) for i, w in enumerate(weights)], "ord int, id string, weight double, maps_to_beliefs array<string>")
    one = G.slots(spark, date(2026, 1, 5), 30, pillars, ["h1", "h2"], rungs, ("08:30",), ("b1",))
    same = ["id", "idx", "date", "time", "pillar", "archetype", "belief_ref", "proof_ref", "offer_rung", "hook_family", "claim_level"]
    assert sorted(map(tuple, many.select(*same).collect())) == sorted(map(tuple, one.select(*same).collect()))
    assert Counter(r["pillar"] for r in many.collect()) == {"p1": 11, "p2": 7, "p3": 2, "p4": 1, "p5": 1}


def test_broken_rules(spark):
    rows = people()
    df = spark.createDataFrame(rows, SCHEMA).filter("who != 'twice'")
    found = Counter((r["who"], r["rule"]) for r in C.broken_rules(C.calendars(df, "who"), df, "who").collect())
    for p in rows:
        if p["who"] == "twice":
            continue
        slots = plain(p)
        assert (found[p["who"], "no_eligible_dates"] == 1) == (not slots)
        assert (found[p["who"], "thin_proof"] == 1) == (len(p["proof"] or []) < 3)
        assert (found[p["who"], "no_beliefs"] == 1) == (not p["beliefs"])
        assert found[p["who"], "starved_pillar"] == sum((x["weight"] or 0) > 0 and x["id"] not in {s[4] for s in slots} for x in p["pillars"] or [])
        kinds = Counter(s[5] for s in slots)
        assert found[p["who"], "archetype_share"] == sum(n / len(slots) > 0.27 for n in kinds.values())
    planned = spark.createDataFrame([("lop", "story", "p0")] * 8 + [("lop", "how_to", "p0")] * 3, "who string, archetype string, pillar string")
    one = spark.createDataFrame([{"who": "lop", "proof": ["a"] * 3, "beliefs": ["b"], "pillars": []}], SCHEMA)
    assert sorted((r["rule"], r["subject"]) for r in C.broken_rules(planned, one, "who").collect()) == [("actionable_share", "plan"), ("archetype_share", "how_to"), ("archetype_share", "story")]
    assert C.calendars(df.limit(0), "who").count() == 0 and "pillar" in C.calendars(df.filter(F.lit(False)), "who").columns
