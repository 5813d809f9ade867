"""Profile rubric and import verification over tables of nested profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import B, extract, trim
from textloom.operators import rules as R

PROFILE = """id string, custom_url_slug string, publicIdentifier string, headline string, about string,
 experience array<struct<title:string,company:string,period:string,start:string,end:string,description:string,bullets:array<string>>>,
 featured array<struct<title:string,kind:string,url:string,description:string>>, education array<struct<school:string,field:string,year:int>>,
 licenses array<struct<name:string,issuer:string,year:int>>, skills array<string>, contact map<string,string>"""

# The profile rubric, its bands, and the import checks.
RUBRIC = tuple(
    R.Check(i, d, p, s)
    for d, checks in (
        ("positioning_clarity", (("pc1", 4, "blocker"), ("pc2", 4, "blocker"), ("pc3", 4, "warn"), ("pc4", 4, "warn"), ("pc5", 3, "warn"), ("pc6", 3, "nice"))),
        ("proof_strength", (("ps1", 5, "blocker"), ("ps2", 5, "warn"), ("ps3", 4, "warn"), ("ps4", 4, "blocker"))),
        ("search_and_discovery", (("sc1", 4, "blocker"), ("sc2", 4, "warn"), ("sc3", 3, "nice"), ("sc4", 3, "warn"))),
        ("completeness", (("cm1", 2, "nice"), ("cm2", 2, "warn"), ("cm3", 2, "blocker"), ("cm4", 2, "warn"), ("cm5", 2, "nice"), ("cm6", 2, "warn"), ("cm7", 2, "nice"))),
        ("readability", (("rb1", 3, "warn"), ("rb2", 3, "warn"), ("rb3", 2, "nice"), ("rb4", 2, "nice"))),
        ("conversion", (("cv1", 3, "warn"), ("cv2", 3, "blocker"), ("cv3", 3, "warn"), ("cv4", 3, "nice"))),
        ("consistency", (("pcx1", 4, "blocker"), ("pcx2", 3, "nice"), ("pcx3", 3, "nice"))),
    )
    for i, p, s in checks
)
BANDS = (("not_ready", 0, 39), ("needs_work", 40, 59), ("workable", 60, 79), ("strong", 80, 92), ("category_leader", 93, 100))
IMPORT = (
    ("headline_present", "blocker"), ("headline_not_placeholder", "blocker"), ("headline_not_just_a_name", "warn"), ("about_length_plausible", "warn"), ("about_not_duplicate_headline", "warn"),
    ("about_paragraph_structure", "nice"), ("experience_monotonic", "warn"), ("experience_has_detail", "warn"), ("experience_present", "blocker"), ("skills_present", "warn"),
    ("featured_parsed", "warn"), ("contact_present", "nice"), ("numbers_present", "warn"), ("no_template_leftovers", "blocker"), ("reads_as_individual", "nice"),
)
PLACEHOLDER = r"(?i)^(add a headline|headline|your headline|—|-|\.\.\.|n/?a|update your headline|sign in|log ?in|join (?:now|linkedin)|welcome to linkedin|linkedin\s*\|?\s*sign)"
TEMPLATE = rf"(?i)lorem ipsum|{B}your name here{B}|{B}your headline here{B}|{B}company name{B}|{B}job title here{B}|{B}XX+|{B}TBD{B}|{B}fixme{B}"
AGENCY = rf"(?i){B}(agency|studio|consultancy|advisory firm|consulting firm|&\s*co{B}|our team of [0-9]+){B}|{B}[A-Za-z0-9_]+\s+(?:ltd|limited|llc|inc|incorporated|gmbh|pty|bv){B}"
CALLS = (rf"(?i){B}(?:comment|DM|dm me|message me|reply|email me|send me|reach out|book|call me|grab){B}", rf"(?i){B}(?:link|url) (?:is )?(?:in|below){B}", r"https?://\S+", rf"(?i){B}read more{B}")


def has(hay: Column, needle) -> Column:
    """Case-insensitive contains; a needle that isn't set stands nowhere."""
    if isinstance(needle, str):
        return F.lower(T.whole(hay)).contains(needle.lower())
    return F.lit(False)


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def visible_text(with_titles: bool = True) -> Column:
    """What a reader sees: headline, about, roles with their bullets, featured entries; the import reads descriptions instead of titles and featured."""
    roles = F.coalesce(F.col("experience"), F.expr("array()"))
    lists = lambda e: F.coalesce(e["bullets"], F.expr("cast(array() as array<string>)"))
    if with_titles:
        role = F.flatten(F.transform(roles, lambda e: F.concat(F.array(e["title"], e["company"]), lists(e))))
        featured = F.transform(F.coalesce(F.col("featured"), F.expr("array()")), lambda f: F.concat_ws(" ", f["title"], f["description"]))
        parts = F.concat(F.array("headline", "about"), role, featured)
    else:
        parts = F.concat(F.array("headline", "about"), F.flatten(F.transform(roles, lambda e: F.concat(F.array(e["description"]), lists(e)))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def score_checks(persona: dict) -> dict[str, Column]:
    """Pass Columns of the 32 checks over a table of profiles with the column _visible.

    persona: role_titles, primary_keyword, secondary_keywords, problem, method, differentiator, slug, banner, photo,
    proof (rows with claim, tier, source, permission), require_permission, forbid, paid_offers, destinations, avoid, promises,
    target_sentence_words and sample_style (aggregated style of the voice samples, or None).
    """
    p = persona.get
    head, about = T.whole(F.col("headline")), T.whole(F.col("about"))
    preview = F.substring(about, 1, 210)
    seen = F.col("_visible")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    numbers = T.claim_numbers(seen)
    roles = F.slice(F.coalesce(F.col("experience"), F.expr("array()")), 1, 3)
    digits = lambda e: F.size(F.filter(e["bullets"], lambda b: b.rlike("[0-9]")))
    proof = [e for e in p("proof", []) if e.get("claim") and e.get("tier")]
    bad = [e for e in proof if not e.get("source") or p("require_permission") and e.get("permission") == "requested"]
    offers = p("paid_offers", [])
    named = [o["name"] for o in offers if o.get("featured_slot")]
    places = [d for d in p("destinations", []) if d]
    import re

    real = any(re.match(r"(?i)(https?://|comment$|dm$)", d) for d in places) and not any(re.match(r"(?i)(TODO|TBD|xxx|example)", d) or not d.strip() for d in places)
    promises = [[w for w in re.split(r"\W+", (x or "").lower()) if len(w) > 4] for x in p("promises", [])]
    pillars = sum((any_of([has(seen, w) for w in terms]).cast("int") for terms in promises), F.lit(0))
    slug = F.coalesce(F.lit(p("slug")), F.col("custom_url_slug"), F.lit(""))
    primary = has(head, p("primary_keyword"))
    style = p("sample_style")
    return {
        "pc1": any_of([has(head, t) for t in p("role_titles", [])]),
        "pc2": primary,
        "pc3": head.rlike(rf"(?i){B}(for|that|so that|helps?|enables?|which){B}") | F.exists(numbers, lambda x: (x != "") & head.contains(x)),
        "pc4": ~preview.rlike(rf"(?i){B}(I|my|me){B}") & (has(preview, p("problem")) | has(preview, p("method"))),
        "pc5": has(head, p("method")) | has(preview, p("method")),
        "pc6": has(about, p("differentiator")),
        "ps1": F.size(F.array_distinct(F.filter(numbers, lambda x: ~x.rlike("^[0-9]{4}$")))) >= 3,
        "ps2": F.forall(roles, lambda e: (size(e["bullets"]) > 0) & (digits(e) >= 0.6 * F.size(e["bullets"]))),
        "ps3": F.exists(F.coalesce(F.col("featured"), F.expr("array()")), lambda f: F.coalesce(F.lower(f["kind"]).contains("case"), F.lit(False)) | F.coalesce(f["title"].rlike("(?i)case study"), F.lit(False))),
        "ps4": F.lit(bool(proof) and not bad),
        "sc1": primary,
        "sc2": any_of([has(preview, k) for k in p("secondary_keywords", [])]),
        "sc3": F.exists(F.slice(F.coalesce(F.col("skills"), F.expr("array()")), 1, 3), lambda s: has(s, p("primary_keyword"))),
        "sc4": (slug != "") & ~slug.rlike("^[0-9]+$") & ~F.coalesce(F.col("publicIdentifier").rlike("^[0-9]{5,}$"), F.lit(False)),
        "cm1": F.lit(bool(p("banner"))),
        "cm2": F.lit(bool(p("photo"))),
        "cm3": F.length(about) >= 500,
        "cm4": n("experience") >= 3,
        "cm5": n("education") + n("licenses") >= 1,
        "cm6": n("featured") >= 5,
        "cm7": F.exists(F.map_values(F.coalesce(F.col("contact"), F.expr("map()"))), lambda v: v.isNotNull() & (v != "")),
        "rb1": F.length(head).between(1, 220),
        "rb2": F.length(about).between(1, 2600) & preview.rlike(r"[.!?…,;:—-]\s*$"),
        "rb3": F.coalesce(F.array_max(F.transform(T.paragraphs(about), F.length)), F.lit(0)) <= 180,
        "rb4": T.mean(T.sentence_lengths(about)) <= p("target_sentence_words", 14) + 6,
        "cv1": any_of([about.rlike(c) for c in CALLS]) & ~any_of([about.rlike(f"(?i){B}{re.escape(f)}") for f in p("forbid", [])]),
        "cv2": F.lit(any(o.get("name") and o.get("outcome") and o.get("price_model") for o in offers)),
        "cv3": F.exists(F.coalesce(F.col("featured"), F.expr("array()")), lambda f: F.coalesce(f["title"].isin(named), F.lit(False))) if named else F.lit(False),
        "cv4": F.lit(real),
        "pcx1": ~any_of([has(seen, w) for w in p("avoid", [])]),
        "pcx2": pillars >= 2,
        "pcx3": T.style_similarity(lambda k: F.col(f"_s_{k}"), lambda k: F.lit(float(style[k]))) >= 0.6 if style else F.lit(False),
    }


def score_profiles(profiles: DataFrame, persona: dict) -> tuple[DataFrame, DataFrame]:
    """(findings, totals): long findings by id, and score, total (capped at 59 by a failed blocker), capped and band."""
    base = profiles.withColumn("_visible", visible_text())
    style = T.style_profile(base, "_visible")
    keys = [k for k, _ in T.STYLE_WEIGHTS]
    wide = style.select(*[c for c in base.columns], *[F.col(k).alias(f"_s_{k}") for k in keys])
    found = R.findings(wide, score_checks(persona), {}, RUBRIC, ("id",))
    return found, R.capped(found, ("id",), bands=BANDS)


def copy_numbers(text: Column) -> Column:
    """Numbers in profile copy with their units, without separators at their end."""
    found = extract(T.whole(text), rf"(?i){T.DIGIT}[0-9,]*(?:\.[0-9]+)?\s?(?:{T.UNITS})?{B}")
    return F.transform(found, lambda x: trim(F.regexp_replace(trim(x), r"[,.]+$", "")))


def is_year(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "").rlike("^(19|20)[0-9]{2}$")


def number_contexts(profiles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, value, has_unit, structural, context): the different numbers of each profile's copy, with the sentence around the first place of each.

    A year alone is structural, not a result.
    """
    base = profiles.select(id_col, visible_text(False).alias("_v"))
    rows = base.select(id_col, "_v", F.explode_outer(F.array_distinct(copy_numbers(F.col("_v")))).alias("value")).filter("value is not null")
    quoted = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace("value", r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    placed = rows.withColumn("_at", F.regexp_instr("_v", quoted) - 1)
    return placed.select(id_col, "value", F.col("value").rlike(rf"(?i)%|percent|x{B}|hours?|hrs?|days?|weeks?|months?|years?").alias("has_unit"), is_year(F.col("value")).alias("structural"), T.sentence_at(F.col("_v"), F.col("_at"), F.length("value")).alias("context"))


def verify_import(profiles: DataFrame) -> DataFrame:
    """(id, check_id, severity, passed) of the 15 import checks."""
    head, about = T.whole(F.col("headline")), T.whole(F.col("about"))
    h, a = trim(head), trim(about)
    roles = F.coalesce(F.col("experience"), F.expr("array()"))
    featured = F.coalesce(F.col("featured"), F.expr("array()"))
    names = F.filter(F.split(T.whole(F.col("custom_url_slug")), "[-_]"), lambda x: x != "")
    name_only = (F.size(F.split(h, r"\s+")) <= 5) & (F.size(names) > 0) & F.forall(names, lambda x: F.lower(head).contains(F.lower(x)))
    period = lambda e: F.coalesce(e["period"], F.concat_ws(" ", e["start"], e["end"]))
    years = F.filter(F.transform(roles, lambda e: T.first_year(period(e))), lambda y: y.isNotNull())
    later = F.exists(F.zip_with(F.slice(years, 2, 10_000), years, lambda cur, above: F.coalesce(cur > above, F.lit(False))), lambda x: x)
    detail = F.exists(roles, lambda e: (F.coalesce(F.size(e["bullets"]), F.lit(0)) > 0) | (F.length(T.whole(e["description"])) > 20))
    full = lambda f: any_of([F.coalesce(f[c], F.lit("")) != "" for c in ("title", "url", "description")])
    passes = {
        "headline_present": h != "",
        "headline_not_placeholder": (h != "") & ~h.rlike(PLACEHOLDER),
        "headline_not_just_a_name": (h != "") & ~name_only,
        "about_length_plausible": F.length(about).between(500, 2600),
        "about_not_duplicate_headline": ~((a != "") & (a == h)),
        "about_paragraph_structure": ~((F.length(about) > 200) & ~about.contains("\n") & ~about.rlike(r"\s{3,}")),
        "experience_monotonic": ~later,
        "experience_has_detail": detail,
        "experience_present": F.size(roles) > 0,
        "skills_present": F.size(F.coalesce(F.col("skills"), F.expr("array()"))) > 0,
        "featured_parsed": F.forall(featured, full),
        "contact_present": F.exists(F.map_values(F.coalesce(F.col("contact"), F.expr("map()"))), lambda v: v.isNotNull() & (v != "")),
        "numbers_present": F.exists(copy_numbers(visible_text(False)), lambda x: ~is_year(x)),
        "no_template_leftovers": ~any_of([head.rlike(TEMPLATE), about.rlike(TEMPLATE), F.exists(roles, lambda e: T.whole(e["description"]).rlike(TEMPLATE))]),
        "reads_as_individual": ~F.concat(head, F.lit(" "), about).rlike(AGENCY),
    }
    severity = {"about_length_plausible": F.when(about != "", F.lit("warn")).otherwise("blocker")}
    rows = [F.struct(F.lit(c).alias("check_id"), severity.get(c, F.lit(s)).alias("severity"), F.coalesce(passes[c], F.lit(False)).alias("passed")) for c, s in IMPORT]
    return profiles.select("id", F.explode(F.array(*rows)).alias("_c")).select("id", "_c.*")


def import_verdict(found: DataFrame) -> DataFrame:
    """(id, passed, checks, verdict): a failed blocker is unsound, a failed warning usable_with_caveats."""
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)) > 0
    return found.groupBy("id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("checks"), F.when(bad("blocker"), "unsound").when(bad("warn"), "usable_with_caveats").otherwise("sound").alias("verdict"))
