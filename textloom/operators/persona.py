"""Settings of many personas as one table: gaps, references, publishing sanity and voice against samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import round_half_up

#: One row for each persona; missing parts are null.
PERSONA = """persona_id string,
 profile struct<display_name:string,role_title:string,domain:string,timezone:string>,
 positioning struct<statement:string,problem:string,method:string,differentiator:string>,
 publish struct<mode:string,approval_required:boolean>, primary_keyword string, require_permission boolean,
 proof array<struct<id:string,tier:string,claim:string,source:string,permission:string>>, assets array<struct<id:string,proof_refs:array<string>>>,
 beliefs array<struct<id:string,claim:string,confidence:string,evidence_refs:array<string>>>, hot_takes array<struct<id:string,evidence_refs:array<string>>>,
 pillars array<struct<id:string,promise:string,weight:double,maps_to_beliefs:array<string>>>, segments array<struct<id:string>>, primary_segment string,
 ladder array<struct<rung:int,id:string,cta_text:string,serves:array<string>>>, paid_offers array<struct<name:string,outcome:string,price_model:string,proof_refs:array<string>>>,
 voice struct<target_words:double,min_length_variance:double,emoji:boolean>, samples array<string>"""


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("array()"))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _rows(condition: Column, gap: Column | str, blocks: bool) -> Column:
    """Array of one finding, or of none."""
    gap = F.lit(gap) if isinstance(gap, str) else gap
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(gap.alias("gap"), F.lit(blocks).alias("blocks")))).otherwise(F.expr("cast(array() as array<struct<gap:string,blocks:boolean>>)"))


def _each(items: Column, condition, gap, blocks: bool) -> Column:
    return F.transform(F.filter(items, condition), lambda x: F.struct(gap(x).alias("gap"), F.lit(blocks).alias("blocks")))


def _refs(items: Column, ids: Column, refs, gap, blocks: bool) -> Column:
    """A finding for each reference of each item that is not among the ids."""
    unknown = lambda x: F.filter(F.coalesce(refs(x), F.expr("cast(array() as array<string>)")), lambda r: ~F.array_contains(ids, r))
    return F.flatten(F.transform(items, lambda x: F.transform(unknown(x), lambda r: F.struct(F.concat(gap(x), F.lit(" -> "), r).alias("gap"), F.lit(blocks).alias("blocks")))))


def gaps(personas: DataFrame) -> DataFrame:
    """(persona_id, gap, blocks): what is to be filled in before a persona may be used; only some gaps block."""
    filled = F.filter(_list("proof"), lambda e: ~_blank(e["claim"]) & ~_blank(e["tier"]))
    ids = lambda c: F.transform(_list(c), lambda x: F.coalesce(x["id"], F.lit("")))
    total = F.aggregate(_list("pillars"), F.lit(0.0), lambda a, x: a + F.coalesce(x["weight"], F.lit(0.0)))
    found = [_rows(F.col("profile").isNull(), "identity", True)]
    there = F.col("profile").isNotNull()
    found += [_rows(there & _blank(F.col(f"profile.{k}")), f"profile.{k}", k != "timezone") for k in ("display_name", "role_title", "domain", "timezone")]
    found += [_rows(~F.col("profile.domain").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & ~_blank(F.col("profile.domain")), "profile.domain_format", True)]
    found += [_rows(there & _blank(F.col(f"positioning.{k}")), f"positioning.{k}", True) for k in ("statement", "problem", "method", "differentiator")]
    found += [
        _rows(there & _blank(F.col("primary_keyword")), "keywords.primary.keyword", True),
        _rows(there & (F.size(filled) < 3), "proof.entries", False),
        _each(filled, lambda e: _blank(e["source"]), lambda e: F.concat(F.lit("proof."), e["id"], F.lit(".source")), True),
        _each(filled, lambda e: F.coalesce(F.col("require_permission"), F.lit(False)) & (F.coalesce(e["permission"], F.lit("")) == "requested"), lambda e: F.concat(F.lit("proof."), e["id"], F.lit(".permission")), False),
        _rows(there & ~F.exists(_list("paid_offers"), lambda o: ~_blank(o["name"]) & ~_blank(o["outcome"]) & ~_blank(o["price_model"])), "offers.paid_offers", True),
        _each(_list("ladder"), lambda r: _blank(r["cta_text"]), lambda r: F.concat(F.lit("offers."), r["id"], F.lit(".cta_text")), True),
        _rows(there & (F.size(_list("samples")) < 3), "voice.samples", False),
        _rows(there & (F.size(F.filter(_list("beliefs"), lambda b: ~_blank(b["claim"]))) < 3), "pov-map.beliefs", False),
        _rows(there & (F.abs(total - 1) > 0.02), "pov-map.pillars.weight_sum", True),
        _refs(_list("pillars"), ids("beliefs"), lambda p: p["maps_to_beliefs"], lambda p: F.concat(F.lit("pov-map."), p["id"], F.lit(".maps_to_beliefs")), True),
        _each(_list("beliefs"), lambda b: (F.coalesce(b["confidence"], F.lit("")) == "high") & (F.coalesce(F.size(b["evidence_refs"]), F.lit(0)) == 0), lambda b: F.concat(F.lit("pov-map."), b["id"], F.lit(".evidence_refs")), False),
    ]
    return personas.select("persona_id", F.explode_outer(F.concat(*found)).alias("_g")).filter("_g is not null").select("persona_id", "_g.gap", "_g.blocks")


def references(personas: DataFrame) -> DataFrame:
    """(persona_id, reference, severity): references to evidence, segments and pillars that aren't defined."""
    ids = lambda c: F.transform(_list(c), lambda x: F.coalesce(x["id"], F.lit("")))
    evidence = ids("proof")
    name = lambda kind, field: lambda x: F.concat(F.lit(f"{kind} "), F.coalesce(x[field].cast("string"), F.lit("")))
    found = F.concat(
        _refs(_list("beliefs"), evidence, lambda x: x["evidence_refs"], name("belief", "id"), True),
        _refs(_list("hot_takes"), evidence, lambda x: x["evidence_refs"], name("hot take", "id"), False),
        _refs(_list("paid_offers"), evidence, lambda x: x["proof_refs"], name("offer", "name"), False),
        _refs(_list("assets"), F.concat(evidence, ids("assets")), lambda x: x["proof_refs"], name("asset", "id"), False),
        _rows(~F.array_contains(ids("segments"), F.coalesce(F.col("primary_segment"), F.lit("?"))), "audience.primary", True),
        _refs(_list("ladder"), ids("pillars"), lambda x: x["serves"], name("rung", "rung"), False),
    )
    out = personas.select("persona_id", F.explode_outer(found).alias("_g")).filter("_g is not null")
    return out.select("persona_id", F.col("_g.gap").alias("reference"), F.when(F.col("_g.blocks"), "blocker").otherwise("warn").alias("severity"))


def publishing(personas: DataFrame) -> DataFrame:
    """(persona_id, rule, severity) of publishing settings that contradict each other or the gaps."""
    blocked = gaps(personas).filter("blocks").groupBy("persona_id").agg(F.count(F.lit(1)).alias("_n"))
    auto = F.col("publish.mode") == "auto"
    rules = [("auto_needs_no_approval", "warn", auto & F.col("publish.approval_required")), ("auto_without_timezone", "blocker", auto & _blank(F.col("profile.timezone"))), ("auto_with_gaps", "blocker", auto & (F.coalesce("_n", F.lit(0)) > 0))]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(c, F.lit(False)).alias("hit")) for n, s, c in rules])
    return personas.join(blocked, "persona_id", "left").select("persona_id", F.explode(rows).alias("_r")).filter("_r.hit").select("persona_id", "_r.rule", "_r.severity")


def voice(personas: DataFrame) -> DataFrame:
    """(persona_id, finding, severity, measured): voice settings against the average style of the persona's samples."""
    samples = personas.select("persona_id", "voice", F.explode("samples").alias("text"))
    style = T.style_profile(samples)
    a = style.groupBy("persona_id").agg(F.first("voice").alias("voice"), F.count(F.lit(1)).alias("n"), F.avg("mean_sentence_words").alias("_m"), F.avg("length_variance").alias("_v"), F.count_if(F.col("emoji") > 0).alias("_e"), F.count_if(F.col("hashtags") > 0).alias("_h"))
    target = F.coalesce("voice.target_words", F.lit(14.0))
    off = F.abs(F.col("_m") - target) / target
    rules = [
        ("voice.mean_sentence_words", F.when(off > 0.7, "blocker").otherwise("warn"), off > 0.4, F.col("_m")),
        ("voice.length_variance", F.lit("warn"), F.col("_v") < F.coalesce("voice.min_length_variance", F.lit(0.35)), F.col("_v")),
        ("voice.emoji_conflict", F.lit("warn"), ~F.coalesce("voice.emoji", F.lit(False)) & (F.col("_e") > 0), F.col("_e").cast("double")),
        ("voice.hashtag_usage", F.lit("nice"), F.col("_h") < F.col("n") / 2, F.col("_h").cast("double")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("finding"), s.alias("severity"), c.alias("hit"), round_half_up(m, 3).alias("measured")) for n, s, c, m in rules])
    return a.select("persona_id", F.explode(rows).alias("_r")).filter("_r.hit").select("persona_id", "_r.finding", "_r.severity", "_r.measured")


#: Parts of a persona whose entries are known by an id.
PARTS = ("proof", "assets", "segments", "pillars", "beliefs", "hot_takes")


def entries(personas: DataFrame, part: str) -> DataFrame:
    """(persona_id, id, entry): the entries of a part; of entries with one id the first."""
    if part not in PARTS:
        raise ValueError(f"no part {part}")
    rows = personas.select("persona_id", F.posexplode(part).alias("_at", "entry"))
    return rows.groupBy("persona_id", F.col("entry.id").alias("id")).agg(F.min_by("entry", "_at").alias("entry"))


def lookup(refs: DataFrame, personas: DataFrame, part: str, ref_col: str = "ref") -> DataFrame:
    """refs (persona_id, ref, ...) with the entry that each names, null where there is none."""
    found = entries(personas, part).withColumnRenamed("id", ref_col)
    return refs.join(found, ["persona_id", ref_col], "left")


def primary_segment(personas: DataFrame) -> DataFrame:
    """(persona_id, ref, entry) of each persona's primary segment; the entry is null if it isn't defined."""
    return lookup(personas.select("persona_id", F.col("primary_segment").alias("ref")), personas, "segments")


def with_voice_report(posts: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """posts with the struct voice_report of their row in scored (id and any measures), null where it has none: a report written back into its post."""
    measures = [c for c in scored.columns if c != id_col]
    return posts.join(scored.select(id_col, F.struct(*measures).alias("voice_report")), id_col, "left")
