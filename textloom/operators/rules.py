"""Rubrics: measures become findings, dimensions, totals, caps and bands."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.regex import round_half_up


@dataclass(frozen=True)
class Check:
    """One check of a rubric; a judged one waits for a person and has no computed result."""

    id: str
    dimension: str
    points: int
    severity: str = "warn"
    judged: bool = False


# The post rubric and its bands.
POST = tuple(
    Check(i, d, p, judged=i in ("h3", "h4", "s1", "s3", "st4", "vd2", "vm4", "ct3"))
    for d, checks in (
        ("hook", (("h1", 6), ("h2", 6), ("h3", 4), ("h4", 4))),
        ("specificity", (("s1", 7), ("s2", 7), ("s3", 6))),
        ("structure", (("st1", 5), ("st2", 4), ("st3", 3), ("st4", 3))),
        ("value_density", (("vd1", 5), ("vd2", 5), ("vd3", 5))),
        ("voice_match", (("vm1", 5), ("vm2", 4), ("vm3", 3), ("vm4", 3))),
        ("cta", (("ct1", 4), ("ct2", 3), ("ct3", 3))),
        ("format_fit", (("ff1", 2), ("ff2", 2), ("ff3", 1))),
    )
    for i, p in checks
)
POST_BANDS = (("reject", 0, 59), ("revise", 60, 74), ("approve", 75, 89), ("strong", 90, 100))
SEVERITY = {"blocker": 0, "warn": 1, "nice": 2}


def from_document(doc: dict) -> tuple[tuple[Check, ...], tuple[tuple[str, int, int], ...]]:
    """(checks, bands) of a rubric document as readers.load_rubric gives it: dimensions with checks, and grade_bands or bands."""
    checks = tuple(Check(c["id"], d["id"], int(c["points"]), c.get("severity") or "warn", c.get("computed") is False) for d in doc.get("dimensions") or [] for c in d.get("checks") or [])
    return checks, tuple((b["label"], int(b["min"]), int(b["max"])) for b in doc.get("grade_bands") or doc.get("bands") or [])


def band(score: Column, bands=POST_BANDS) -> Column:
    """Label of the first inclusive range that holds the score; scores between ranges are 'unclassified'."""
    out = F.lit("unclassified")
    for label, low, high in reversed(bands):
        out = F.when((score >= low) & (score <= high), F.lit(label)).otherwise(out)
    return out


def findings(measures: DataFrame, passes: Mapping[str, Column], measured: Mapping[str, Column], rubric=POST, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Long form: keys, check_id, rubric_pos, dimension, severity, points, judged, passed, measured.

    All checks are Columns over one wide row, so a subject's findings come from one pass without a shuffle.
    A check without a Column fails, a judged one neither passes nor counts.
    """
    rows = [
        F.struct(
            F.lit(c.id).alias("check_id"),
            F.lit(i).alias("rubric_pos"),
            F.lit(c.dimension).alias("dimension"),
            F.lit(c.severity).alias("severity"),
            F.lit(c.points).alias("points"),
            F.lit(c.judged).alias("judged"),
            (F.lit(False) if c.judged or c.id not in passes else F.coalesce(passes[c.id], F.lit(False))).alias("passed"),
            measured.get(c.id, F.lit(None)).cast("string").alias("measured"),
        )
        for i, c in enumerate(rubric)
    ]
    return measures.select(*keys, F.explode_outer(F.array(*rows)).alias("_f")).select(*keys, "_f.*")


def dimensions(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    earned = F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0))
    possible = F.sum(F.when(~F.col("judged"), F.col("points")).otherwise(0))
    out = found.groupBy(*keys, "dimension").agg(earned.alias("points_earned"), possible.alias("points_possible"), F.sum(F.when(F.col("judged"), F.col("points")).otherwise(0)).alias("judged_points_pending"))
    return out.withColumn("ratio", F.when(F.col("points_possible") > 0, round_half_up(F.col("points_earned") / F.col("points_possible"), 3)).otherwise(F.lit(0.0)))


def totals(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), bands=POST_BANDS, hard_block: DataFrame | None = None) -> DataFrame:
    """keys, earned, possible, computed_score (0 to 100, one digit), hard_blocks, total, band.  A hard block makes the total 0 and the band 'reject'."""
    earned = F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0))
    possible = F.sum(F.when(~F.col("judged"), F.col("points")).otherwise(0))
    out = found.groupBy(*keys).agg(earned.alias("earned"), possible.alias("possible"))
    out = out.withColumn("computed_score", F.when(F.col("possible") > 0, round_half_up(F.col("earned") / F.col("possible") * 100, 1)).otherwise(F.lit(0.0)))
    out = out.withColumn("hard_blocks", F.lit("")) if hard_block is None else out.join(hard_block, list(keys), "left").withColumn("hard_blocks", F.coalesce("hard_blocks", F.lit("")))
    return _judged_by_blocks(out, bands)


def scored(measures: DataFrame, passes: Mapping[str, Column], hard_blocks: Column, rubric=POST, keys: tuple[str, ...] = ("doc_id",), bands=POST_BANDS) -> DataFrame:
    """The rows of totals() straight from the wide row of measures: no finding becomes a row, and nothing is shuffled."""
    earned = sum((F.when(F.coalesce(passes[c.id], F.lit(False)), F.lit(c.points)).otherwise(0) for c in rubric if c.id in passes and not c.judged), F.lit(0)).cast("long")
    possible = F.lit(sum(c.points for c in rubric if not c.judged)).cast("long")
    out = measures.select(*keys, earned.alias("earned"), possible.alias("possible"), hard_blocks.alias("hard_blocks"))
    out = out.withColumn("computed_score", F.when(F.col("possible") > 0, round_half_up(F.col("earned") / F.col("possible") * 100, 1)).otherwise(F.lit(0.0)))
    return _judged_by_blocks(out, bands)


def _judged_by_blocks(out: DataFrame, bands) -> DataFrame:
    blocked = F.col("hard_blocks") != ""
    return out.withColumn("total", F.when(blocked, F.lit(0.0)).otherwise(F.col("computed_score"))).withColumn("band", F.when(blocked, F.lit("reject")).otherwise(band(F.col("computed_score"), bands)))


def scored_status(scores: DataFrame, least: float = 75) -> DataFrame:
    """scores with the status that scoring gives a post: rejected by a hard block, in_review from the least total, else draft."""
    return scores.withColumn("status", F.when(F.col("hard_blocks") != "", "rejected").when(F.col("total") >= least, "in_review").otherwise("draft"))


def report_rows(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), actions: int = 6) -> DataFrame:
    """keys, findings, next_actions: the ordered findings of each subject as one nested row, as reports store them."""
    ranked = ordered(found, keys)
    item = F.struct("rank", "check_id", "dimension", "severity", "passed", "judged", "points", "measured")
    all_ = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("findings"))
    open_ = F.filter("findings", lambda f: ~f["passed"] & ~f["judged"])
    return all_.withColumn("next_actions", F.slice(F.transform(open_, lambda f: f["check_id"]), 1, actions))


def capped(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), cap: int = 59, bands=POST_BANDS) -> DataFrame:
    """keys, score, total, capped, band: a failed blocker caps the total; the band is that of the score before the cap."""
    out = found.groupBy(*keys).agg(F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0)).alias("score"), F.count_if((F.col("severity") == "blocker") & ~F.col("passed")).alias("_b"))
    return out.select(*keys, "score", F.when(F.col("_b") > 0, F.least("score", F.lit(cap))).otherwise(F.col("score")).alias("total"), ((F.col("_b") > 0) & (F.col("score") > cap)).alias("capped"), band(F.col("score"), bands).alias("band"))


def ordered(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), hard: Column | None = None) -> DataFrame:
    """found with rank: hard blocks, then failed ones, severity, points at stake; ties in the rubric's order."""
    rank = F.lit(3)
    for s, r in SEVERITY.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    order = Window.partitionBy(*keys).orderBy((hard if hard is not None else F.lit(False)).desc(), F.col("passed"), rank, F.desc("points"), "rubric_pos")
    return found.withColumn("rank", F.row_number().over(order))
