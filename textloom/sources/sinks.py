"""Sinks: the export queue, calendars and reports."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the queue and of the calendar, in the order that their readers expect.
QUEUE = "id date time pillar segment archetype belief_refs proof_refs offer_rung hook_family hook_brief claim_level status title body image_brief image_url visibility feed_distribution score approvals published_at published_url notes".split()
CALENDAR = "id date time pillar segment archetype belief_refs proof_refs offer_rung hook_family hook_brief claim_level status title score published_url notes".split()


def queue_rows(posts: DataFrame, visibility: str = "PUBLIC", feed: str = "MAIN_FEED") -> DataFrame:
    """The 24 columns of the queue, all strings, empty for what a post doesn't have."""
    have = set(posts.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    joined = lambda c: F.array_join(c, " ") if c in have else F.lit("")
    when = col("scheduled_for").cast("string")
    out = {
        "date": F.substring(when, 1, 10), "time": F.substring(when, 12, 5), "belief_refs": joined("belief_refs"), "proof_refs": joined("proof_refs"), "hook_family": col("hook_pattern"), "hook_brief": col("notes"), "body": col("text"), "image_url": F.lit(""),
        "visibility": F.coalesce(col("visibility"), F.lit(visibility)), "feed_distribution": F.coalesce(col("feed_distribution"), F.lit(feed)), "approvals": F.coalesce(F.to_json("approvals"), F.lit("[]")) if "approvals" in have else F.lit("[]"),
        "score": F.col("score.total") if "score" in have and dict(posts.dtypes)["score"].startswith("struct") else col("score"),
        "published_at": F.col("published.at") if "published" in have else F.lit(None), "published_url": F.col("published.url") if "published" in have else F.lit(None),
    }
    return posts.select(*[F.coalesce(out.get(c, col(c)).cast("string"), F.lit("")).alias(c) for c in QUEUE])


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes doubled inside quotes, line ends kept inside cells."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def calendar_rows(slots: DataFrame) -> DataFrame:
    have = set(slots.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    refs = {"belief_refs": col("belief_ref"), "proof_refs": col("proof_ref"), "status": F.lit("planned")}
    return slots.select(*[F.coalesce(refs.get(c, col(c)).cast("string"), F.lit("")).alias(c) for c in CALENDAR])


def status(gated: DataFrame) -> DataFrame:
    """One row: when, exported and rejected counts, and the reasons, of gated posts (reject_reason null: exported)."""
    reasons = gated.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.agg(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("generated_at"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("exported"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNotNull(), F.col("n"))), F.lit(0)).alias("rejected"), F.map_from_entries(F.collect_list(F.when(F.col("reject_reason").isNotNull(), F.struct("reject_reason", "n")))).alias("reasons"))


def bar(ratio: float, width: int = 20) -> str:
    return "#" * round(ratio * width) + "-" * (width - round(ratio * width))


def wrapped(text: str, indent: int = 9, width: int = 74) -> str:
    """Lines of at most `width` characters behind an indent; white space collapsed, long words whole."""
    return textwrap.indent(textwrap.fill(" ".join(text.split()), width, break_long_words=False, break_on_hyphens=False), " " * indent)


def render(total: float, band: str, dimensions: list[dict], findings: list[dict], hard_blocks: list[str] | None = None, gaps: list[dict] | None = None) -> str:
    """A text report of one subject: hard blocks, dimensions as bars, failed checks in their order, gaps, then the first three to do."""
    out = [f"TOTAL {total:g} ({band})", ""]
    if hard_blocks:
        out += ["HARD BLOCKS", *(wrapped(b, 2) for b in hard_blocks), ""]
    out += [f"{d['dimension']:<24} {bar(d['ratio'])} {d['points_earned']}/{d['points_possible']}" for d in dimensions]
    failed = [f for f in findings if not f["passed"] and not f.get("judged")]
    for title, kind in (("BLOCKERS", "blocker"), ("WARNINGS", "warn"), ("NICES", "nice")):
        rows = [f for f in failed if f["severity"] == kind]
        if rows:
            out += ["", title] + [f"  {f['check_id']}: {f['points']} points, measured {f.get('measured')}" for f in rows]
    for title, kind in (("GAPS THAT BLOCK", True), ("OTHER GAPS", False)):
        rows = [g["gap"] for g in gaps or [] if g["blocks"] == kind]
        if rows:
            out += ["", title, *(f"  {g}" for g in rows)]
    out += ["", "DO THESE THREE FIRST"] + [f"  {i}. {f['check_id']}" for i, f in enumerate(failed[:3], 1)]
    return "\n".join(out)
