"""Shares, windows and drift of a published history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as TX
from textloom.functions.regex import round_half_up
from textloom.operators.similarity import window_pairs

#: Posts of the drift window.
WINDOW = 30


def last_posts(history: DataFrame, group: str, *order: str, window: int = WINDOW) -> DataFrame:
    """The last posts of each group by descending order; Spark keeps each task's own best before it shuffles."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window).drop("_r")


def shares(rows: DataFrame, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, share of all rows or of those with equal `within` keys; counted before the window sees it."""
    n = rows.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(within or (F.lit(0),)))))


def opening_reuse(last: DataFrame, group: str, key: Column, least: int = 3) -> DataFrame:
    """group, reused, posts, rate: posts whose opening stands three times or more in the window."""
    n = last.groupBy(group, key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    out = n.groupBy(group).agg(F.sum(F.when(F.col("_n") >= least, F.col("_n")).otherwise(0)).alias("reused"), F.sum("_n").alias("posts"))
    return out.withColumn("rate", round_half_up(F.col("reused") / F.greatest("posts", F.lit(1)), 3))


def approved_rows(posts: DataFrame) -> DataFrame:
    """reject_reason: the first rule of the export gate that a post fails, null if it may be exported.

    Columns: status, hard_blocks, approved, text, total, least_score, visibility, allowed_visibility and, if the feed is
    checked as well, feed_distribution, allowed_feed; the rules come in this order.
    """
    reason = (
        F.when(F.col("status") != "approved", F.concat(F.lit("status is "), F.col("status")))
        .when(F.col("hard_blocks") != "", F.concat(F.lit("hard blocks present: "), F.col("hard_blocks")))
        .when(~F.coalesce("approved", F.lit(False)), F.lit("no approval"))
        .when(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") == "", F.lit("empty text"))
        .when(F.col("total").isNull(), F.lit("no score"))
        .when(F.col("total") < F.col("least_score"), F.lit("score too low"))
        .when(F.col("visibility").isNotNull() & ~F.array_contains("allowed_visibility", F.col("visibility")), F.lit("visibility not allowed"))
    )
    if {"feed_distribution", "allowed_feed"} <= set(posts.columns):
        reason = reason.when(F.col("feed_distribution").isNotNull() & ~F.array_contains("allowed_feed", F.col("feed_distribution")), F.lit("feed distribution not allowed"))
    return posts.withColumn("reject_reason", reason)


@dataclass(frozen=True)
class Limits:
    """What a window may drift by."""

    pillars: float = 0.2
    archetype: float = 0.25
    sentence_words: float = 0.25
    ratio_low: float = 1.2
    ratio_high: float = 6.0
    emoji: float = 0.5
    openings: float = 0.15
    overlap: float = 0.25
    proof: float = 0.2
    least_posts: int = 3


def _mean(c: Column, unit: float) -> Column:
    """Mean over whole units, so that the sum is the same in any order of rows."""
    return F.sum(F.floor(c * F.lit(unit) + 0.5)).cast("double") / F.lit(unit) / F.count(F.lit(1))


def report(history: DataFrame, group: str, order: str, planned: dict[str, float], sample_sentence_words: float | None = None, limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """(group, check, subject, measured): in what the last posts of each group have drifted; groups with fewer than 3 posts are skipped.

    history: group, order, text, pillar, archetype, proof_refs.  planned: weight of each pillar.  The window bounds all that
    is gathered for a group.
    """
    last = last_posts(history.select(group, order, "text", "pillar", "archetype", "proof_refs"), group, order, window=window)
    style = TX.style_profile(last)
    ratio = F.when(F.col("first_person") == 0, F.col("second_person").cast("double")).otherwise(F.col("second_person") / F.col("first_person"))
    one = style.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        _mean(F.col("mean_sentence_words"), 1000.0).alias("_words"),
        round_half_up(_mean(ratio, 1e6), 2).alias("_ratio"),
        (F.sum("emoji") / F.count(F.lit(1))).alias("_emoji"),
        F.collect_list(F.coalesce("pillar", F.lit("unknown"))).alias("_pillars"),
        F.collect_list(F.coalesce("archetype", F.lit("unknown"))).alias("_archetypes"),
        F.flatten(F.collect_list(F.coalesce("proof_refs", F.expr("cast(array() as array<string>)")))).alias("_proof"),
        F.collect_list(TX.hook_key(F.col("text"))).alias("_openings"),
    ).filter(F.col("_n") >= limits.least_posts)
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    share = lambda a, x: times(F.col(a), x) / F.col("_n")
    tvd = sum((F.abs(share("_pillars", F.lit(k)) - F.lit(float(w))) for k, w in planned.items()), F.lit(0.0)) / 2
    reused = F.size(F.filter("_openings", lambda x: times(F.col("_openings"), x) >= 3)) / F.col("_n")
    found = lambda check, subject, measured, hit: F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(check).alias("check"), subject.alias("subject"), round_half_up(measured, 3).alias("measured")))
    none = F.lit("")
    rows = [
        found("pillar_distribution", none, tvd, tvd > limits.pillars),
        found("person_ratio_low", none, F.col("_ratio"), F.col("_ratio") < limits.ratio_low),
        found("person_ratio_high", none, F.col("_ratio"), F.col("_ratio") > limits.ratio_high),
        found("emoji", none, F.col("_emoji"), F.col("_emoji") > limits.emoji),
        found("hook_reuse", none, reused, reused > limits.openings),
    ]
    if sample_sentence_words is not None:
        off = F.abs(F.col("_words") - sample_sentence_words) / max(sample_sentence_words, 1.0)
        rows.append(found("mean_sentence_words", none, off, off > limits.sentence_words))
    many = lambda a, check, limit, but: F.transform(F.filter(F.array_distinct(a), lambda x: (share(a, x) > limit) & (x != but)), lambda x: found(check, x, share(a, x), F.lit(True)))
    all_ = F.concat(F.array(*rows), many("_archetypes", "archetype", limits.archetype, "unknown"), many("_proof", "proof_reuse", limits.proof, ""))
    simple = one.select(group, F.explode_outer(F.filter(all_, lambda x: x.isNotNull())).alias("_f")).filter("_f is not null").select(group, "_f.*")
    pairs = window_pairs(history.select(group, order, "text"), group, order, window=window)
    worst = pairs.groupBy(group).agg(F.max("overlap").alias("measured")).filter(F.col("measured") > limits.overlap).join(one.select(group), group, "left_semi")
    return simple.unionByName(worst.select(group, F.lit("repetition").alias("check"), F.lit("").alias("subject"), round_half_up(F.col("measured"), 3).alias("measured")))
