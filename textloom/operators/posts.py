"""Measures and checks of posts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import count, round_half_up
from textloom.operators import lexicon as L
from textloom.operators.sourcing import nearest_claim, unsourced


#: A phrase that gives a machine away as the author, and the places of such phrases in the dictionary.
SELF = re.compile(r"as an ai|ai.generated|language model")
OWN_VOICE = [i for i, (kind, _, p) in enumerate(L.DICTIONARY) if kind == "hard" and SELF.search(p)]


@dataclass(frozen=True)
class Voice:
    """Targets of a voice; the defaults are those of an unset profile."""

    mean_sentence_words: float = 14
    least_variation: float = 0.35
    longest_paragraph: int = 180
    least_hashtags: int = 3
    most_hashtags: int = 5
    most_emoji: int = 0
    ctas: int = 1
    most_overlap: float = 0.25


def measure(posts: DataFrame, known: DataFrame, overlap: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row for each post, with the columns keep unchanged; overlap: (id, overlap), absent without history."""
    text = F.col(text_col)
    # Sentences and tokens are cut once; what is read from them is computed once, too.
    cut = posts.select(id_col, *keep, text.alias("_t"), T.sentences(text).alias("_sentences"), T.tokens(text).alias("_tokens"))
    t = F.col("_t")
    base = cut.select(
        id_col,
        *keep,
        "_t",
        T.lengths_of(F.col("_sentences")).alias("_l"),
        F.size(T.imperatives_of(F.col("_sentences"))).alias("imperatives"),
        T.pronouns(F.col("_tokens"), T.FIRST).alias("_first"),
        T.pronouns(F.col("_tokens"), T.SECOND).alias("_second"),
        L.cta_positions(t).alias("_c"),
        T.first_line(t).alias("_f"),
        L.matcher()(F.lower(T.whole(t))).alias("_ids"),
    )
    # No word reaches across the end of a sentence.
    ratio = T.second_to_first(F.col("_second"), F.col("_first"), T.total(F.col("_l")))
    wide = base.select(
        id_col,
        *keep,
        F.length("_f").alias("hook_chars"),
        count(F.col("_f"), T.WORD).alias("hook_words"),
        F.size(L.hook_families(t)).alias("hook_families"),
        round_half_up(T.mean(F.col("_l")), 2).alias("mean_sentence_words"),
        round_half_up(T.variation(F.col("_l")), 3).alias("variation"),
        F.coalesce(F.array_max(F.transform(T.paragraphs(t), F.length)), F.lit(0)).alias("longest_paragraph"),
        "imperatives",
        L.present("hard", F.col("_ids")).alias("hard_bans"),
        L.present("soft", F.col("_ids")).alias("soft_tells"),
        round_half_up(ratio, 2).alias("second_to_first"),
        F.size("_c").alias("ctas"),
        round_half_up(F.when(F.size("_c") > 0, F.array_min("_c") / F.greatest(F.length(T.whole(t)), F.lit(1))).otherwise(F.lit(1.0)), 4).alias("cta_ratio"),
        T.hashtag_count(t).alias("hashtags"),
        T.emoji_count(t).alias("emoji"),
        L.has_markdown(t).alias("markdown"),
        L.present("authority", F.col("_ids")).alias("authority"),
        F.exists("_ids", lambda i: i.isin(OWN_VOICE)).alias("self_reference"),
    )
    missing = unsourced(posts, known, id_col, text_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("_m"))
    out = wide.join(missing, id_col, "left").withColumn("needs_source", F.coalesce("_m", F.lit(0))).drop("_m")
    return out.withColumn("overlap", F.lit(0.0)) if overlap is None else out.join(overlap.select(id_col, "overlap"), id_col, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def checks(v: Voice = Voice()) -> tuple[dict[str, Column], dict[str, Column]]:
    """Pass and measured Columns of the computed checks."""
    c = F.col
    passes = {
        "h1": (c("hook_chars") <= 130) & (c("hook_words") <= 18),
        "h2": c("hook_families") > 0,
        "s2": c("needs_source") == 0,
        "st1": c("mean_sentence_words") <= v.mean_sentence_words + 4,
        "st2": c("variation") >= v.least_variation,
        "st3": c("longest_paragraph") <= v.longest_paragraph,
        "vd1": c("imperatives") > 0,
        "vd3": c("overlap") < v.most_overlap,
        "vm1": c("hard_bans") == 0,
        "vm2": c("soft_tells") <= 1,
        "vm3": c("second_to_first").between(1.2, 6.0),
        "ct1": c("ctas") == v.ctas,
        "ct2": c("cta_ratio") > 0.6,
        "ff1": c("hashtags").between(v.least_hashtags, v.most_hashtags),
        "ff2": c("emoji") <= v.most_emoji,
        "ff3": ~c("markdown"),
    }
    fields = {"h1": "hook_chars", "h2": "hook_families", "s2": "needs_source", "st3": "longest_paragraph", "vd1": "imperatives", "vm1": "hard_bans", "vm2": "soft_tells", "ct1": "ctas", "ff1": "hashtags", "ff2": "emoji"}
    return passes, {k: c(x) for k, x in fields.items()}


def hard_blocks(needs_source: Column, self_reference: Column, published_by_hand: Column, unapproved: Column, unpermitted: Column | None = None) -> Column:
    """Comma-joined hard blocks: hb1 unsourced number, hb2 client without permission, hb3 self-reference, hb5 published in a mode that isn't auto, hb6 queued or published without approval."""
    parts = [(needs_source, "hb1"), (unpermitted if unpermitted is not None else F.lit(False), "hb2"), (self_reference, "hb3"), (published_by_hand, "hb5"), (unapproved, "hb6")]
    return F.concat_ws(",", *[F.when(x, F.lit(n)) for x, n in parts])


@dataclass(frozen=True)
class Publishing:
    """A persona's publishing settings; the defaults are those of an unset profile."""

    mode: str = "draft"
    approval_required: bool = True
    require_permission: bool = False


def blocked(posts: DataFrame, known: DataFrame, registry: DataFrame, publishing: Publishing = Publishing(), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, needs_source, hard_blocks) of post records.

    posts: id, text, status, approvals (array of structs with decision), gate_bypassed.  registry: id, claim, permission; an
    unsourced number whose nearest entry waits for permission or was refused it is hb2.  Null lists count as empty.
    """
    open_ = unsourced(posts, known, id_col, text_col)
    near = nearest_claim(open_, registry, "id", "claim").join(registry.select(F.col("id").alias("entry"), "permission"), "entry", "left")
    counts = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("permission").isin("requested", "denied")).alias("_refused"))
    flags = posts.select(id_col, "status", "approvals", "gate_bypassed", F.exists(L.matcher()(F.lower(T.whole(F.col(text_col)))), lambda i: i.isin(OWN_VOICE)).alias("_self"))
    approved = F.exists(F.coalesce("approvals", F.expr("array()")), lambda a: a["decision"].isin("approved", "edited"))
    late = F.col("status").isin("queued", "published") & ~F.coalesce(approved, F.lit(False)) & ~F.coalesce("gate_bypassed", F.lit(False))
    needs = F.coalesce("_n", F.lit(0))
    blocks = hard_blocks(
        needs > 0,
        F.col("_self"),
        F.lit(publishing.mode != "auto") & (F.col("status") == "published"),
        F.lit(publishing.approval_required) & late,
        F.lit(publishing.require_permission) & (F.coalesce("_refused", F.lit(0)) > 0),
    )
    return flags.join(counts, id_col, "left").select(id_col, needs.alias("needs_source"), blocks.alias("hard_blocks"))
