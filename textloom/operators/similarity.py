"""Exact n-gram overlap and distribution distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.regex import let, round_half_up
from textloom.functions.text import grams, whole, words


def gram_rows(docs: DataFrame, keys: list[str], text_col: str = "text", n: int = 4) -> DataFrame:
    """keys, gram, size: the distinct runs of n words of each text, and how many it has."""
    base = docs.select(*keys, words(F.lower(whole(F.col(text_col)))).alias("_w")).select(*keys, grams("_w", n).alias("_g"))
    # Not explode(): Spark would add a filter on the array's size and push it, with all that makes
    # the array, below; each run would then cut the words anew.
    return base.select(*keys, F.size("_g").alias("size"), F.explode_outer("_g").alias("gram")).filter("gram is not null")


def hashed_grams(text: Column, n: int = 4) -> Column:
    """array<bigint>: a 64-bit hash of each distinct run of n words of a text."""
    w = words(F.lower(whole(text)))
    runs = lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return let(w, runs)


def hashed_rows(docs: DataFrame, key: str, size: str, text_col: str = "text", n: int = 4) -> DataFrame:
    """(key, size, gram): a row for each hash of hashed_grams."""
    base = docs.select(key, hashed_grams(F.col(text_col), n).alias("_g"))
    return base.select(key, F.size("_g").alias(size), F.explode_outer("_g").alias("gram")).filter("gram is not null")


def worst_overlap(posts: DataFrame, history: DataFrame, post_id: str, history_id: str, n: int = 4, most_broadcast: int = 2_000_000) -> DataFrame:
    """(post_id, overlap, nearest): the greatest 4-gram overlap of each post with any text of the history; ties by the least history_id.

    Runs are joined as 64-bit hashes.  The posts' runs are broadcast only if their counted rows stay under the bound; the counts of
    shared runs are combined before they are shuffled.  Posts that share nothing have overlap 0.
    """
    left = hashed_rows(posts, post_id, "_na", n=n)
    right = hashed_rows(history, history_id, "_nb", n=n)
    if left.count() <= most_broadcast:
        left = F.broadcast(left)
    shared = right.join(left, "gram").groupBy(post_id, "_na", history_id, "_nb").agg(F.count(F.lit(1)).alias("_s"))
    scored = shared.select(post_id, history_id, (F.col("_s") / (F.col("_na") + F.col("_nb") - F.col("_s"))).alias("_o"))
    return posts.select(post_id).join(_best(scored, post_id, history_id), post_id, "left").select(post_id, round_half_up(F.coalesce("_o", F.lit(0.0)), 3).alias("overlap"), "nearest")


def _best(scored: DataFrame, post_id: str, history_id: str) -> DataFrame:
    return scored.groupBy(post_id).agg(F.max("_o").alias("_o"), F.min_by(history_id, F.struct(-F.col("_o"), F.col(history_id))).alias("nearest"))


def overlaps_of_least(posts: DataFrame, history: DataFrame, post_id: str, history_id: str, least: float = 0.25, n: int = 4, most_broadcast: int = 2_000_000) -> DataFrame:
    """(post_id, overlap, nearest) of the posts whose 4-gram overlap with some text of the history is `least` or more; the greatest, ties by the least history_id.

    A text of g runs needs ceil(least * g) of them in common, so in any one order of all runs it shares one of its first
    g - ceil(least * g) + 1 with each partner.  The order is by rarity in the history: runs that the history lacks come first
    and are never joined, frequent ones come last and hardly ever are.  Texts whose numbers of runs differ by more
    than `least` allows are not compared; a post with too few runs of the history is out before any pair is made.  What is left is
    counted on the runs themselves, as strings.  Posts and texts without a run of n words have no overlap.
    """
    need = lambda size: F.ceil(F.lit(least) * size - F.lit(1e-9)).cast("int")
    held = history.select(history_id, F.col("text").alias("_ht"), hashed_grams(F.col("text"), n).alias("_g")).filter(F.size("_g") > 0)
    rarity = held.select(F.explode("_g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    sizes = held.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_g")).alias("lo"), F.max(F.size("_g")).alias("hi"), F.sum(F.size("_g")).alias("grams")).first()
    if not sizes["n"]:
        return posts.select(post_id, F.lit(None).cast("double").alias("overlap")).join(history.select(F.col(history_id).alias("nearest")).limit(0))
    small_ = (lambda df: F.broadcast(df)) if sizes["grams"] <= most_broadcast else (lambda df: df)
    gathered = lambda rows, *keys: rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_df", "gram"))).alias("_known"))
    prefix = lambda known, size: F.slice(known, 1, F.size(known) - need(size) + 1)
    # Of the posts: only those whose number of runs fits any text's, and of these the runs that the history has.
    fit = posts.select(post_id, hashed_grams(F.col("text"), n).alias("_g")).withColumn("_n", F.size("_g")).filter((F.col("_n") >= need(F.lit(sizes["lo"]))) & (F.col("_n") * least <= sizes["hi"] + 1e-9))
    mine = gathered(fit.select(post_id, "_n", F.explode_outer("_g").alias("gram")).join(small_(rarity), "gram"), post_id, "_n").filter(F.size("_known") >= need(F.col("_n")))
    left = mine.select(post_id, "_n", F.explode(prefix(F.col("_known"), F.col("_n"))["gram"]).alias("gram"))
    theirs = gathered(held.select(history_id, F.size("_g").alias("_m"), F.explode("_g").alias("gram")).join(small_(rarity), "gram"), history_id, "_m")
    right = theirs.select(history_id, "_m", F.explode(prefix(F.col("_known"), F.col("_m"))["gram"]).alias("gram"))
    fits = (F.col("_n") * least <= F.col("_m") + 1e-9) & (F.col("_m") * least <= F.col("_n") + 1e-9)
    pairs = left.join(small_(right), "gram").filter(fits).select(post_id, history_id).distinct()
    runs = lambda df, key, name: df.select(key, words(F.lower(whole(F.col("text")))).alias("_w")).select(key, grams("_w", n).alias(name))
    # The texts of candidates are read again; there are few.
    both = runs(posts.join(pairs.select(post_id).distinct(), post_id, "left_semi"), post_id, "_a").join(pairs, post_id).join(runs(history.select(history_id, "text"), history_id, "_b"), history_id)
    shared = F.size(F.array_intersect("_a", "_b"))
    scored = both.select(post_id, history_id, (shared / (F.size("_a") + F.size("_b") - shared)).alias("_o")).filter(F.col("_o") >= least)
    return _best(scored, post_id, history_id).select(post_id, round_half_up(F.col("_o"), 3).alias("overlap"), "nearest")


def window_pairs(posts: DataFrame, group: str, order: str, window: int = 30, n: int = 4) -> DataFrame:
    """(group, i, j, overlap) of the pairs that share a run among the last `window` posts of each group, i before j.

    The window bounds the pairs of a group; it is the rule's own, not a limit of the search.
    """
    last = posts.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("_r") <= window)
    rows = gram_rows(last, [group, order], n=n)
    a = rows.select(F.col(group), F.col(order).alias("i"), F.col("size").alias("_na"), "gram")
    b = rows.select(F.col(group), F.col(order).alias("j"), F.col("size").alias("_nb"), "gram")
    shared = a.join(b, [group, "gram"]).filter("i < j").groupBy(group, "i", "j", "_na", "_nb").agg(F.count(F.lit(1)).alias("_s"))
    return shared.select(group, "i", "j", (F.col("_s") / (F.col("_na") + F.col("_nb") - F.col("_s"))).alias("overlap"))


def total_variation(planned: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row tvd: half the summed differences of two share tables (key, share) over all keys."""
    a, b = planned.select(F.col(key).alias("_k"), F.col("share").alias("_p")), actual.select(F.col(key).alias("_k"), F.col("share").alias("_q"))
    both = a.join(b, "_k", "full")
    return both.agg((F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2).alias("tvd"))
