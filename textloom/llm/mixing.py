"""Mixing sources to target weights (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, shuffle_partitions, small

TOKEN = r"[^\x20\x09-\x0D]+"
#: Equal rows that are made again together.
TOGETHER = 10_000


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Sources, by code point and null last, get the weights in turn and share `share` times all
    sizes.  A target stops at most_repeats times its source's size; what is above goes to the
    others by weight.  Each row gets a hash-random key; inside a source the rows are sorted by
    it in range buckets, prefix sums run inside the buckets and over the bucket totals, and the
    source is cut at its exact budget after as many whole epochs as fit.  The row at the cut is
    taken in part.  Rows of one source that agree in identifier and size are one row with their number until then, so
    neither a repeated row nor many rows without an identifier fill a bucket.

    Null text has size 0 and is taken 0 times.  Null source is a source of its own.  Repeated rows each count; ties
    in the key are ordered by identifier and size.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    source = F.col(source_col)
    each = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"),
            F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("_s"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_r"),
        )
    )
    slim = cut(each.groupBy("doc_id", "size", "_s", "_r").agg(F.count(F.lit(1)).alias("_n")))
    # One row per source from here on.
    totals = slim.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    everything, by_ratio = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_ratio", "_s").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    ordered = totals.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_s")) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = ordered.withColumn("_cap", F.col("source_size") * most_repeats).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    level = (
        capped.withColumn("_left", F.sum("source_size").over(everything) * F.lit(share) - before("_cap"))
        .withColumn("_weight", F.sum("_w").over(everything) - before("_w"))
        # The level at which the caps end is the largest of these, over the sources in the order in which they fill up.
        .withColumn("_level", F.max_by(F.struct("_left", "_weight"), F.col("_left") / F.col("_weight")).over(everything))
    )
    rise = F.col("_level._left") * F.col("_w") / F.col("_level._weight")
    target = F.when(F.col("_cap") <= rise, F.col("_cap").cast("double")).otherwise(rise)
    rows_each = F.greatest(F.lit(64), F.ceil(F.sum("_rows").over(everything) / F.lit(4 * parts)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = (
        level.withColumn("target", target)
        .withColumn("_epochs", epochs)
        .select("_s", "source_size", "target", "_epochs", (budget - F.col("_epochs") * F.col("source_size")).alias("_rest"), F.ceil(F.col("_rows") / rows_each).alias("_buckets"))
    )
    plan = cut(plan)
    n_sources = plan.count()
    # The bucket is monotone in the key: the key's first 32 bits, scaled.
    keyed = slim.join(small(plan, n_sources, 20_000), "_s").withColumn("_b", F.floor(F.conv(F.substring("_r", 1, 8), 16, 10).cast("long") * F.col("_buckets") / F.lit(2.0**32)))
    sums = keyed.groupBy("_s", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_sum"))
    offsets = cut(sums.select("_s", "_b", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_s", "_b").orderBy("_r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_offset") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0))
    # At most 4P buckets and one for each source.
    placed = keyed.join(small(offsets, n_sources + 4 * parts, 100_000), ["_s", "_b"]).withColumn("_left", F.greatest(F.lit(0), F.col("_rest") - prefix))
    # Of _n equal rows the first _whole are taken whole once more, the next one in part, the others not.
    whole = F.when(F.col("size") > 0, F.least(F.col("_n"), F.floor(F.col("_left") / F.col("size")))).otherwise(F.col("_n"))
    base = F.col("_epochs") * F.col("size")
    takes = F.array(
        F.struct((base + F.col("size")).cast("long").alias("taken"), F.col("_whole").alias("m")),
        F.struct((base + F.least(F.col("size"), F.col("_left") - F.col("_whole") * F.col("size"))).cast("long").alias("taken"), F.when(F.col("_whole") < F.col("_n"), 1).otherwise(0).cast("long").alias("m")),
        F.struct(base.cast("long").alias("taken"), (F.col("_n") - F.col("_whole") - 1).alias("m")),
    )
    taken = placed.withColumn("_whole", whole.cast("long")).select("doc_id", "size", "source_size", "target", F.explode(F.filter(takes, lambda x: x["m"] > 0)).alias("_t"))
    lots = taken.select("doc_id", "size", "source_size", "target", "_t.taken", F.col("_t.m").alias("_m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t.m") - 1, F.lit(TOGETHER).cast("long"))).alias("_from"))
    # Lots of equal rows are dealt out before they are rows again.
    dealt = lots.select("doc_id", "size", "source_size", "target", "taken", F.least(F.lit(TOGETHER), F.col("_m") - F.col("_from")).cast("int").alias("_m")).repartition(parts)
    return dealt.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.array_repeat(F.lit(0), F.col("_m")))).drop("col")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """docs as often as the mix takes them: once for each whole epoch, and once more if at least half of the row lies before its source's cut.

    All columns unchanged.  Rows that repeat with their identifier, text and source share their takes evenly, rounded up.
    A text without words has size 0, so it is never taken; rows with null source are a source of their own.  An empty table gives no rows.
    """
    tag = F.xxhash64(id_col, text_col, source_col)
    plan = mix(docs.select(tag.alias("_tag"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), id_col="_tag", **kw)
    times = F.floor(F.col("taken") / F.col("size")) + F.when((F.col("taken") % F.col("size")) * 2 >= F.col("size"), 1).otherwise(0)
    each = cut(plan.filter("taken > 0").select(F.col("doc_id").alias("_tag"), times.cast("int").alias("_n")).filter("_n > 0").groupBy("_tag").agg(F.ceil(F.avg("_n")).cast("int").alias("_n")))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), tag.alias("_tag"))
    # No broadcast hint: the same join, a shuffle, at every size.
    return packed.join(each, "_tag").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*")
