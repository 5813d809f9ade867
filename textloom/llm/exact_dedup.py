"""Exact dedup by content sort (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, shuffle_partitions, text_or_empty

#: Leading characters that serve as range key; the digest and the whole text follow as tie-breaks.
HEAD = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters (Spark's range exchange) deal the rows out by the head of the text,
    its digest and a salt; the external sort inside each range then places equal texts side
    by side, and the window compares each text in full with its neighbours.  The sample that
    the splitters need holds heads and digests, never whole texts.

    A text with more rows than a quarter of a partition's share is salted by row, whatever the identifiers, into as many
    pieces as that takes.  There are at most 4P such texts and 8P pieces for P shuffle
    partitions, whatever the input, so the piece table is broadcast within a known bound.

    keep: "smallest" or "largest" identifier of a group stays.  Null text counts as empty.
    A null identifier only stays if its group has no other (keep_id is then null).  Of repeated rows
    (same text, same identifier) exactly one is marked as kept.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ids = F.max if keep == "largest" else F.min
    counts = base.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.select(F.lit(1)).count()
    share = max(64, -(-total // (4 * parts)))
    hot = cut(counts.filter(F.col("_n") > share).select(F.col("_h").alias("_hh"), F.ceil(F.col("_n") / share).cast("int").alias("_pieces")))
    salted = base.join(F.broadcast(hot), base["_h"] == hot["_hh"], "left").select(
        "doc_id", "_t", "_h", F.coalesce("_pieces", F.lit(1)).alias("_pieces"), F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_pieces")).cast("int"), F.lit(0)).alias("_salt")
    )
    head = F.substring("_t", 1, HEAD)
    ranged = salted.withColumn("_p", head).repartitionByRange(parts, "_p", "_h", "_salt")
    same = Window.partitionBy("_p", "_h", "_salt", "_t")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    local = (
        ranged.withColumn("_rn", F.row_number().over(same.orderBy(order)))
        .withColumn("_keep", ids("doc_id").over(same))
        .withColumn("_size", F.count(F.lit(1)).over(same))
        .select("doc_id", "_h", "_salt", "_pieces", "_keep", "_size", "_rn", F.sha2("_t", 256).alias("text_sha256"))
    )
    # Written once: the pieces of a salted text meet again as one row for each, at most 8P in all.
    local = cut(local)
    last = F.max_by("_salt", F.struct(F.col("_keep").isNotNull(), "_keep", "_salt")) if keep == "largest" else F.min_by("_salt", F.struct(F.col("_keep").isNull(), "_keep", "_salt"))
    merged = local.filter("_rn = 1 and _pieces > 1").groupBy(F.col("_h").alias("_hh"), F.col("text_sha256").alias("_sha")).agg(ids("_keep").alias("_gkeep"), F.sum("_size").alias("_gsize"), last.alias("_gsalt"))
    out = local.join(F.broadcast(merged), (F.col("_h") == F.col("_hh")) & (F.col("text_sha256") == F.col("_sha")), "left")
    return out.select(
        "doc_id",
        F.when(F.col("_gsize").isNotNull(), F.col("_gkeep")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_gsize", "_size").cast("long").alias("group_size"),
        ((F.col("_rn") == 1) & (F.col("_gsalt").isNull() | (F.col("_gsalt") == F.col("_salt")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, **kw) -> DataFrame:
    """The documents that stay, with the columns doc_id and text_sha256; of an empty table none.  Nulls, ties and repeated rows as in exact_dedup."""
    return exact_dedup(docs, **kw).filter("kept").select("doc_id", "text_sha256")
