"""Sharding by sampled splitters (DataFrame operations only)."""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, literal_table, shuffle_partitions, text_or_empty

#: Fine ranges for each shard; their splitters come from this many sampled keys for each range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 32, 16
#: A group of equal texts above this part of a shard is placed on its own.
HEAVY = 64


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds <= key, as a binary search spelled out in conditions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    The key is a digest of the text, so equal texts lie side by side.  A size-weighted sample of
    keys (RANGES_PER_SHARD * SAMPLES_PER_RANGE keys for each shard are expected) gives quantile boundaries of fine ranges;
    the sizes of all rows are then summed exactly for each range.  A group of equal texts above
    1/64 of a shard leaves its range; one above a whole shard is subdivided by a hash
    of its rows' places in the table that is written first.  Those pieces are dealt out largest first, and the ranges, in key order, fill each
    shard up to an equal size.  So equal texts share a shard wherever the group is no larger
    than one, and shards differ by about one fine range.  Slots number the rows of a shard
    from 0: rows are numbered inside cells of bounded row count, whose offsets the driver knows.

    The driver sees the sample and one row for each cell; both depend on shards and partitions, not on the rows.
    Null text has size 1 and crc 0.  Repeated rows get slots of their own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = text_or_empty(F.col(text_col))
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_k"),
            # Rows are told apart by their place, so that rows with one identifier and one text can be dealt out, too.
            F.xxhash64(F.monotonically_increasing_id(), F.lit(12)).alias("_u"),
        )
    )
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1.0, total / shards)
    wanted = shards * RANGES_PER_SHARD * SAMPLES_PER_RANGE
    groups = slim.groupBy("_k").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    # At most 64 groups for each shard are that large.
    heavy = {r["_k"]: r["_b"] for r in groups.filter(F.col("_b") > share / HEAVY).collect()}
    sample = sorted(
        r["_k"] for r in groups.filter(F.col("_b") <= share / HEAVY).filter(F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(1 << 30)) < F.col("_b") * wanted * float(1 << 30) / max(1, total)).select("_k").collect()
    )
    n_ranges = shards * RANGES_PER_SHARD
    bounds = sorted({sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)}) if sample else []
    heavy_ids = {k: len(bounds) + 1 + i for i, k in enumerate(sorted(heavy))}
    # Pieces of an overfull group: an eighth of a shard each.
    split = {k: -(-b * 8 // int(share)) if b > share else 1 for k, b in heavy.items()}
    cells = slim.withColumn("_cell", _range_of(F.col("_k"), bounds)).withColumn("_split", F.lit(1))
    if heavy:
        table = literal_table(spark, [(k, heavy_ids[k], split[k]) for k in heavy], "_hk long, _hc int, _hs int")
        cells = cells.join(F.broadcast(table), F.col("_k") == F.col("_hk"), "left").withColumn("_cell", F.coalesce("_hc", "_cell")).withColumn("_split", F.coalesce("_hs", "_split")).drop("_hk", "_hc", "_hs")
    cells = cells.withColumn("_piece", F.pmod("_u", F.col("_split")).cast("int"))
    measured = [tuple(r) for r in cells.groupBy("_cell", "_piece").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    placed = _place(measured, shards, len(bounds) + 1)
    # Cells above a task's share of the rows are numbered in parts.
    most = max(64, -(-rows // (4 * parts)))
    plan = literal_table(spark, [(c, p, placed[c, p], -(-n // most)) for c, p, _, n in measured] or [(-1, 0, 0, 1)], "_cell int, _piece int, shard int, _parts int")
    numbered = cells.join(F.broadcast(plan), ["_cell", "_piece"]).withColumn("_part", F.pmod(F.shiftright("_u", 20), F.col("_parts")).cast("int"))
    starts, counts = {}, [tuple(r) for r in numbered.groupBy("shard", "_cell", "_piece", "_part").count().collect()]
    offsets = []
    for s, c, p, q, n in sorted(counts):
        offsets.append((c, p, q, starts.get(s, 0)))
        starts[s] = starts.get(s, 0) + n
    offsets_df = literal_table(spark, offsets or [(-1, 0, 0, 0)], "_cell int, _piece int, _part int, _offset long")
    order = Window.partitionBy("_cell", "_piece", "_part").orderBy("_k", "doc_id", "size", "text_crc32")
    out = numbered.join(F.broadcast(offsets_df), ["_cell", "_piece", "_part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.row_number().over(order) - 1 + F.col("_offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _place(measured: list[tuple[int, int, int, int]], shards: int, n_ranges: int) -> dict[tuple[int, int], int]:
    """Shard of each (cell, piece): heavy groups largest first to the emptiest shard, then the ranges in key order up to equal sizes."""
    total = sum(x[2] for x in measured)
    load, out = [(0, s) for s in range(shards)], {}
    for c, p, size, _ in sorted((x for x in measured if x[0] >= n_ranges), key=lambda x: (-x[2], x[:2])):
        have, s = heapq.heappop(load)
        out[c, p] = s
        heapq.heappush(load, (have + size, s))
    filled = [0] * shards
    for have, s in load:
        filled[s] = have
    ends, at = [], 0.0
    room = [max(0.0, total / shards - x) for x in filled]
    scale = sum(x[2] for x in measured if x[0] < n_ranges) / max(1e-9, sum(room))
    for r in room:
        at += r * scale
        ends.append(at)
    done = 0
    for c, p, size, _ in sorted(x for x in measured if x[0] < n_ranges):
        out[c, p] = min(shards - 1, bisect_right(ends, done + size / 2))
        done += size
    return out
