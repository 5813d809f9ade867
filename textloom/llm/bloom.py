"""A blocked Bloom filter over 64-bit keys as a literal array (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is 8 words of 64 bits; a key sets one bit in each word of its block.
WORDS = 8
BITS_PER_KEY = 16
#: The filter is a literal of at most this many blocks (16 MiB, 8 million keys).  More keys raise the share of
#: false positives, which the callers' exact step removes; they never enlarge the literal.
MOST_BLOCKS = 1 << 18


def _bit(key: Column, word: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(keys: DataFrame, n_keys: int, column: str = "key") -> tuple[Column, int]:
    """(literal array of the filter's words, number of blocks) for a bigint column.

    The words are put together on one executor and reach the driver, and from there the plan, as one string.
    """
    blocks = max(1, min(MOST_BLOCKS, -(-n_keys * BITS_PER_KEY // (64 * WORDS))))
    bits = F.expr("shiftleft(1L, cast(shiftright(_g, 6 * _w) & 63 as int))")
    set_bits = keys.select(_block(F.col(column), blocks).alias("_b"), F.xxhash64(column, F.lit(1)).alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("_w"))
    words = set_bits.groupBy((F.col("_b") * WORDS + F.col("_w")).cast("long").alias("id")).agg(F.bit_or(bits).alias("v"))
    return literal_words(words, blocks * WORDS), blocks


def literal_words(words: DataFrame, size: int) -> Column:
    """Literal array<bigint> of `size` words from those (id, v) that aren't 0."""
    every = words.sparkSession.range(size).join(words, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v")))).alias("all"))
    return F.from_json(F.lit(every.select(F.to_json(F.transform("all", lambda x: x["v"]))).first()[0]), "array<bigint>")


def maybe_listed(key: Column, table: Column, blocks: int) -> Column:
    found = F.lit(True)
    for w in range(WORDS):
        found = found & (F.getbit(F.get(table, _block(key, blocks) * WORDS + w), _bit(key, w)) == 1)
    return found
