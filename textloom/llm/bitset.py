"""A filter of bounded size over 64-bit keys, for use inside Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More keys raise the share of false positives; they never enlarge the filter.
MOST_BYTES = 64 << 20
BITS_PER_KEY, HASHES = 12, 4


class KeyFilter:
    """May say yes for a key that was not given (then the caller's exact step drops it), never no for one that was."""

    def __init__(self, bits: Broadcast, size: int):
        self.bits, self.size = bits, size

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        table = self.bits.value
        hit = np.ones(len(keys), bool)
        for x in _bits(keys, self.size):
            hit &= (table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
        return hit


def _bits(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    for i in range(HASHES):
        yield ((low + np.uint64(i) * high + np.uint64(i * i)) % np.uint64(size)).astype(np.int64)


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """Filter of a bigint column of a table that is cheap to read (a written one)."""
    spark = keys.sparkSession
    n = keys.count()
    size = int(min(MOST_BYTES * 8, max(64, BITS_PER_KEY * n)))
    size += 1 - size % 2
    length = size // 8 + 1

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(length, np.uint8)
        for b in batches:
            for x in _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size):
                np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        step = 1 << 16
        at = [i for i in range(0, len(bits), step) if bits[i : i + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([bits[i : i + step].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    table = np.zeros(length, np.uint8)
    # The driver holds the filter, and one partition's copy of it at a time.
    for r in keys.select(F.col(column)).coalesce(max(1, min(8, math.ceil(n / 2_000_000)))).mapInArrow(marks, "at long, bits binary").toLocalIterator():
        block = np.frombuffer(bytes(r["bits"]), np.uint8)
        table[r["at"] : r["at"] + len(block)] |= block
    return KeyFilter(spark.sparkContext.broadcast(table), size)
