"""Phrase collocations by hashed buckets and Apriori pruning, one pass for each phrase length.

While a pass counts phrases of k words exactly, it also counts the buckets that phrases of k + 1 words
hash to; the next pass looks only at phrases whose bucket, and whose two parts of k words, can be frequent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bitset import KeyFilter, key_filter
from textloom.llm.common import cut, shuffle_partitions, small
from textloom.llm.tokens import mix, powers, rolled

# What ends a piece of a text, and what lies between words.
BREAKS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
_BREAK, _GAP = 10, 32
_FOLD = bytes(_BREAK if chr(b) in BREAKS else _GAP if chr(b) in GAPS else ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
_MANY, _SEPARATOR = re.compile(rb" {2,}"), re.compile(rb"[ \n]")
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
#: Buckets go by blocks of this size; a bucket's count stops at 255, so `least` is at most that much in the buckets.
BLOCK = 1 << 16
#: One bucket for so many bytes of text, so that the average bucket holds about 30 phrases; between a block and 2^27
#: (a bitmap of 16 MiB).  More text makes buckets fuller, which costs exact counting and not results.
BYTES_PER_BUCKET, MOST_BUCKETS = 180, 1 << 27
#: Counted phrases that a task holds before it hands them on.
MOST_HELD = 1 << 19
ROWS = "lang string, phrase string, n long, block int, counts binary"


def normalised(texts: list[bytes]) -> bytes:
    """Texts with A-Z lower-cased, words apart by single spaces and pieces by line breaks."""
    data = _MANY.sub(b" ", b"\n".join(texts).translate(_FOLD))
    return data.replace(b" \n", b"\n").replace(b"\n ", b"\n")


def chunks(data: bytes, longest: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(bytes, own): parts of about `size` bytes of normalised text, in whose first `own` bytes phrases may begin; behind them follow the next words, so that none is cut."""
    at = 0
    while at < len(data):
        stop = len(data)
        if at + size < len(data) and (gap := _SEPARATOR.search(data, at + size)):
            stop = gap.end()
        ahead = stop
        for _ in range(longest):
            gap = _SEPARATOR.search(data, ahead)
            ahead = gap.end() if gap else len(data)
        yield data[at:ahead], stop - at
        at = stop


class Chunk:
    """Words of a chunk: where they begin and end, their hashes, the number of their piece, and how many may begin a phrase."""

    def __init__(self, data: bytes, own: int, lang: str):
        self.data, self.raw = data, np.frombuffer(data, np.uint8)
        word = (self.raw != _GAP) & (self.raw != _BREAK)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * down[: len(self.raw)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * up[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.piece = np.cumsum(self.raw == _BREAK)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.own = int(np.searchsorted(self.starts, own))
        self.salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))

    def keys(self, k: int) -> np.ndarray:
        """A hash of language and phrase for each run of k words."""
        return mix(rolled(self.hashes, k) ^ self.salt)

    def whole(self, k: int) -> np.ndarray:
        """Whether each run of k words lies in one piece."""
        if len(self.starts) < k:
            return np.zeros(0, bool)
        return self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of k words that begin at the given words, as strings."""
        begins, sizes = self.starts[at], self.ends[at + k - 1] - self.starts[at]
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        body = self.raw[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, normalised text) for the texts of a batch, by language; a null language is und, a null text empty."""
    langs = batch.column(0).fill_null("und").dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column(1).filter(pc.equal(langs.indices, i)).fill_null("")
        group, size = [], 0
        for text in texts:
            group.append(text.as_buffer().to_pybytes())
            size += len(group[-1])
            if size > CHUNK:
                yield lang, normalised(group)
                group, size = [], 0
        yield lang, normalised(group)


class _Counts:
    """Phrases and their counts, kept until there are too many."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, lang: str, phrases: pa.Array) -> None:
        found = phrases.value_counts()
        self.tables.append(pa.table({"lang": pa.array([lang] * len(found), pa.large_string()), "phrase": found.field(0), "n": found.field(1)}))
        self.rows += len(found)

    def merged(self) -> pa.Table | None:
        if not self.tables:
            return None
        every = pa.concat_tables(self.tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
        self.tables, self.rows = [every], len(every)
        return every

    def take(self) -> pa.Table | None:
        every, self.tables, self.rows = self.merged(), [], 0
        return every


def _phrase_rows(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
    if table is not None:
        for b in table.to_batches(max_chunksize=10_000):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2).cast(pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["lang", "phrase", "n", "block", "counts"])


def _block_rows(buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of buckets by block: all of a block, or places and counts where that is shorter."""
    for i in range(0, len(buckets), BLOCK):
        block = buckets[i : i + BLOCK]
        at = np.flatnonzero(block)
        if len(at):
            body = b"d" + block.tobytes() if 3 * len(at) > len(block) else b"s" + at.astype(np.uint16).tobytes() + block[at].tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([i // BLOCK], pa.int32()), pa.array([body], pa.binary())], names=["lang", "phrase", "n", "block", "counts"])


def _raise(buckets: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Add counts to different buckets; they stop at 255."""
    buckets[at] = np.minimum(buckets[at].astype(np.int64) + by, 255)


def _survivors(chunk: Chunk, k: int, bits: np.ndarray | None, parts: KeyFilter | None) -> np.ndarray:
    """Whether each run of k words can be frequent: in one piece, its bucket full, both runs of k - 1 words frequent."""
    alive = chunk.whole(k)
    if k > 1 and alive.any():
        at = np.flatnonzero(alive)
        keys = chunk.keys(k)[at]
        place = (keys % np.uint64(8 * len(bits))).astype(np.int64)
        full = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        at = at[full]
        shorter = parts(chunk.keys(k - 1))
        at = at[shorter[at] & shorter[at + 1]]
        alive = np.zeros(len(alive), bool)
        alive[at] = True
    return alive


def _pass(texts: DataFrame, k: int, longest: int, buckets: int, bitmap: Broadcast | None, parts: KeyFilter | None) -> DataFrame:
    """Rows of ROWS: counts of the phrases of k words that can be frequent, and of the buckets of those of k + 1 words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        held, table = _Counts(), np.zeros(buckets if k < longest else 0, np.uint8)
        for batch in batches:
            for lang, data in _grouped(batch):
                for part, own in chunks(data, longest):
                    chunk = Chunk(part, own, lang)
                    alive = _survivors(chunk, k, bits, parts)
                    at = np.flatnonzero(alive[: chunk.own])
                    if len(at):
                        held.add(lang, chunk.phrases(at, k))
                    if k < longest and len(alive) > 1:
                        longer = np.flatnonzero((chunk.whole(k + 1) & alive[:-1] & alive[1:])[: chunk.own])
                        _raise(table, *np.unique((chunk.keys(k + 1)[longer] % np.uint64(buckets)).astype(np.int64), return_counts=True))
                    if held.rows > MOST_HELD and len(held.merged()) > MOST_HELD // 2:
                        yield from _phrase_rows(held.take())
        yield from _phrase_rows(held.take())
        yield from _block_rows(table)

    return texts.mapInArrow(count, ROWS)


def _bitmap(rows: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the buckets that hold at least `least` phrases in all tasks together: blocks meet, are added up one row at a time, and reach the driver as bits."""
    limit = min(least, 255)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                body = np.frombuffer(counts.as_buffer(), np.uint8)
                total = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                if body[0] == ord("d"):
                    _raise(total, np.arange(len(body) - 1), body[1:].astype(np.int64))
                else:
                    n = (len(body) - 1) // 3
                    _raise(total, np.frombuffer(body[1 : 1 + 2 * n].tobytes(), np.uint16).astype(np.int64), body[1 + 2 * n :].astype(np.int64))
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= limit, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    table = np.zeros(max(buckets, BLOCK) // 8, np.uint8)
    blocks = rows.filter("block is not null").select("block", "counts").repartition(shuffle_partitions(rows.sparkSession), "block")
    for r in blocks.mapInArrow(add, "block int, bits binary").toLocalIterator():
        table[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table[: buckets // 8]


def _keys(frequent: DataFrame, k: int) -> DataFrame:
    """(key): the hash that a pass gives each phrase."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Phrases apart by line breaks are pieces of k words each.
        for lang, data in (x for b in batches for x in _grouped(b)):
            chunk = Chunk(data, len(data), lang)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.keys(k)[chunk.whole(k)].view(np.int64))], names=["key"])

    return frequent.select("lang", "phrase").mapInArrow(hashed, "key long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f), (lang, n)): phrases of 1 to `longest` words that occur at least `least` times in a language, and its words.

    One pass over the texts for each length.  Each task adds its phrases up before they are shuffled; they are counted as strings,
    so hashes decide only what is not worth counting.  The driver sees a bitmap of buckets and a filter of
    frequent shorter phrases, both of bounded size, which every executor gets.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(BLOCK, 1 << (size // BYTES_PER_BUCKET).bit_length()))
    found, totals, bitmap, parts = [], None, None, None
    for k in range(1, longest + 1):
        rows = cut(_pass(texts, k, longest, buckets, bitmap, parts))
        counted = rows.filter("phrase is not null")
        if k == 1:
            totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))
        found.append(cut(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("k", F.lit(k))))
        if k == longest or found[-1].isEmpty():
            break
        bitmap = spark.sparkContext.broadcast(_bitmap(rows, buckets, least))
        parts = key_filter(cut(_keys(found[-1], k)), "key")
    return reduce(DataFrame.unionByName, found).select("lang", "phrase", "k", "f"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, absorbed: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per collocation: lang, rank, phrase, a, l, r, n, score; the first `top` of each language.

    Texts, A-Z lower-cased, are cut at .,;:!? and line breaks into pieces and those at spaces and tabs into
    words.  n is the number of a language's words, a how often a phrase of 2 to `longest` words occurs inside
    its pieces (`least` times or more).  A cut of the phrase into a first part (l occurrences) and the rest (r) scores
    floor(1000 a n / (l r)), computed with 38 digits; the cut with the least score, then the shortest first part, counts.
    A phrase goes if a longer frequent one around it occurs at least `absorbed` percent as often.  As every
    part of a frequent phrase is frequent, the next longer ones tell.

    A null text is empty and a null language is und.  Repeated rows each count; equal scores are ordered by a and
    then by the phrase's bytes.  Without frequent phrases, as for an empty table, there are no rows.
    """
    frequent, totals = frequent_phrases(docs, least, longest, lang_col, text_col)
    frequent = cut(frequent)
    many, langs = frequent.count(), totals.count()
    known = lambda phrase, count: small(frequent.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(count)), many)
    phrases = frequent.filter("k > 1").withColumnRenamed("f", "a")
    first = F.expr("substring_index(phrase, ' ', cut)")
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("first", first).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    wide = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(small(totals, langs), "lang")
    exact = lambda c: f"cast({c} as decimal(38, 0))"
    scored = wide.withColumn("score", F.expr(f"({exact('1000')} * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    best = scored.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b"))
    inner = phrases.filter("k > 2").select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("phrase"), F.col("a").alias("_f"))
    around = inner.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("a") * absorbed))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.select("lang", "phrase", "a", "_b.l", "_b.r", "n", "_b.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
