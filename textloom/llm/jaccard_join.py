"""N-gram Jaccard self-join: MinHash values compared in steps, pruned by their posterior, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bitset import key_filter
from textloom.llm.common import cut, join_group, small
from textloom.llm.components import components
from textloom.llm.tokens import cut_texts, digest, mix

WORDS_EACH = 5
THRESHOLD = 0.8
#: BANDS * ROWS MinHash values; two sets of similarity 0.8 share none of the bands with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared in a step, and the posterior probability of reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Texts of one side of a block, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000

_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(w: np.ndarray, n: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; of all words if there are fewer."""
    if not len(w):
        return w
    n = min(n, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(out)])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set of hashes that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[None, i : i + 4096] * _A[:, None] + _C[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared hashes (multiples of STEP): the fewest matches with which
    P(similarity >= threshold | matches) is at least the tolerance, under a uniform prior."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logs - logs.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a hash of each band of each signature, different from band to band."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return out


def survivors(a: np.ndarray, b: np.ndarray, band: int = 0, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix: the pairs of signatures that share no band before the given one and that no step drops."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    alive = np.ones(counts.shape, bool)
    pairs = None
    x, y = bands(a)[:, :band], bands(b)[:, :band]
    for i in range(band):
        alive &= x[:, i][:, None] != y[:, i][None, :]
    for step, least in enumerate(least_matches(threshold)):
        span = range(step * STEP, (step + 1) * STEP)
        if pairs is None:
            for h in span:
                counts += a[:, h][:, None] == b[:, h][None, :]
            alive &= counts >= least
            left = int(alive.sum())
            if left < 0.02 * alive.size:
                pairs = np.nonzero(alive)
                have = counts[pairs].astype(np.int64)
        else:
            have += (a[pairs[0], span.start : span.stop] == b[pairs[1], span.start : span.stop]).sum(axis=1)
            keep = have >= least
            pairs, have = (pairs[0][keep], pairs[1][keep]), have[keep]
    if pairs is not None:
        alive = np.zeros(counts.shape, bool)
        alive[pairs] = True
    return alive


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b."""
    sizes_a, sizes_b = [len(x) for x in a], [len(x) for x in b]
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(all_a, all_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out

    def occurrences(values: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.minimum(np.searchsorted(both, values), len(both) - 1)
        kept = both[col] == values
        row, col = row[kept], col[kept]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    (ra, ca), (rb, cb) = occurrences(all_a, sizes_a), occurrences(all_b, sizes_b)
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    often = na * nb > 64
    # Hashes in many sets: a product of 0/1 matrices, some columns at a time.
    at = np.cumsum(often) - 1
    total = int(often.sum())
    pa_, pb_ = often[ca], often[cb]
    fa, fb = (ra[pa_], at[ca[pa_]]), (rb[pb_], at[cb[pb_]])
    for i in range(0, total, 2048):
        width = min(2048, total - i)
        m, n = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        x, y = (fa[1] >= i) & (fa[1] < i + width), (fb[1] >= i) & (fb[1] < i + width)
        m[fa[0][x], fa[1][x] - i] = 1
        n[fb[0][y], fb[1][y] - i] = 1
        out += m @ n.T
    # Hashes in few: their pairs of sets, at most 64 each.
    ra, ca, rb = ra[~pa_], ca[~pa_], rb
    begin = np.cumsum(nb) - nb
    reps = nb[ca]
    if reps.sum():
        left = np.repeat(ra, reps)
        offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        np.add.at(out, (left, rb[np.repeat(begin[ca], reps) + offset]), 1)
    return out


def links(a: list[np.ndarray], b: list[np.ndarray], alive: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of those of the pairs that have a Jaccard similarity of at least the threshold."""
    i, j = np.nonzero(alive)
    out = np.zeros(alive.shape, bool)
    if len(i) < 4000:
        for x, y in zip(i.tolist(), j.tolist()):
            inter = len(np.intersect1d(a[x], b[y], assume_unique=True))
            out[x, y] = inter >= threshold * (len(a[x]) + len(b[y]) - inter) - 1e-9
        return out
    inter = shared(a, b)
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    return alive & (inter >= threshold * (na + nb - inter) - 1e-6)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _sides(group: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(left, right, pairs left to verify) of each bucket of a task: of itself, or of two of its blocks."""
    for _, part in group.groupby("bucket", sort=False):
        left, right = part[part["side"] != 1], part[part["side"] != 0]
        if not len(left) or not len(right) or len(part) < 2:
            continue
        same = bool((part["side"] == 2).all())
        x, y = (np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(-1, HASHES) for p in (left, right))
        alive = survivors(x, y, int(part["band"].iloc[0]))
        if same:
            alive = np.triu(alive, 1)
        yield left, right, alive


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """The texts of each bucket that are left in any pair."""
    out = [pd.concat([left[alive.any(axis=1)], right[alive.any(axis=0)]])[["bucket", "band", "cid", "sig"]] for left, right, alive in _sides(group)]
    return pd.concat(out).drop_duplicates(["bucket", "cid"]) if out else group[["bucket", "band", "cid", "sig"]].iloc[:0]


def _verify(group: pd.DataFrame) -> pd.DataFrame:
    """(cid, n, root): of each linked text, its links in a bucket and the least text of the bucket that they reach."""
    out = []
    for left, right, alive in _sides(group):
        found = links(*([np.frombuffer(x, np.uint64) for x in p["s"]] for p in (left, right)), alive)
        ids = np.concatenate([left["cid"], right["cid"]])
        i, j = np.nonzero(found)
        n = np.concatenate([found.sum(axis=1), found.sum(axis=0)])
        # The same text on both sides is one node.
        nodes, at = np.unique(ids, return_inverse=True)
        roots = nodes[_roots(len(nodes), at[i], at[len(left) + j])]
        out.append(pd.DataFrame({"cid": nodes, "n": np.bincount(at, n, len(nodes)).astype(np.int64), "root": roots})[lambda d: d["n"] > 0])
    return pd.concat(out) if out else pd.DataFrame({"cid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})


def _dealt(members: DataFrame, size: str) -> DataFrame:
    """members (bucket, cid, ...) of buckets, with the task that compares them and the side that each is on.

    Small buckets share tasks; a bucket of more than a block has a task for each pair of its blocks.  Blocks are bounded in
    texts and in the sum of the column size.
    """
    sizes = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_size")).filter("_n > 1"))
    total = sizes.agg(F.sum("_n"), F.sum("_size"), F.count(F.lit(1))).first()
    bins = max(1, -(-(total[0] or 0) // BLOCK), -(-(total[1] or 0) // BLOCK_SHINGLES))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_size") / BLOCK_SHINGLES)).cast("int")
    joined = join_group(members, sizes.withColumn("blocks", blocks).drop("_size"), "bucket", "_n").withColumn("_b", F.pmod(F.xxhash64("cid", F.lit(9)), F.col("blocks")).cast("int"))
    return joined.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *members.columns,
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(bins))).otherwise(F.xxhash64("bucket", F.least("_b", "_o"), F.greatest("_b", "_o"))).alias("task"),
        F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1).alias("side"),
    )


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pick, t): pick stands for a row's identifier and text."""
    return docs.select(F.col(id_col).alias("doc_id"), _pick(id_col, text_col).alias("pick"), F.col(text_col).alias("t"))


def _pick(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(1), F.col(text_col))


def _signed(base: DataFrame) -> DataFrame:
    """(doc_id, pick, key, sig, size): md5 of a row's words (of the text if it has none), MinHash values and number of shingles.

    Within a batch only the first row of a key carries the values.
    """
    kind = base.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t")
            for lo, hi, found in cut_texts(texts):
                keys = [digest(found, i, b"" if (x := texts[lo + i]).as_buffer() is None else x.as_buffer().to_pybytes()) for i in range(hi - lo)]
                first = {k: i for i, k in reversed(list(enumerate(keys)))}
                sigs: list[bytes | None] = [None] * len(keys)
                sizes = [0] * len(keys)
                for i in first.values():
                    if len(w := found.of(i)):
                        s = shingles(w)
                        sigs[i], sizes[i] = signature(s).tobytes(), len(s)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("pick").slice(lo, hi - lo), pa.array(keys), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "pick", "key", "sig", "size"])

    return base.mapInArrow(sign, f"doc_id {kind}, pick long, key string, sig binary, size long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_copies.

    Texts are compared as sets of runs of five words (of all words if there are fewer); a link
    is a similarity of 0.8 or more between texts with different words.  copy_id is the least doc_id with the
    same words (for texts without words: the same text), n_copies the number of such documents, n_links the
    number of different texts that a document's text is linked to, class_id the least doc_id
    that links reach.

    1. Texts with equal words become one class, combined on the map side.
    2. 128 MinHash values of each class make 32 bands of 4; the classes that share a band are a bucket.  Buckets with the
       same classes count as one, the first.
    3. The classes of a bucket are compared, in blocks of about 1024 if there are more.  The MinHash values are
       compared 16 at a time, and a pair is dropped as soon as the posterior probability of a similarity of 0.8 falls
       below 1e-9; a pair that shares an earlier band is left to that band's bucket.
    4. The sets of the classes left in a pair are shipped to their buckets and the pairs verified on them.  A block returns one
       row for each text: how many links, and the least text it reaches.
    5. Those rows give the counts and, as edges, the classes.

    Null text counts as empty; empty texts are one another's copies and have no links.  A null doc_id can't
    become class_id unless all are null.  Repeated rows are copies of each other.  An empty table gives no rows.
    """
    return _joined(docs, id_col, text_col).select("doc_id", "class_id", "copy_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the least doc_id (null last); all columns unchanged.

    Of rows repeated with their doc_id and text one stays.  Null text counts as empty, and empty texts are copies.  An empty
    table gives no rows.
    """
    rows = cut(_joined(docs, id_col, text_col).select("doc_id", "pick", "component"))
    kept = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pick")).alias("_m")).select(F.col("_m.pick").alias("_pick"))
    # What is dropped, and what stays once although it is there again; all other rows stay as they are.
    each = cut(rows.groupBy("pick").agg(F.count(F.lit(1)).alias("_rows")).join(kept.withColumn("_kept", F.lit(True)), F.col("pick") == F.col("_pick"), "left").filter("_kept is null or _rows > 1").select("pick", F.col("_kept").isNotNull().alias("_again")))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), _pick(id_col, text_col).alias("pick"))
    marked = packed.join(small(each, each.count()), "pick", "left")
    single = marked.filter("_again is null").select("_doc")
    if not each.filter("_again").isEmpty():
        single = single.unionByName(marked.filter("_again").dropDuplicates(["pick"]).select("_doc"))
    return single.select("_doc.*")


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = _base(docs, id_col, text_col)
    signed = cut(_signed(base))
    cid = F.xxhash64("key").alias("cid")
    classes = cut(signed.groupBy(cid, "key").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.min("pick").alias("pick"), F.first("sig", True).alias("sig"), F.max("size").alias("size")))
    full = classes.filter("sig is not null").select("cid", "sig", "size", "pick")

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return bands(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids = np.repeat(b.column("cid").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(rows_of(b).ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(cids)], names=["bucket", "band", "cid"])

    # A bucket is known by its members' number, extremes and hashes; of equal ones the first band's stays.
    buckets = full.select("cid", "sig").mapInArrow(placed, "bucket long, band int, cid long").groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("least"), F.max("cid").alias("most"), F.bit_xor(F.xxhash64("cid")).alias("all")).filter("n > 1")
    kept = cut(buckets.groupBy("n", "least", "most", "all").agg(F.min(F.struct("band", "bucket")).alias("m")).select("m.bucket", "m.band"))
    wanted = key_filter(kept, "bucket")

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = rows_of(b)
            i, j = np.nonzero(wanted(found.ravel()).reshape(found.shape))
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(found[i, j].view(np.int64)), pa.array(j.astype(np.int32)), b.column("cid").take(take), b.column("sig").take(take)], names=["bucket", "band", "cid", "sig"])

    # What the filter passes without reason is alone in its bucket, or one more text of a bucket with a twin, where it does no harm.
    members = cut(full.select("cid", "sig").mapInArrow(members_of, "bucket long, band int, cid long, sig binary"))
    left = cut(_dealt(members.withColumn("size", F.lit(0)), "size").groupBy("task").applyInPandas(_compare, "bucket long, band int, cid long, sig binary").dropDuplicates(["bucket", "cid"]))
    chosen = cut(left.select("cid").distinct().join(classes.select("cid", "pick", "size"), "cid"))
    picked = key_filter(chosen, "pick")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(picked(b.column("pick").to_numpy(zero_copy_only=False).view(np.uint64))))
            for lo, hi, found in cut_texts(some.column("t")):
                out = [shingles(found.of(i)).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([some.column("pick").slice(lo, hi - lo), pa.array(out, pa.binary())], names=["pick", "s"])

    texts = base.select("pick", "t").mapInArrow(sets_of, "pick long, s binary").join(chosen, "pick").groupBy("cid").agg(F.first("s").alias("s"), F.first("size").alias("size"))
    ready = _dealt(cut(left.join(chosen.select("cid", "size"), "cid")), "size").join(texts.drop("size"), "cid")
    verified = cut(ready.groupBy("task").applyInPandas(_verify, "cid long, n long, root long"))
    counts = verified.groupBy("cid").agg(F.sum("n").alias("n_links"))
    joined = components(verified.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.select("cid", "key", "copy_id", "n_copies").join(counts, "cid", "left").join(joined, F.col("cid") == F.col("node"), "left")
    known = cut(known.select("key", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    least = known.groupBy("component").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    table = cut(join_group(known, cut(least), "component", "_n"))
    return join_group(signed.select("doc_id", "key", "pick"), table, "key", "n_copies")
