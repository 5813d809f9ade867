"""Passages that repeat across documents, by a sparse suffix array: suffixes at minimiser positions are sorted,
neighbours compared, and matches extended left and right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bitset import KeyFilter, key_filter
from textloom.llm.common import cut, shuffle_partitions
from textloom.llm.tokens import cut_texts, rolled

#: A passage has at least so many words.
LEAST_WORDS = 50
#: Words of a suffix's head.  A window of LEAST_WORDS - HEAD + 1 heads has one minimiser, so every
#: run of LEAST_WORDS equal words holds the same retained suffix wherever it stands.
HEAD = 20
#: Characters of a suffix that serve as range key, before the hash of its head.
PREFIX = 64
#: Suffixes with one head that a task holds at once; the windows of more frequent heads are sorted one by one, over many ranges.
MOST_HELD = 2_000
#: Repeated heads that the filter holds well; more are joined by shuffle.
MOST_KEYS = 40_000_000


def minimisers(heads: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` heads, the position of its least head (the first of equal ones)."""
    n = len(heads) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Least values of windows by doubling; the position rides along in ties by order.
    best = np.arange(len(heads))
    span = 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(heads[b] < heads[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(heads[b] < heads[a], b, a)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, copy, t): a row is known by its identifier and a hash of its text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("t"))


def _retained(w: np.ndarray, least: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads, places, lo, hi) of a text's suffixes at minimiser positions.

    heads holds the hash of every head.  The windows of `least` words whose minimiser is at place p begin at
    p - hi to p - lo.
    """
    h = rolled(w, head)
    m = minimisers(h, least - head + 1)
    turn = np.flatnonzero(np.diff(m, prepend=-1))
    places = m[turn]
    return h, places, places - np.append(turn[1:] - 1, len(m) - 1), places - turn


def _heads(source: DataFrame, least: int, head: int, where: bool) -> DataFrame:
    """(h) of each retained suffix; with its place (doc_id, copy, at) as well if asked for."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, found in cut_texts(b.column("t")):
                hashes, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(np.diff(found.bounds) >= least):
                    h, places, _, _ = _retained(found.of(i), least, head)
                    hashes.append(h[places])
                    rows.append(np.full(len(places), lo + i))
                    at.append(places)
                cols = [pa.array(np.concatenate(hashes).view(np.int64))]
                if where:
                    take = pa.array(np.concatenate(rows))
                    cols += [b.column("doc_id").take(take), b.column("copy").take(take), pa.array(np.concatenate(at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "doc_id", "copy", "at"][: len(cols)])

    return source.mapInArrow(heads_of, f"h long, doc_id {kind}, copy long, at int" if where else "h long")


#: Columns of the table of suffixes.  A row with n is a document and its number of words; one with run a window of
#: a very frequent head, with its places in the document; the others are suffixes.
_COLUMNS = ("doc_id", "copy", "n", "run", "places", "h", "at", "lo", "hi", "before", "following")


def _suffixes(source: DataFrame, least: int, head: int, may_repeat: KeyFilter | None, frequent: KeyFilter) -> DataFrame:
    """The retained suffixes with a repeated head, each with the words that its windows can reach on either side.

    Without a filter, the column wanted names the places of suffixes with repeated heads.
    """
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column("wanted") if may_repeat is None else None
            for lo, hi, found in cut_texts(b.column("t")):
                take: list[int] = list(range(lo, hi))
                out: list[list] = [[] for _ in fields]

                def put(row: int, **values) -> None:
                    take.append(row)
                    for c, name in zip(out, _COLUMNS[2:]):
                        c.append(values.get(name))

                sizes = np.diff(found.bounds)
                for c, name in zip(out, _COLUMNS[2:]):
                    c.extend(sizes.tolist() if name == "n" else [None] * (hi - lo))
                for i in np.flatnonzero(sizes >= least):
                    w = found.of(i)
                    h, places, near, far = _retained(w, least, head)
                    hit = may_repeat(h[places]) if wanted is None else np.isin(places, np.asarray(wanted[lo + i].as_py() or [], np.int64))
                    if not hit.any():
                        continue
                    places, near, far = places[hit], near[hit], far[hit]
                    many = frequent(h[places])
                    if many.any():
                        at = np.concatenate([np.arange(p - y, p - x + 1) for p, x, y in zip(places[many], near[many], far[many])])
                        for run, ids in _same(rolled(w, least)[at]):
                            put(lo + i, run=run, places=np.sort(at[ids]).astype(np.int32))
                    first = int(found.bounds[i])
                    ends = np.cumsum(found.ends[first : first + len(w)] - found.starts[first : first + len(w)] + 1)
                    text = found.joined(first, first + len(w))
                    for p, x, y in zip(places[~many].tolist(), near[~many].tolist(), far[~many].tolist()):
                        here = int(ends[p - 1]) if p else 0
                        back = int(ends[p - y - 1]) if p > y else 0
                        put(lo + i, h=int(h[p].view(np.int64)), at=p, lo=x, hi=y, before=text[back : max(back, here - 1)], following=text[here : int(ends[p + least - x - 1]) - 1])
                ids = pa.array(take, pa.int64())
                cols = [b.column("doc_id").take(ids), b.column("copy").take(ids), *(pa.array(c, pa.binary()).cast(pa.string()) if t == pa.string() else pa.array(c, t) for c, t in zip(out, fields))]
                yield pa.RecordBatch.from_arrays(cols, names=list(_COLUMNS))

    return source.mapInArrow(rows_of, f"doc_id {kind}, copy long, n long, run long, places array<int>, h long, at int, lo int, hi int, before string, following string")


def _same(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key with the indices at which it stands."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for ids in np.split(order, cuts):
        yield int(keys[ids[0]].view(np.int64)), ids


def common_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; rows have `sizes` values each."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    within = np.arange(rows.shape[1])[None, :] < np.minimum(sizes[1:], sizes[:-1])[:, None]
    return np.cumprod((rows[1:] == rows[:-1]) & within, axis=1).sum(axis=1)


def _matches(b: pa.RecordBatch, least: int, width: int) -> pa.RecordBatch:
    """Where the windows around sorted suffixes stand more than once: (doc_id, copy, across, later), lists of word ranges.

    The suffixes with one head lie side by side, in the order of their words.  Neighbours that share x words
    share every shorter prefix with all that lies between, so at each x the suffixes fall into intervals.  For a window
    that begins a words before its suffix, matches reach least - a words to the right by the
    intervals and are extended to the left word by word: an interval is split by the words before.
    """
    m = b.num_rows
    lo, hi, at, h = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi", "at", "h"))
    # Each different word has a number of its own, so comparing numbers compares words.
    behind, ahead = (pc.split_pattern(b.column(c), " ") for c in ("before", "following"))
    codes = pa.concat_arrays([behind.flatten(), ahead.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(behind).to_numpy(zero_copy_only=False))
    starts = np.cumsum(pc.list_value_length(ahead).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = ends[-1] + np.concatenate([np.zeros(1, np.int64), starts[:-1]])
    following = codes[np.minimum(starts[:, None] + np.arange(least)[None, :], len(codes) - 1)]
    before = codes[np.maximum(ends[:, None] - 1 - np.arange(width - 1)[None, :], 0)]
    prefix = common_prefixes(following, least - lo)
    prefix[h[1:] != h[:-1]] = 0
    ids = b.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(pa.table({"d": b.column("doc_id"), "c": b.column("copy"), "a": b.column("at")}), sort_keys=[("d", "ascending"), ("c", "ascending"), ("a", "ascending")], null_placement="at_start").to_numpy()
    copies = b.column("copy").to_numpy(zero_copy_only=False)
    other = np.ones(m, bool)
    other[1:] = (ids[order][1:] != ids[order][:-1]) | (copies[order][1:] != copies[order][:-1])
    step = other.copy()
    step[1:] |= at[order][1:] != at[order][:-1]
    place, document = np.empty(m, np.int64), np.empty(m, np.int64)
    place[order], document[order] = np.cumsum(step), np.cumsum(other)
    across, later = np.zeros((m, width), bool), np.zeros((m, width), bool)
    lefts = np.zeros(m, np.int64)
    for a in range(width):
        if a:
            # Matches grow by the next word to the left.  Suffixes with fewer words before them are not on from here.
            _, lefts = np.unique(lefts * (len(codes) + 1) + before[:, a - 1], return_inverse=True)
        on = np.flatnonzero((lo <= a) & (a <= hi))
        if len(on) < 2:
            continue
        interval = np.concatenate([np.zeros(1, np.int64), np.cumsum(prefix < least - a)])
        _, group = np.unique(interval[on] * (m + 1) + lefts[on], return_inverse=True)
        by = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[by], prepend=-1))
        spread = lambda f, x: f.reduceat(x[on][by], cuts)[group]
        across[on, a] = spread(np.minimum, document) < spread(np.maximum, document)
        later[on, a] = place[on] > spread(np.minimum, place)
    kept = np.flatnonzero(later.any(axis=1) | across.any(axis=1))
    take = pa.array(kept)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("copy").take(take), _ranges(across[kept], at[kept], least), _ranges(later[kept], at[kept], least)], names=["doc_id", "copy", "across", "later"])


def _ranges(on: np.ndarray, at: np.ndarray, least: int) -> pa.ListArray:
    """For each suffix, the word ranges of its marked windows; column a is the window that begins a words before it."""
    wide = np.zeros((len(on), on.shape[1] + 2), np.int8)
    wide[:, 1:-1] = on[:, ::-1]
    turn = np.diff(wide, axis=1)
    row, first = np.nonzero(turn == 1)
    last = np.nonzero(turn == -1)[1] - 1
    start = at[row] - (on.shape[1] - 1)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum((turn == 1).sum(axis=1))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array((start + first).astype(np.int32)), pa.array((start + last + least).astype(np.int32))], names=["first", "end"])
    return pa.ListArray.from_arrays(pa.array(ends), spans)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(documents, found): (doc_id, copy, n) of each row, and (doc_id, copy, across, later) of repeated runs.

    across: ranges of words inside runs of `least` words that another document has as well; later: inside runs with an
    earlier place, by (doc_id, place).  Ranges of one document come from disjoint sets of runs.

    1. Each document's suffixes at minimiser positions are retained, about 1 in 16; every run of `least` words has
       one of them near its start, the same one wherever it stands.
    2. Counting equal heads (combined on the map side) finds those that repeat.  A filter of bounded
       size holds them; if there are too many for it, a shuffle join picks the suffixes.
    3. The suffixes with such heads are range-partitioned by sampled splitters over (leading characters, hash of the head) and sorted by
       their words.  Neighbours are compared word by word, and matches extended to the left (see _matches).
    4. A head with more suffixes than a task may hold goes another way with the same result: the hashes of its windows are
       sorted by sampled splitters over (hash, document), so that a passage in very many documents spans several
       ranges, and each is compared with its neighbours; runs at the edges of a range are compared with those of the other ranges.
    """
    spark = docs.sparkSession
    width = least - head + 1
    source = _source(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    repeated = cut(_heads(source, least, head, False).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    frequent = key_filter(repeated.filter(F.col("n") > MOST_HELD), "h")
    if repeated.count() <= MOST_KEYS:
        table = cut(_suffixes(source, least, head, key_filter(repeated, "h"), frequent))
    else:
        wanted = _heads(source, least, head, True).join(repeated, "h", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_set("at").alias("wanted"))
        picked = source.join(wanted, source["doc_id"].eqNullSafe(wanted["_id"]) & (source["copy"] == wanted["_copy"]), "left").select("doc_id", "copy", "t", "wanted")
        table = cut(_suffixes(picked, least, head, None, frequent))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h = b.column("h").to_numpy(zero_copy_only=False)
            turn = np.flatnonzero(h[1:] != h[:-1])
            end = int(turn[-1]) + 1 if len(turn) else 0
            if end:
                yield _matches(b.slice(0, end), least, width)
            held = b.slice(end)
        if held is not None and held.num_rows:
            yield _matches(held, least, width)

    suffixes = table.filter("h is not null").select("doc_id", "copy", "h", "at", "lo", "hi", "before", "following", F.substring("following", 1, PREFIX).alias("start"))
    ordered = suffixes.repartitionByRange(shuffle_partitions(spark), "start", "h").sortWithinPartitions("start", "h", "following").drop("start")
    found = ordered.mapInArrow(compare, f"doc_id {kind}, copy long, across {SPANS}, later {SPANS}")
    if not table.filter("run is not null").isEmpty():
        found = found.unionByName(_frequent_runs(table.filter("run is not null").select("doc_id", "copy", F.col("places").alias("at"), "run"), least))
    return table.filter("n is not null").select("doc_id", "copy", "n"), found


SPANS = "array<struct<first:int,end:int>>"


def _frequent_runs(windows: DataFrame, least: int) -> DataFrame:
    """(doc_id, copy, across, later) of windows (doc_id, copy, at, run), by a sort of their hashes."""
    spark = windows.sparkSession
    kind = windows.schema["doc_id"].dataType.simpleString()
    runs = windows.dropDuplicates(["doc_id", "copy", "run"])
    ordered = runs.repartitionByRange(shuffle_partitions(spark), "run", "doc_id", "copy").sortWithinPartitions("run", "doc_id", "copy")
    met = cut(ordered.mapInArrow(_compare, f"doc_id {kind}, copy long, at array<int>, run long, part int, state int, later boolean"))
    # Three rows for each range at most: what stands at its edges.  Only these may have equal runs in another range, so
    # only they are joined; whatever lies between two neighbours of its own range is known already.
    edges = F.broadcast(met.filter(f"state in ({ALONE}, {START}, {MARK})").groupBy("run").agg(F.count(F.lit(1)).alias("_n"), F.min("part").alias("_first")))
    between = met.filter(f"state in ({INSIDE}, {WITHIN})").select("doc_id", "copy", "at", (F.col("state") == INSIDE).alias("_across"), ((F.col("state") == INSIDE) & F.col("later")).alias("_later"))
    outer = met.filter(f"state in ({ALONE}, {START})").join(edges, "run")
    across = (F.col("state") == START) | (F.col("_n") > 1)
    later = across & (F.col("part") > F.col("_first"))
    marked = between.unionByName(outer.select("doc_id", "copy", "at", across.alias("_across"), later.alias("_later"))).filter("_across or size(at) > 1")
    spans = f"transform(at, x -> named_struct('first', x, 'end', x + {least}))"
    none = f"cast(array() as {SPANS})"
    return marked.select("doc_id", "copy", F.expr(f"if(_across, {spans}, {none})").alias("across"), F.expr(f"if(_later, {spans}, slice({spans}, 2, size(at)))").alias("later"))


#: A run beside an equal one; one that is alone at the edge of its range; the first of equal ones
#: at the start of a range; a note of equal ones at the end of a range; and one whose document alone holds it, twice.
INSIDE, ALONE, START, MARK, WITHIN = 2, 1, 3, 0, 4


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each run of a sorted range with the one before and the one after it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: pa.RecordBatch | None = None
    before: int | None = None

    def emit(b: pa.RecordBatch, n: int, final: bool) -> pa.RecordBatch:
        nonlocal before
        run = b.column("run").to_numpy(zero_copy_only=False)
        prev = np.empty(len(run), bool)
        prev[1:] = run[1:] == run[:-1]
        prev[0] = before is not None and run[0] == before
        after = np.zeros(len(run), bool)
        after[:-1] = prev[1:]
        state = np.where(prev | after, INSIDE, np.where(np.diff(b.column("at").offsets.to_numpy()) > 1, WITHIN, -1))
        if before is None:
            state[0] = START if after[0] else ALONE
        if final and not prev[-1]:
            state[-1] = ALONE
        take = np.flatnonzero(state[:n] >= 0)
        cols = [b.column(c).take(pa.array(take)) for c in ("doc_id", "copy", "at", "run")]
        size = len(take)
        cols += [pa.array(np.full(size, part, np.int32)), pa.array(state[take].astype(np.int32)), pa.array(prev[take])]
        out = pa.RecordBatch.from_arrays(cols, names=NAMES)
        if final and prev[-1]:
            mark = [pa.nulls(1, out.schema.field(0).type), pa.nulls(1, out.schema.field(1).type), pa.nulls(1, out.schema.field(2).type), pa.array([int(run[-1])], pa.int64()), pa.array([part], pa.int32()), pa.array([MARK], pa.int32()), pa.array([True])]
            out = pa.Table.from_batches([out, pa.RecordBatch.from_arrays(mark, names=NAMES)]).combine_chunks().to_batches()[0]
        before = int(run[n - 1]) if n else before
        return out

    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if b.num_rows > 1:
            yield emit(b, b.num_rows - 1, False)
        held = b.slice(b.num_rows - 1)
    if held is not None:
        yield emit(held, 1, True)


NAMES = ["doc_id", "copy", "at", "run", "part", "state", "later"]


def _merged(spans: str) -> str:
    """Sorted ranges whose ends rise with their starts, those that touch as one."""
    first = f"filter({spans}, (x, i) -> i = 0 or x.first > {spans}[i - 1].end)"
    last = f"filter({spans}, (x, i) -> i = size({spans}) - 1 or {spans}[i + 1].first > x.end)"
    return f"zip_with({first}, {last}, (a, b) -> named_struct('first', a.first, 'end', b.end))"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, n_words, n_repeated, n_later, spans, later_spans, repeated.

    A word is repeated if it lies in a run of `least` consecutive words that another document has
    as well; spans are the ranges of such words (first, end).  later_spans cover the runs that have an earlier place
    by (doc_id, place), in another document or in the same one, so cutting them keeps one copy of
    every passage.

    Null, empty and short texts have no passages.  Rows repeated with their identifier and text are one document
    and get the same spans.  An empty table gives no rows.
    """
    slim, found = repeated_windows(docs, id_col, text_col, least, head)
    gathered = found.groupBy("doc_id", "copy").agg(*(F.array_sort(F.flatten(F.collect_list(c))).alias(f"_{c}") for c in ("across", "later")))
    each = gathered.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.expr(_merged("_across")).alias("_spans"), F.expr(_merged("_later")).alias("_after"))
    none = F.expr(f"cast(array() as {SPANS})")
    length = "aggregate({}, 0L, (a, x) -> a + x.end - x.first)"
    out = slim.join(each, slim["doc_id"].eqNullSafe(each["_id"]) & (slim["copy"] == each["_copy"]), "left").select("doc_id", F.col("n").alias("n_words"), F.coalesce("_spans", none).alias("spans"), F.coalesce("_after", none).alias("later_spans"))
    return out.select("doc_id", "n_words", F.expr(length.format("spans")).alias("n_repeated"), F.expr(length.format("later_spans")).alias("n_later"), "spans", "later_spans", (F.size("spans") > 0).alias("repeated"))
