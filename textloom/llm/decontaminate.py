"""Benchmark decontamination by a broadcast hash set of word n-grams (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bloom import literal_words
from textloom.llm.common import NOT_WORD, cut, text_or_empty, words

#: The hash set goes to every executor as a literal of 18 bytes a window (36 MB); a benchmark with more distinct windows is joined by shuffle instead.
MOST_WINDOWS = 2_000_000


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, window): every run of n words of an item, or all its words if it has fewer; none for an item without words."""
    tokens = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_w")).withColumn("_l", F.least(F.size("_w"), F.lit(n))).filter("_l > 0")
    runs = tokens.select("item_id", "_l", F.explode(F.expr("transform(sequence(0, size(_w) - _l), i -> array_join(slice(_w, i + 1, _l), ' '))")).alias("window"))
    return runs.select("item_id", F.col("_l").alias("len"), "window").distinct()


#: Words of the bitmap of windows: at least 4 a window (256 bits) up to this many (16 MiB); then fewer bits a window.
MOST_WORDS = 1 << 21


def _place(hashes: Column, first, size, words_: int) -> tuple[Column, Column]:
    """(word, bit) in the bitmap of the run of `size` words from place first on: by the hashes of its first and last word, and of its middle one."""
    at = lambda k: F.get(hashes, first + k)
    middle = F.floor(size / 2).cast("int") if isinstance(size, Column) else F.lit(size // 2)
    return at(F.lit(0)).bitwiseXOR(F.shiftright(at(size - F.lit(1)), 21)).bitwiseAND(F.lit(words_ - 1)).cast("int"), at(middle).bitwiseAND(F.lit(63)).cast("int")


def _hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _listed(print_: Column, prints: Column, n: int) -> Column:
    """Whether a digest of 16 bytes is among n sorted ones, by bisection."""
    at = lambda i: F.substring(prints, i * 16 + 1, F.lit(16))

    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["lo"] + range_["hi"], 1)
        return F.when(at(middle) <= print_, F.struct(middle.alias("lo"), range_["hi"].alias("hi"))).otherwise(F.struct(range_["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda r: at(r["lo"]) == print_)


def _digest(start: Column, size: int) -> Column:
    """128 bits of the run of `size` words of _w from a place on."""
    return F.unhex(F.md5(F.array_join(F.slice(F.col("_w"), start + 1, size), " ")))


def _candidates(distinct: DataFrame, n: int) -> Column:
    """array of (s, size): the runs of _w whose place in a bitmap of the n distinct windows (len, window) is set; words are hashed once, in _h.

    The bitmap has 256 bits for each window, up to MOST_WORDS words in all, so few other runs pass.
    """
    size_ = min(MOST_WORDS, 1 << max(4, (4 * n - 1).bit_length()))
    hashed = distinct.select("len", _hashes(F.split("window", " ")).alias("_h"))
    word, bit = _place(F.col("_h"), F.lit(0), F.col("len"), size_)
    marks = hashed.select(word.cast("long").alias("id"), bit.alias("_b")).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("v"))
    table = literal_words(marks, size_)
    w = F.col("_h")

    def passing(size: int) -> Column:
        def hit(i: Column) -> Column:
            word, bit = _place(w, i, size, size_)
            return F.getbit(F.get(table, word), bit) == 1

        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(F.filter(starts, hit), lambda i: F.struct(i.alias("s"), F.lit(size).alias("size"), _digest(i, size).alias("print")))

    found = [passing(r[0]) for r in distinct.select("len").distinct().sort("len").collect()]
    return F.concat(*found) if found else F.expr("cast(array() as array<struct<s:int,size:int,print:binary>>)")


COVERED = "aggregate(_spans, named_struct('e', 0, 'c', 0L), (a, x) -> named_struct('e', greatest(a.e, x.e), 'c', a.c + greatest(0, x.e - greatest(a.e, x.s))), a -> a.c)"


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs with the columns _w (words), _row (a row number), _spans (sorted ranges of words inside occurrences of windows).

    The size of the set is counted first.  Beyond most_windows the rows are numbered and written once, the positions of
    the documents exploded and joined with the windows by shuffle, and the ranges gathered for each row.
    """
    windows = item_windows(items, n, item_id_col, item_text_col)
    distinct = cut(windows.select("len", "window").distinct())
    many = distinct.count()
    hashed = docs.select("*", words(F.col(text_col)).alias("_w")).withColumn("_h", _hashes(F.col("_w")))
    met = hashed.withColumn("_met", _candidates(distinct, many)).drop("_h")
    # The row number is made beside the spans: no filter is pushed below such a projection.  One on the spans
    # would hash the words anew for every position there.
    row = F.monotonically_increasing_id().alias("_row")
    span = lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["size"]).alias("e"))
    if many <= most_windows:
        if not many:
            return docs.select("*", words(F.col(text_col)).alias("_w"), row, F.expr(NO_SPANS).alias("_spans"))
        prints = F.lit(bytearray(distinct.agg(F.unhex(F.array_join(F.array_sort(F.collect_list(F.md5("window"))), "")).alias("all")).first()["all"]))
        spans = F.array_sort(F.transform(F.filter("_met", lambda x: _listed(x["print"], prints, many)), span))
        return met.select(*docs.columns, "_w", row, spans.alias("_spans"))
    # Only runs that the bitmap passes become rows, as digests.
    rows = cut(met.select("*", row))
    listed = distinct.select(F.unhex(F.md5("window")).alias("print")).distinct()
    hits = rows.select("_row", F.explode("_met").alias("x")).select("_row", "x.s", "x.size", "x.print").join(listed, "print", "left_semi")
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("s") + F.col("size")).alias("e")))).alias("_spans"))
    return rows.drop("_met").join(spans, "_row", "left").withColumn("_spans", F.coalesce("_spans", F.expr(NO_SPANS)))


NO_SPANS = "cast(array() as array<struct<s:int,e:int>>)"


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window of n consecutive item words (of all
    words of a shorter item).  n_items counts the distinct item_ids with occurring windows, and
    items_sha256 digests them sorted as strings and joined by commas.  A null text has no words
    and no hits.  A null item_id makes hits but is not counted or digested.  Repeated rows are reported one by one.
    An empty benchmark or an item without words makes no hits.
    """
    windows = item_windows(items, n, item_id_col, item_text_col)
    scanned = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, n, "text", item_id_col, item_text_col, most_windows)
    slim = scanned.select(
        "doc_id",
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.expr(COVERED).alias("n_hit"),
        F.expr("array_distinct(transform(_spans, x -> array_join(slice(_w, x.s + 1, x.e - x.s), ' ')))").alias("_texts"),
    )
    owners = windows.select("window", F.col("item_id").cast("string").alias("_item"))
    if windows.count() <= most_windows:
        owners = F.broadcast(owners)
    met = slim.select("doc_id", "_row", "n_words", "n_hit", F.explode_outer("_texts").alias("window")).join(owners, "window", "left")
    each = met.groupBy("_row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    return each.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows without any hit, all their columns unchanged.

    A null or empty text has no hit and stays; repeated rows stay or go together.  An empty benchmark removes nothing,
    and an empty table gives no rows.
    """
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"))
    return find_hits(kept, items, text_col="_text", **kw).filter((F.size("_spans") == 0) & (F.col("_row") >= 0)).select("_doc.*")


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs with the hit words, and what separates them from the word before, cut out of the text; other texts stay as they are.

    A null text stays null; repeated rows are cut alike.  An empty benchmark cuts nothing, and an empty table gives no rows.
    """
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"))
    scanned = find_hits(kept, items, text_col="_text", **kw)
    raw = NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    inner = raw.strip("[]+")
    pieces = scanned.withColumn("_seps", F.split(text_or_empty(F.col("_text")), f"[^{inner}]+")).withColumn("_raw", F.array_remove(F.split(text_or_empty(F.col("_text")), raw), ""))
    hit = F.expr("flatten(transform(_spans, x -> sequence(x.s, x.e - 1)))")
    rebuilt = F.expr("concat(array_join(transform(_raw, (w, i) -> if(array_contains(_hit, i), '', concat(_seps[i], w))), ''), element_at(_seps, -1))")
    out = pieces.withColumn("_hit", hit).withColumn("_new", F.when(F.size("_spans") == 0, F.col("_text")).otherwise(rebuilt))
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns])
