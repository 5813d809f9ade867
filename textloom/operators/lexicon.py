"""Phrase dictionaries matched against whole texts."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.phrases import CTA, DICTIONARY, HOOKS
from textloom.functions.regex import B, let
from textloom.functions.text import STOPWORDS, first_line, line_at, normalised, whole, words

Entries = list[tuple[str, int, str]]


def _entries(dictionary: Entries) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("pos"), F.lit(p).alias("phrase")) for k, i, p in dictionary])


@lru_cache(16)
def _automaton(phrases: tuple[str, ...]):
    """Automaton over the phrases and, where they have an apostrophe, over their forms without the first one; its values are (phrase, without)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    forms: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        forms.setdefault(p, []).append(i)
        if "'" in p:
            forms.setdefault(p.replace("'", "", 1), []).append(i + len(phrases))
    for form, ids in forms.items():
        if form:
            found.add_word(form, tuple(ids))
    found.make_automaton()
    return found


def matcher(dictionary: Entries = DICTIONARY):
    """A function of a lower-cased text: sorted array<int> of the entries that stand in it.

    One pass of an automaton finds all phrases at once, in Arrow batches; a text is not read again for each of them.  An entry of
    which only the form without its first apostrophe stands in the text has the number of entries added.
    """
    phrases = tuple(p for _, _, p in dictionary)

    def found(texts: pd.Series) -> pd.Series:
        automaton, n = _automaton(phrases), len(phrases)
        out = []
        for t in texts:
            ids: set[int] = set()
            if t and len(automaton):
                for _, x in automaton.iter(t):
                    ids.update(x)
            out.append(sorted(i for i in ids if i < n or i - n not in ids))
        return pd.Series(out)

    return F.pandas_udf(found, "array<int>")


def hits(docs: DataFrame, dictionary: Entries = DICTIONARY, text_col: str = "text") -> DataFrame:
    """docs x phrase rows (kind, pos, phrase, position, line, context), one for each phrase that a text holds.

    Each text is read once where it lies and only hits become rows.  The position is the first one, from 0,
    case-insensitive; a phrase with an apostrophe is also found without it.
    """
    others = [c for c in docs.columns if c != text_col]
    base = docs.select(*others, whole(F.col(text_col)).alias("_t")).withColumn("_low", F.lower("_t"))
    found = base.withColumn("_ids", matcher(dictionary)("_low"))
    # Not explode(): its filter on the array's size would be pushed below and search the texts a second time.
    rows = found.select(*others, "_t", "_low", F.explode_outer("_ids").alias("_i")).filter("_i is not null")
    rows = rows.select(*others, "_t", "_low", F.get(_entries(dictionary), F.col("_i") % len(dictionary)).alias("_e"), (F.col("_i") >= len(dictionary)).alias("_bare")).select(*others, "_t", "_low", "_bare", "_e.*")
    # A phrase's first apostrophe is optional where the phrase itself is not found.
    position = F.instr("_low", F.when(F.col("_bare"), F.regexp_replace("phrase", "^([^']*)'", "$1")).otherwise(F.col("phrase"))) - 1
    placed = rows.withColumn("position", position)
    start = F.greatest(F.lit(0), F.col("position") - 48)
    end = F.least(F.length("_t"), F.col("position") + F.length("phrase") + 48)
    context = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(F.col("_t"), start + 1, end - start), F.when(end < F.length("_t"), "...").otherwise(""))
    return placed.withColumn("line", line_at(F.col("_t"), F.col("position"))).withColumn("context", context).drop("_t", "_low", "_bare")


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping places of a phrase in a normalised text."""
    t = normalised(text)
    return ((F.length(t) - F.length(F.replace(t, phrase, F.lit("")))) / F.length(phrase)).cast("int")


def present(kind: str, ids: Column, dictionary: Entries = DICTIONARY) -> Column:
    """Number of distinct phrases of a kind, with their apostrophes, among the entries that matcher() found."""
    mine = [i for i, (k, _, _) in enumerate(dictionary) if k == kind]
    return F.size(F.filter(ids, lambda i: i.between(mine[0], mine[-1]))) if mine else F.lit(0)


def hook_head(text: Column) -> Column:
    return F.concat(first_line(text), F.lit(" "), F.array_join(F.slice(F.split(whole(text), "\n"), 1, 2), " "))


#: A boundary before or behind a pattern whose own end is a word character.
_LEAD, _TRAIL = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def searched(pattern: str) -> str:
    """A fixed pattern in a form that finds a match in the same texts, first at the same place, in less time.

    A boundary around a group of words looks one way.  A class that repeats before white space finds its last character
    alone: any longer match ends in that one, and the run needn't be tried from each of its characters.
    """
    out = re.sub(r"^(\(\?i\))?\{B\}(?=[(a-z])", lambda m: f"{m[1] or ''}{_LEAD}", pattern)
    return re.sub(r"(?<=[)a-z])\{B\}$", _TRAIL, out).replace("{B}", B)


def hook_families(text: Column) -> Column:
    """array<string> of the hook families that the opening belongs to."""
    # Only whether a family matches counts here, not where.
    once = lambda p: searched(p).replace(r"]+\s+(?:", r"]\s+(?:")
    found = lambda head: F.filter(F.array(*[F.when(head.rlike(once(p)), F.lit(n)) for n, p in HOOKS]), lambda x: x.isNotNull())
    return let(hook_head(text), found)


#: Words without which a call to action of a kind can't stand in a text, lower-cased.
ROOTS = {
    "ask": ("comment", "dm", "message me", "reply", "drop a", "leave a", "send me", "email me", "tell me", "let me know"),
    "link": ("link ", "url "),
    "read": ("read ", "full "),
    "follow": ("follow", "connect with me", "add me"),
    "save": ("save this",),
    "book": ("sign up", "get access", "book", "call", "grab"),
    "question": ("?",),
}


def cta_positions(text: Column) -> Column:
    """First offsets of each kind of call to action, from 0, kinds that are absent left out; a pattern is only tried on texts with one of its roots."""
    t = whole(text)

    def place(low: Column, kind: str, pattern: str) -> Column:
        rooted = reduce(lambda a, r: a | low.contains(r), ROOTS[kind], F.lit(False))
        return F.when(rooted, F.nullif(F.regexp_instr(t, F.lit(searched(pattern))), F.lit(0)) - 1)

    return F.filter(let(F.lower(t), lambda low: F.array(*[place(low, k, p) for k, p in CTA])), lambda x: x.isNotNull())


def has_markdown(text: Column) -> Column:
    t = whole(text)
    marked = t.contains("#") | t.contains("|") | t.contains("**")
    return marked & t.rlike(r"(?m)^\s*#{1,6}\s|^.*\|.*\||\*\*[^*\n]+\*\*")


def contains_word(text: Column, phrase: str) -> Column:
    """The phrase between characters that are not word characters, case-insensitive."""
    return whole(text).rlike(f"(?i)(?:^|[^A-Za-z0-9_]){re.escape(phrase)}(?:$|[^A-Za-z0-9_])")


def vocabulary(docs: DataFrame, prefer: list[str], avoid: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, report, word, n): words to avoid that occur, preferred words that don't, and preferred words that occur over 3 times."""
    text = F.col(text_col)
    entries = [F.struct(F.lit("avoid").alias("report"), F.lit(w).alias("word"), contains_word(text, w).alias("hit"), occurrences(text, F.lit(w)).alias("n")) for w in avoid]
    entries += [F.struct(F.lit("missing").alias("report"), F.lit(w).alias("word"), (~contains_word(text, w)).alias("hit"), F.lit(0).alias("n")) for w in prefer]
    entries += [F.struct(F.lit("overuse").alias("report"), F.lit(w).alias("word"), (occurrences(text, F.lit(w)) > 3).alias("hit"), occurrences(text, F.lit(w)).alias("n")) for w in prefer]
    return docs.select(id_col, F.explode(F.array(*entries)).alias("_e")).filter("_e.hit").select(id_col, "_e.report", "_e.word", "_e.n")


def dominant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 12) -> DataFrame:
    """(id, word, n, rank): the most frequent content words of each text, of 4 letters or more and no stop words; ties by word."""
    found = words(F.lower(whole(F.col(text_col))))
    rows = docs.select(id_col, F.explode_outer(found).alias("word")).filter((F.length("word") >= 4) & ~F.col("word").isin(STOPWORDS))
    n = rows.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= limit)
