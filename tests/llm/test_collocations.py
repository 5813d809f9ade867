"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import collocations as col

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
SCHEMA = "doc_id long, text string, lang string"


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(UPPER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, longest=5, absorbed=100, top=2000):
    f, n = counted(rows, longest)
    kept = {x: a for x, a in f.items() if a >= least and " " in x[1]}
    out = defaultdict(list)
    for (lang, phrase), a in kept.items():
        if any(la == lang and len(other) > len(phrase) and f" {phrase} " in f" {other} " and 100 * b >= absorbed * a for (la, other), b in kept.items()):
            continue
        w = phrase.split(" ")
        score, _, l_, r = min((1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w)))
        out[lang].append((-score, -a, phrase.encode(), l_, r))
    return sorted((lang, rank, p.decode(), -a, l_, r, n[lang], -s) for lang, every in out.items() for rank, (s, a, p, l_, r) in enumerate(sorted(every)[:top], 1))


def prose(seed, n, words):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        out += r.choice((["New", "York", "city"], ["of", "the"], ["in", "spite", "of", "the", "rain"], [r.choice(words)], [r.choice(words) + r.choice(".,;:!?\n\x0b\x0c\r")]))
    return r.choice((" ", "  ", "\t")).join(out)


WORDS = [f"w{i}" for i in range(40)] + ["été", "漢字", "(x)", "don't", "a b"]
ROWS = [(prose(i, 120, WORDS), ("en", "fr", None)[i % 3]) for i in range(60)]
ROWS += [(None, "en"), ("", "en"), ("  \t ", "en"), ("... !!!", "de"), ("one", None)] + [("again and again and again", "en")] * 30
ROWS += [(prose(99, 30_000, WORDS), "en"), ("same same " * 4_000, "hot")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], SCHEMA).selectExpr("*", "'x' as n", "'x' as phrase", "1 as k", "'x' as block").repartition(5)


@pytest.mark.parametrize("least,longest,absorbed,top", [(20, 5, 100, 2000), (5, 4, 60, 7), (300, 3, 100, 2000)])
def test_equals_a_plain_count(docs, least, longest, absorbed, top):
    found = col.collocations(docs, least=least, longest=longest, absorbed=absorbed, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(ROWS, least, longest, absorbed, top)


def test_full_buckets_and_handed_on_counts_change_nothing(docs, monkeypatch):
    # Sixteen buckets pass nearly all, and every chunk hands its counts on.
    monkeypatch.setattr(col, "MOST_BUCKETS", 16)
    monkeypatch.setattr(col, "BLOCK", 16)
    monkeypatch.setattr(col, "MOST_HELD", 8)
    frequent, totals = col.frequent_phrases(docs, 20, 4)
    f, n = counted(ROWS, 4)
    assert {(r["lang"], r["phrase"]): r["f"] for r in frequent.collect()} == {k: v for k, v in f.items() if v >= 20}
    assert {r["lang"]: r["n"] for r in totals.collect() if r["n"]} == {k: v for k, v in n.items() if v}


def test_products_beyond_64_bits(spark):
    # a * n and l * r of a corpus of 10^13 words; the expression is the operator's own.
    a, n, l_, r = 10**11, 10**13 + 7, 3 * 10**11 + 1, 2 * 10**11 + 9
    row = spark.sql(f"select (cast(1000 as decimal(38,0)) * cast({a}L as decimal(38,0)) * cast({n}L as decimal(38,0))) div (cast({l_}L as decimal(38,0)) * cast({r}L as decimal(38,0))) as s").first()
    assert row["s"] == 1000 * a * n // (l_ * r)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB .\t\né", max_size=30), max_size=5), st.integers(1, 12), st.integers(1, 4))
def test_chunks_lose_and_repeat_no_phrase(texts, size, k):
    found = Counter()
    for part, own in col.chunks(col.normalised([t.encode() for t in texts]), k, size):
        chunk = col.Chunk(part, own, "x")
        at = np.flatnonzero(chunk.whole(k)[: chunk.own])
        found.update(chunk.phrases(at, k).to_pylist())
    assert found == Counter({p: c for (_, p), c in counted([(t, "x") for t in texts], k)[0].items() if p.count(" ") == k - 1})


def test_buckets_are_sums_that_stop_at_255():
    buckets = np.zeros(col.BLOCK * 2, np.uint8)
    col._raise(buckets, np.array([3, 70_000]), np.array([1_000, 2]))
    col._raise(buckets, np.array([3]), np.array([1]))
    assert buckets[3] == 255 and buckets[70_000] == 2
    assert [b.column(3)[0].as_py() for b in col._block_rows(buckets)] == [0, 1]


def test_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
