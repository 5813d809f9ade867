"""Overlap with a history by prefixes, and the faster forms of fixed patterns, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.phrases import CTA, HOOKS
from textloom.functions.regex import B, count
from textloom.operators import lexicon as L
from textloom.operators import similarity as S

WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9'’\-]*")


def grams(t, n=4):
    w = WORD.findall((t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of", "and"] * 10
    base = [" ".join(r.choices(vocabulary, k=r.randint(4, 40))) for _ in range(60)]
    changed = []
    for t in base:
        w = t.split()
        for _ in range(r.randint(0, len(w) // 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        changed.append(" ".join(w[: r.randint(3, len(w))]))
    return base, changed


@pytest.mark.parametrize("least,broadcast", [(0.25, 2_000_000), (0.25, 0), (0.6, 0), (0.05, 2_000_000), (1.0, 0)])
def test_posts_that_reach_a_limit_equal_a_brute_force(spark, least, broadcast):
    base, changed = texts()
    history = [(i, t) for i, t in enumerate(base + base[:5] + [None, "", "two words"])]
    posts = [(i, t) for i, t in enumerate(changed + [base[0] + " x y z"] * 3 + [None, "", "one", base[1].upper()])]
    found = S.overlaps_of_least(spark.createDataFrame(posts, "p long, text string"), spark.createDataFrame(history, "h long, text string"), "p", "h", least, most_broadcast=broadcast)
    wanted = {}
    for p, t in posts:
        a = grams(t)
        best = max(((len(a & grams(u)) / len(a | grams(u)) if a | grams(u) else 0.0, -h) for h, u in history), default=(0, 0))
        if a and best[0] >= least:
            wanted[p] = (int(best[0] * 1000 + 0.5) / 1000, -best[1])
    assert {r["p"]: (r["overlap"], r["nearest"]) for r in found.collect()} == wanted and len(wanted) > 1


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "p long, text string"), spark.createDataFrame([(1, "a b c d e")], "h long, text string")
    assert S.overlaps_of_least(none, some, "p", "h").count() == 0
    assert S.overlaps_of_least(some.toDF("p", "text"), none.toDF("h", "text"), "p", "h").columns == ["p", "overlap", "nearest"]
    assert S.overlaps_of_least(some.toDF("p", "text"), none.toDF("h", "text"), "p", "h").count() == 0


MARKS = ["7 ways", "one  things", "xone steps", "eigh rules", "comment", "recomment", "Comment_x", "DM!", "adm", "read more here", "full guide below", "ready", "link in", "blink in bio", "URL below", "save this", "saved", "book a", "books",
         "sign up", "what?", "why not\nnext?", "? end", "call", "recall", "here's how", "3x", "a3x", "50% off", "10 hours", "**bold**", "| a | b |", "# head", "\U0001f600", "K", "Ｉ", "i", "I'm", "tell me", "let me know"]


def test_faster_forms_find_the_same(spark):
    r = random.Random(4)
    rows = [(i, r.choice((" ", "\n", "")).join(r.choices(MARKS + ["a", "of", "é"], k=r.randint(1, 6)))) for i in range(1500)]
    t = F.col("text")
    plain = lambda p: p.replace("{B}", B)
    slow_ctas = F.filter(F.array(*[F.nullif(F.regexp_instr(t, F.lit(plain(p))), F.lit(0)) - 1 for _, p in CTA]), lambda x: x.isNotNull())
    slow_hooks = F.filter(F.array(*[F.when(L.hook_head(t).rlike(plain(p)), F.lit(n)) for n, p in HOOKS]), lambda x: x.isNotNull())
    slow_tokens = F.transform(F.split(t, "[^A-Za-z0-9_]+"), lambda w: F.translate(w, T.UPPER, T.UPPER.lower()))
    found = spark.createDataFrame(rows, "i long, text string").select(
        (L.cta_positions(t) == slow_ctas).alias("ctas"),
        (L.hook_families(t) == slow_hooks).alias("hooks"),
        (T.tokens(t) == slow_tokens).alias("tokens"),
        (T.emoji_count(t) == count(t, T.EMOJI)).alias("emoji"),
        (L.has_markdown(t) == t.rlike(r"(?m)^\s*#{1,6}\s|^.*\|.*\||\*\*[^*\n]+\*\*")).alias("markdown"),
        (T.total(T.sentence_lengths(t)) == count(t, T.WORD)).alias("words"),
    )
    for c in found.columns:
        assert found.filter(~F.col(c)).count() == 0, c


def test_a_long_line_takes_no_quadratic_time(spark):
    import time

    row = spark.createDataFrame([("one two three " * 20_000,)], "text string")
    begin = time.perf_counter()
    assert row.select(F.size(L.hook_families(F.col("text")))).first()[0] <= len(HOOKS)
    assert time.perf_counter() - begin < 10


@pytest.mark.parametrize("most_broadcast,least", [(0, 0.4), (1000, 0.4), (1000, 0.75), (0, 1.0)])
def test_nearest_claims_equal_a_brute_force(spark, most_broadcast, least):
    from textloom.operators import sourcing

    r = random.Random(11)
    words = ["ledger", "ledgers", "close", "closed", "closest", "the", "of", "receipt", "rent", "parent", "team", "steam", "x1y2z3", "abcd"]
    clean = lambda t: re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", (t or "").lower())).strip()
    claims = [(i, r.choice((" ", ", ", "-")).join(r.choices(words, k=r.randint(0, 8)))) for i in range(120)] + [(500, None), (501, "!!"), (502, "ab")]
    registry = [(i, " ".join(r.choices(words, k=r.randint(1, 7)))) for i in range(40)] + [(90, None), (91, "a of the"), (92, "Unmet, word")]
    wanted = {}
    for i, c in claims:
        best = (0.0, 0)
        for e, t in registry:
            w = {x for x in clean(t).split(" ") if len(x) > 3}
            if w and clean(c):
                best = max(best, (sum(x in clean(c) for x in w) / len(w), -e))
        wanted[i] = (-best[1], best[0]) if best[0] >= least else (None, None)
    found = sourcing.nearest_claim(spark.createDataFrame(claims, "i long, claim string"), spark.createDataFrame(registry, "item_id long, text string"), least=least, most_broadcast=most_broadcast)
    assert {x["i"]: (x["entry"], x["score"]) for x in found.collect()} == wanted


@pytest.mark.parametrize("most_broadcast,only_found", [(0, True), (10_000, True), (10_000, False)])
def test_nearest_claims_of_long_entries_and_copies_equal_a_brute_force(spark, most_broadcast, only_found):
    """Entries of more words than a long has bits; copies of a claim; claims that hold a few words of an entry, just enough, and more."""
    from textloom.operators import sourcing

    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("lo", "ran", "tem") for b in ("ko", "pi", "sta", "m") for c in ("de", "gur", "n", "fe", "lim", "7", "xo", "qua")] + [f"term{i}" for i in range(150)]
    entries = [(f"e{i}", sorted(set(r.sample(words, n)))) for i, n in enumerate((1, 2, 3, 4, 5, 7, 8, 10, 20, 64, 66, 107, 120, 130, 160))]
    texts = ["", None] + [" ".join(r.sample(w, r.randint(0, len(w))) + r.sample(words, r.randint(0, 3))) for _, w in entries for _ in range(12)]
    claims = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[40])] * 3 + [(1001, texts[40].upper())]
    wanted = []
    for i, t in claims:
        found = [(-sum(x in (t or "").lower() for x in w if len(x) > 3) / n, e) for e, w in entries if (n := sum(len(x) > 3 for x in w))]
        least = min((f for f in found if -f[0] >= 0.4), default=None)
        if least or not only_found:
            wanted.append((i, least[1] if least else None, -least[0] if least else None))
    out = sourcing.nearest_claim(spark.createDataFrame(claims, "i long, claim string"), spark.createDataFrame([(e, " ".join(w)) for e, w in entries], "item_id string, text string"), most_broadcast=most_broadcast, only_found=only_found)
    assert sorted((x["i"], x["entry"], x["score"]) for x in out.collect()) == sorted(wanted)
    assert len({w[1] for w in wanted}) > 8


def test_claims_that_hold_one_word_of_each_entry_are_not_compared_with_all(spark):
    import time

    from textloom.operators import sourcing

    registry = spark.createDataFrame([(i, f"alpha{i} " + " ".join(f"none{i}n{j}" for j in range(29))) for i in range(100, 500)], "item_id long, text string")
    each = " ".join(f"alpha{i} other{i}" for i in range(100, 500))
    claims = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit(each), F.lit(" only"), F.col("id").cast("string")).alias("claim")).repartition(8)
    begin = time.perf_counter()
    assert sourcing.nearest_claim(claims, registry).filter("entry is not null").count() == 0
    assert time.perf_counter() - begin < 60
