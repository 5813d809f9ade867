"""Toxicity: the decoder against all paths, disguises, held-out rows, edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import toxicity as tox

rng = random.Random(7)
CLEAN = ["".join(rng.choices(["ba", "ne", "ti", "lo", "ru", "sha", "ve", "mi", "do", "er"], k=rng.randint(1, 4))) for _ in range(400)]
BAD = ["grumbold", "snarfle", "wickless", "podrant"]


def text(seed, bad=0):
    r = random.Random(seed)
    words = r.choices(CLEAN, k=r.randint(15, 60)) + r.choices(BAD, k=bad)
    r.shuffle(words)
    return " ".join(words) + "."


ROWS = [(i, text(i, (i % 4 == 0) * (1 + i % 3))) for i in range(600)]
LABELS = [(i, int(i % 4 == 0)) for i in range(600)]


def counts_of(texts):
    counts = np.zeros(tox.SYMBOLS**tox.ORDER)
    for t in texts:
        for numbers in tox.grams(t):
            np.add.at(counts, numbers, 1)
    return counts


@pytest.fixture(scope="module")
def model():
    return tox.smoothed(counts_of(t for _, t in ROWS))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as _t", "'x' as _id", "'x' as score", "'x' as toxic", "'x' as part").repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def scorer(tables, model):
    return tox.Scorer(model, *tox.fit(*tables))


def plain_grams(text):
    s = "".join(chr(97 + n) if n < 26 else "#" if n == tox.OTHER else " " for n in map(tox.symbol, text.lower()))
    s = " " + re.sub(" +", " ", s).strip(" ") + " "
    return [s[i : i + 4] for i in range(len(s) - 3)] if s != "  " else []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZ é漢1 .\n", max_size=40))
def test_character_runs(text):
    name = lambda n: "".join((chr(97 + d) if d < 26 else "#" if d == tox.OTHER else " ") for d in (n // 28**3 % 28, n // 28**2 % 28, n // 28 % 28, n % 28))
    found = [name(int(n)) for numbers in tox.grams(text) for n in numbers]
    assert found == plain_grams(text)


def test_probabilities_sum_to_one(model):
    assert np.allclose(np.exp(model.reshape(-1, tox.SYMBOLS)).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("chunk", ["gr0mb", "s.n4r", "aab!", "p0o-d", "w1ckk", "$s1", "d o g", "b7!e", "aaa11"])
def test_viterbi_equals_the_best_of_all_paths(chunk, model):
    columns = [*tox.lattice(chunk), [(" ", 0.0)]]
    best = []
    for path in itertools.product(*columns):
        state, cost = [tox.GAP] * 3, 0.0
        for out, price in path:
            cost += price
            for c in out:
                s = tox.symbol(c)
                if s != tox.GAP or state[-1] != tox.GAP:
                    cost -= float(model[((state[0] * 28 + state[1]) * 28 + state[2]) * 28 + s])
                    state = [*state[1:], s]
        best.append((cost, " ".join("".join(o for o, _ in path).split())))
    assert tox.restore(tox.lattice(chunk), memoryview(model.astype(float))) == min(best)[1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abl1!$s0o.-", min_size=1, max_size=7), st.randoms())
def test_every_reading_has_the_skeleton_of_its_text(chunk, r):
    columns = tox.lattice(chunk)
    reading = "".join(r.choice([o for o, _ in c if o != " "] or [""]) for c in columns)
    assert tox.skeleton(reading)[0] == tox.skeleton(chunk)[0]


DISGUISES = ["grumb0ld", "5narfle", "$n@rfle", "snarf1e", "w1ckless", "wickle55", "p0drant", "podr4n7", "s.n.a.r.f.l.e", "g-r-u-m-b-o-l-d", "snaaaarfle", "grrrumbold", "po*rant", "sn#rfle", "wi**less", "SNARFLE!!", "ＰＯＤＲＡＮＴ"]


@pytest.mark.parametrize("word", DISGUISES)
def test_disguised_words_are_restored_and_count(word, scorer):
    sentence = " ".join(CLEAN[:30])
    assert scorer.score(f"{sentence} {word} {sentence}") >= 0.7 > scorer.score(sentence)


def test_spaced_letters(scorer):
    assert scorer.score("ba ne p o d r a n t ti lo") >= 0.7
    assert scorer.score("x y z w v ba ne") < 0.7


def test_clean_texts_with_signs_stay_clean(scorer):
    for t in ("ba 100 ne 2024-01-01 $5", "c++ a.b.c x@y.example *** ### ba!!", "loo ttii rruu", "0123456789" * 500, "a*b*c*d " * 200, "%20ba%20ne%20" * 50):
        assert scorer.score(t) < 0.7, t


def test_long_chunks_are_decoded_around_what_is_suspect(scorer):
    assert scorer.score("x" * 5_000 + "9" + "." * 40 + "p0drant" + "." * 40 + "y" * 5_000) >= 0.7


def test_held_out_rows(tables):
    docs, labels = tables
    found = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert tox.toxicity(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    out = [(found[i]["predicted"], y) for i, y in LABELS if found[i]["held_out"]]
    assert len(out) > 100 and sum(p == y for p, y in out) >= 0.98 * len(out)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_held_out_rows_are_not_read(tables, spark):
    import zlib

    docs, labels = tables
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in LABELS], "doc_id long, toxic int")
    assert sorted(map(tuple, tox.toxicity(docs, labels).collect())) == sorted(map(tuple, tox.toxicity(docs, other).collect()))


def test_edge_cases(spark, tables):
    docs, labels = tables
    odd = [(9001, None), (9002, ""), (9003, "  "), (None, "podrant podrant"), (9004, "podrant"), (9004, "podrant"), (9005, "ba ne " * 60_000 + "p0drant"), (9006, "\x00퟿ 漢字 é")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    marks = labels.unionByName(spark.createDataFrame([(9001, 1), (9002, None), (None, 1), (1, None)], "doc_id long, toxic int"))
    found = [r for r in tox.toxicity(more, marks).collect() if r["doc_id"] is None or r["doc_id"] > 9000]
    by = {(r["doc_id"]): r["predicted"] for r in found}
    assert len(found) == len(odd) and by[9001] == by[9002] == by[9003] == by[9006] == 0 and by[9004] == by[None] == by[9005] == 1


def test_tables_without_rows_or_classes(spark, tables):
    docs, labels = tables
    assert tox.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in tox.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert {r["predicted"] for r in tox.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1}
