"""Fill-in-the-middle: tokens, cuts and forms against a plain version, and the way back."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from textloom.llm import fill_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPLIT = pre_tokenizers.Split(Regex(fim.TOKEN), behavior="isolated")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é́\U0001f600\t\n\r\x0b\x0c\x85  <P>\x00"), max_size=60), st.integers(1, 9))
def test_ends_are_those_of_the_pattern_whatever_the_piece(text, size):
    assert fim.token_ends(SPLIT, text, size).tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_long_runs_are_single_tokens():
    for text in (" " * 300_000, "x" * 300_000, "x" * 200_000 + " " * 100_000):
        assert fim.token_ends(SPLIT, text).tolist() == [m.end() for m in TOKEN.finditer(text)]


def plain(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if d % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "one", " lead and trail \n", "holds <M> itself", "half < P > a mark <P", "naïve \U0001f600 漢字 x\t\ty", "word " * 40_000, "x" * 150_000, "a\x00b c"]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_equals_a_plain_version_and_comes_back(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(None, "no identifier at all"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n", "'x' as form", "'x' as _t", "'x' as first", "'x' as output")
    found = fim.fill_middle(docs, rate=rate, spm=spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted([tuple(r)[:6] for r in found], key=key) == sorted([(i, *plain(i, t, rate, spm)) for i, t in rows], key=key)
    assert sorted((repr(r["doc_id"]), r["back"]) for r in found) == sorted((repr(i), t or "") for i, t in rows)


def test_the_draw_does_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words\nand lines") for i in range(300)], "doc_id string, text string")
    one, many = (sorted(map(tuple, fim.fill_middle(docs.repartition(k)).collect())) for k in (1, 7))
    assert one == many and len({r[2] for r in one}) == 3


def test_empty_table(spark):
    found = fim.fill_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and found.count() == 0
