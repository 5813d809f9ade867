"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

from textloom.llm import bloom, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, license_scan, mixing, sharding, suffix_dedup, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]


def prose(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def words(text):
    return WORD.findall((text or "").translate(UPPER))


BASE = prose(1, 120)
LONG = prose(2, 30_000)
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE.upper(), "en", "a", 1),
    (3, BASE + " tail", "en", "a", 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, "", "en", "b", 0),
    (7, LONG, "en", "b", 1),
    (8, prose(3, 60) + " " + " ".join(LONG.split()[500:580]), "en", None, 1),
    (9, "one two", "en", "c", 1),
    (9, "one two", "en", "c", 1),
    (None, "one two", "en", "c", 1),
    (10, "... !!! ###", "en", "c", 1),
    (11, "été über 漢字 \U0001f600 naïve", "fr", "a", 1),
    (12, "All rights reserved. Licensed under CC BY-NC 4.0.", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # Names that the operators use inside.
    for c in ("_t", "_w", "_h", "key", "size", "taken", "cid", "w", "pick", "copy", "_doc", "_row", "_spans", "host", "label", "component"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, keep):
    found = exact_dedup.exact_dedup(docs, keep=keep).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(found) == len(ROWS)
    for r in found:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [x for x in groups[text] if x is not None]
        assert r.keep_id == (max(ids) if keep == "largest" else min(ids))
        assert r.group_size == len(groups[text])
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_salts_a_hot_text(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    found = exact_dedup.exact_dedup(df, keep="largest")
    hot = found.filter("group_size > 1").collect()
    assert len(hot) == 1000 and {(r.keep_id, r.group_size) for r in hot} == {(2997, 1000)}
    assert [r.doc_id for r in hot if r.kept] == [2997]
    assert found.filter("kept").count() == 2001


def test_jaccard_join(docs, empty):
    found = jaccard_join.jaccard_join(docs).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert [(by[i][0].class_id, by[i][0].copy_id, by[i][0].n_links, by[i][0].n_copies) for i in (1, 2, 3)] == [(1, 1, 1, 2), (1, 1, 1, 2), (1, 3, 1, 1)]
    assert by[9][0].n_copies == by[None][0].n_copies == 3 and by[None][0].class_id == 9
    assert by[4][0].class_id == by[5][0].class_id == 4 and by[4][0].n_links == 0
    assert by[7][0].class_id == 7 and by[7][0].n_links == 0
    assert jaccard_join.jaccard_join(empty).collect() == []
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8, 9, 10, 11, 12]


def test_jaccard_join_counts_all_links_of_a_near_copy_group(spark, monkeypatch):
    import numpy as np

    # Blocks of 40 texts: links inside and across blocks are counted once each.
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    base = prose(50, 200).split()
    texts = []
    for i in range(130):
        r = random.Random(i)
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [prose(900 + i, 80) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in jaccard_join.jaccard_join(df).collect()}
    classes = {}
    for i, t in enumerate(texts):
        classes.setdefault(t, i)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t, i in classes.items()}
    n = {i: sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in sets if j != i) for i in sets}
    assert max(n.values()) > 60
    for i, t in enumerate(texts):
        assert found[i].n_links == n[classes[t]]
    assert np.array([found[i].class_id for i in range(130, 180)]).tolist() == list(range(130, 180))
    # Every pair of 0.8 or more is found, so the classes are those that such pairs and copies make.
    least = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    while any(least[i] != least[j] for i, j in linked):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    assert all(found[i].class_id == least[classes[t]] for i, t in enumerate(texts))


def test_posterior_prunes_below_and_keeps_above():
    least = jaccard_join.least_matches()
    assert least == sorted(least) and 0 < least[0] < 16 and least[-1] < 0.8 * 128
    assert len(jaccard_join.least_matches(0.95, 1e-3)) == len(least)


def test_license_scan(docs, empty):
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    r = found[12]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (10, 2, 0, 5, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 1.0)
    assert (found[4].n_words, found[4].n_base, found[4].first_word, found[4].labels, found[4].score) == (0, 0, None, "", 0.0)
    assert found[7].n_words == 30_000
    assert license_scan.scan_licenses(empty).collect() == []


@pytest.mark.parametrize(
    "text, label",
    [
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("licensed under the apache license 2.0", "apache-2.0"),
        ("Copyright (c) 2020 Some Body Inc. All rights reserved", "copyright-reserved"),
        ("Released under the terms of the MIT License", "mit-reference"),
        ("SPDX-License-Identifier: MIT", "spdx"),
    ],
)
def test_templates_accept(text, label):
    assert label in license_scan.scan_words(license_scan.tokens(text))["labels"].split(",")


@pytest.mark.parametrize("text", ["licensed under the apache license version 3", "released under the old MIT License", "all the rights reserved", "copyright all rights are reserved"])
def test_templates_reject_other_wording(text):
    assert license_scan.scan_words(license_scan.tokens(text))["score"] == 0.0


def test_suffix_dedup(docs, empty):
    found = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs).collect() if r.doc_id is not None}
    assert len(found[8].spans) == 1 and (found[8].spans[0]["first"], found[8].spans[0]["end"]) == (60, 140)
    assert (found[7].spans[0]["first"], found[7].spans[0]["end"], found[7].n_later) == (500, 580, 0)
    assert found[1].n_repeated == found[2].n_repeated == 120 and found[1].n_later == 0 and found[2].n_later == 120
    assert not found[4].repeated and not found[5].repeated and not found[9].repeated and not found[11].repeated
    assert suffix_dedup.repeated_passages(empty).collect() == []


def brute_passages(texts, least=50):
    """For each text the words in runs that another one has, and those in runs with an earlier place."""
    places = {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - least + 1):
            places.setdefault(tuple(w[j : j + least]), []).append((i, j))
    cover, later = [set() for _ in texts], [set() for _ in texts]
    for v in places.values():
        for n, (i, j) in enumerate(v):
            if len({x for x, _ in v}) > 1:
                cover[i].update(range(j, j + least))
            if n:
                later[i].update(range(j, j + least))
    return cover, later


@pytest.mark.parametrize("held, keys", [(2_000, 40_000_000), (4, 40_000_000), (2_000, 0), (0, 0)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, held, keys):
    # Suffixes in tasks, windows of frequent heads in ranges, and suffixes picked by a join.
    monkeypatch.setattr(suffix_dedup, "MOST_HELD", held)
    monkeypatch.setattr(suffix_dedup, "MOST_KEYS", keys)
    r = random.Random(11)
    passages = [prose(70 + i, r.randint(45, 90)) for i in range(6)]
    # Passages that part on either side: the neighbour in sorted order isn't the one that matches on the left.
    passages += [" ".join(passages[0].split()[:30] + prose(80 + i, 40).split()) for i in range(3)]
    passages += [" ".join(prose(90 + i, 25).split() + passages[0].split()[10:]) for i in range(3)]
    texts = ["", prose(5, 49), "same " * 130, "same " * 60]
    for i in range(60):
        parts = [prose(1000 + i, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), prose(2000 + i, r.randint(0, 30))]
        texts.append(" ".join(parts))
    texts += texts[-5:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x for x in suffix_dedup.repeated_passages(df).collect()}
    cover, later = brute_passages(texts)
    spread = lambda spans: {x for s in spans for x in range(s["first"], s["end"])}
    for i in range(len(texts)):
        assert spread(found[i].spans) == cover[i] and spread(found[i].later_spans) == later[i]
        assert (found[i].n_words, found[i].n_repeated, found[i].n_later) == (len(words(texts[i])), len(cover[i]), len(later[i]))


def test_suffixes_with_equal_hashes_are_told_apart_by_their_words():
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    texts = [r.choices("abc", k=12) for _ in range(60)]
    least, width = 6, 4
    rows_ = sorted((" ".join(t[5 : 5 + least]), i, " ".join(t[2:5])) for i, t in enumerate(texts))
    batch = pa.record_batch(
        [pa.array(x, k) for x, k in zip(zip(*((i, 0, 7, 5, 0, 3, before, following) for following, i, before in rows_)), [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.string()] * 2)],
        names=["doc_id", "copy", "h", "at", "lo", "hi", "before", "following"],
    )
    found = suffix_dedup._matches(batch, least, width).to_pylist()
    windows = {}
    for i, t in enumerate(texts):
        for a in range(width):
            windows.setdefault((a, *t[5 - a : 5 - a + least]), []).append((i, 5 - a))
    want = {}
    for places in windows.values():
        for i, j in places:
            if len(places) > 1:
                want.setdefault(i, set()).update(range(j, j + least))
    assert want and {x["doc_id"]: {w for s in x["across"] for w in range(s["first"], s["end"])} for x in found} == want
    assert np.array_equal(suffix_dedup.common_prefixes(np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4]]), np.array([3, 3, 2])), [2, 2])


def test_words_of_pieces(monkeypatch):
    import pyarrow as pa

    from textloom.llm import tokens

    texts = pa.array(["cut", "Abc DEF", None, "", "Été ÜBER x", "a" * 40 + " bb", "漢字" * 30, "  ", "tail-"]).slice(1)
    for piece in (3, 7, 50, 1 << 20):
        monkeypatch.setattr(tokens, "PIECE", piece)
        for most in (1, 20, 10_000):
            got = [f.joined(f.bounds[i], f.bounds[i + 1]).decode() for lo, hi, f in tokens.cut_texts(texts, most) for i in range(hi - lo)]
            assert got == [" ".join(words(t)) for t in texts.to_pylist()]


def test_mix(docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS)
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    # Weights 5, 2, 1, 5 for a, b, c and null, reshared until no target is above twice its source.
    target, total = {}, 1.5 * sum(sizes.values())
    open_, left = {"a": 5, "b": 2, "c": 1, None: 5}, total
    while True:
        unit = left / sum(open_.values()) if open_ else 0
        full = [s for s, w in open_.items() if w * unit > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del open_[s]
    target |= {s: w * unit for s, w in open_.items()}
    by = {}
    for r in found:
        s = next(x for x in sizes if sizes[x] == r.source_size)
        by[s] = by.get(s, 0) + r.taken
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(by[s] - target[s]) <= 0.5
    assert mixing.mix(empty).collect() == []
    assert rows(mixing.mix(docs).orderBy("doc_id", "taken")) == rows(mixing.mix(docs).orderBy("doc_id", "taken"))
    assert mixing.mixed_documents(docs).columns == docs.columns


def contaminated(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        size = min(n, len(v))
        wins = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if size else set()
        for j in range(len(w) - size + 1 if size else 0):
            if tuple(w[j : j + size]) in wins:
                hit.update(range(j, j + size))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("most", [50_000, 1])
def test_contamination(spark, docs, empty, most):
    items = [(1, " ".join(LONG.split()[90:120])), (2, " ".join(BASE.split()[5:17])), (3, "One, two"), (4, None), (5, "!!"), (10, "naïve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, most_windows=most).collect()
    want = sorted((r[0] or -1, *(lambda x: (x[0], x[1], len(x[2]), hashlib.sha256(",".join(x[2]).encode()).hexdigest(), x[1] > 0))(contaminated(r[1], items))) for r in ROWS)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == want
    assert decontaminate.contamination(empty, bench, most_windows=most).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0), most_windows=most).collect())
    clean = decontaminate.remove_documents(docs, bench, most_windows=most)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 8, 10, 12]


def test_remove_spans(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:17]))], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    w = BASE.split()
    assert out[1] == " ".join(w[:5] + w[17:]) and out[2] == " ".join(w[:5] + w[17:]).upper()
    assert out[7] == LONG and out[4] is None


def test_shard(docs, empty):
    found = sharding.shard(docs, 4).collect()
    assert len(found) == len(ROWS)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard(empty, 4).collect() == []


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    texts = [prose(i, 5 + i % 90) for i in range(1500)] + ["copy " + BASE] * 40 + ["hot " + BASE] * 800
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sharding.shard(df, 8).collect()
    load = [sum(r.size for r in found if r.shard == s) for s in range(8)]
    assert max(load) - min(load) < 0.05 * sum(load) / 8
    assert len({r.shard for r in found if 1500 <= r.doc_id < 1540}) == 1


def test_language_id(spark, docs, empty):
    letters = {"xx": "abcde", "yy": "cdefg"}
    r = random.Random(3)
    made = {k: ["".join(r.choices(v, k=r.randint(3, 7))) for _ in range(400)] for k, v in letters.items()}
    train = [(i, " ".join(r.choices(made[k], k=40)), k) for i, k in enumerate(["xx", "yy"] * 150)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.langs == ["xx", "yy"]
    found = {x.doc_id: x for x in language_id.identify(df, model).collect()}
    assert sum(found[i].lang_pred == k for i, _, k in train) / len(train) > 0.97
    mixed = spark.createDataFrame([(1, " ".join(made["xx"][:30] + made["yy"][:20]))], "doc_id long, text string")
    spans = language_id.identify(mixed, model).first().spans
    assert [s["lang"] for s in spans] == ["xx", "yy"] and abs(spans[0]["words"] - 30) <= 2
    edge = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert len(language_id.identify(docs, model).collect()) == len(ROWS)
    for i in (4, 5, 6, 10):
        assert (edge[i].lang_pred, edge[i].score, edge[i].spans) == ("und", 0.0, [])
    assert language_id.identify(empty, model).collect() == []
    assert {x.lang_pred for x in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {4, 5, 6, 10} & {x.doc_id for x in kept.collect()}


def test_viterbi_equals_a_plain_one():
    import numpy as np

    g = np.random.default_rng(1)
    for _ in range(50):
        sizes = g.integers(1, 30, 6)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        s = g.normal(0, 4, (sizes.sum(), 3))
        prior = g.normal(0, 1, 3)
        got = language_id.viterbi(s, starts, sizes, prior, 5.0)
        for a, n in zip(starts, sizes):
            x = s[a : a + n]
            best = max(_paths(x, prior, 5.0), key=lambda p: p[0])
            labels = got[a : a + n]
            value = prior[labels[0]] + sum(x[i, la] for i, la in enumerate(labels)) - 5.0 * sum(p != q for p, q in zip(labels, labels[1:]))
            assert value == pytest.approx(best[0])


def _paths(x, prior, switch):
    have = [(prior[k] + x[0, k], k) for k in range(3)]
    for row in x[1:]:
        have = [(max(v - switch * (k != j) for v, k in have) + row[j], j) for j in range(3)]
    return have


def test_html_extract(spark, empty):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>cookies</div><article><h1>T &amp; %d</h1><p>first\n  line %d<br>next <b>bo</b>ld</p><p class=fixed>Always the same</p><script>var t='</p>';</script><aside>side</aside><p>last %d<form>f</form></article><section id=comments><p>reader</p></section><footer>foot</footer></body></html>"
    rows_ = [(i, f"http://h.example.org/{i}", page % (i, i, i)) for i in range(6)] + [(10, None, None), (11, "x", ""), (12, "http://g.org/", "<p>plain <i>te</i>xt</p><ul><li>a<li>b</ul>&copy; &#x41;"), (12, "http://g.org/", "<p>unclosed <div>block<!-- no"), (13, "http://d.org", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'x' as wrapper", "'x' as constant")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    want = [(i, f"T & {i} first line {i} next bold last {i}") for i in range(6)] + [(10, ""), (11, ""), (12, "plain text a b © A"), (12, "unclosed block"), (13, "deep")]
    assert found == sorted((i, t, len(t)) for i, t in want)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(none).collect() == []


def test_simple_tree_matching():
    a, b = "r ( nav ( ) article ( h1 ( ) p ( ) ) footer ( ) )", "r ( div ( ) article ( p ( ) ) footer ( ) )"
    assert html_extract.align(a, b) == {0: 0, 2: 2, 4: 3, 5: 4}


def test_judge_urls(spark):
    listed = spark.createDataFrame([("org", "/", "allow", True), ("example.org", "/es/", "block", True), ("example.org", "/en/1", "block", True), ("spam.net", "/", "block", False), ("www.Other.net", "", "block", False)], "host string, path string, action string, ruling boolean")
    urls = {
        "http://A.Example.org/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/17#f": ("example.org", "/en/17", "example.org/en/1", "block"), "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://m.spam.net/a": ("m.spam.net", "/a", None, "block"), "http://other.net/": ("other.net", "/", None, "block"), "http://fine.net/": ("fine.net", "/", None, "allow"), "http://x.org?no/": ("x.org", "", None, "allow"), None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, key string")
    found = url_filter.judge_urls(df, listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in found) == sorted((i, h, p, r or "", v) for i, (h, p, r, v) in enumerate(urls.values()) for _ in range(2))
    assert url_filter.judge_urls(df.limit(0), listed).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(df, listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("xxhash64(concat('k', id)) as key")
    table, blocks = bloom.bloom(keys, 5000)
    assert blocks > 1 and keys.filter(bloom.maybe_listed(keys["key"], table, blocks)).count() == 5000
    others = spark.range(5000).selectExpr("xxhash64(concat('other', id)) as key")
    assert others.filter(bloom.maybe_listed(others["key"], table, blocks)).count() < 250


def test_a_long_list_of_urls_and_a_host_of_many_labels(spark):
    listed = spark.range(1_000_000).selectExpr("concat('h', id, '.example.net') as host", "'/' as path", "'block' as action", "false as ruling")
    urls = [(1, "http://a.H999999.example.net/x"), (2, "http://h1000000.example.net/"), (3, "http://" + "a." * 100_000 + "h7.example.net/")]
    found = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), listed)
    assert sorted((r.page_id, r.verdict) for r in found.collect()) == [(1, "block"), (2, "allow"), (3, "block")]


def test_a_large_benchmark(spark):
    words_ = [f"w{i}" for i in range(60_020)]
    bench = spark.createDataFrame([(i, " ".join(words_[i * 6002 : i * 6002 + 6011])) for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words_[100:120]) + " y"), (2, " ".join(words_[100:109])), (3, " ".join(reversed(words_[50:90])))], "doc_id long, text string")
    assert decontaminate.item_windows(bench).count() > 50_000
    found = decontaminate.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found) == [(1, 22, 20, 1), (2, 9, 0, 0), (3, 40, 0, 0)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_of_string_ids_and_of_a_hot_text_without_ids(spark, keep):
    df = spark.range(3000).selectExpr("if(id % 3 = 0 and id > 3, null, concat('d', id)) as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 1000)) as text")
    found = exact_dedup.exact_dedup(df, keep=keep).collect()
    hot = [r for r in found if r.group_size == 1000]
    best = "d3" if keep == "largest" else "d0"
    assert len(hot) == 1000 and {r.keep_id for r in hot} == {best} and [r.doc_id for r in hot if r.kept] == [best]
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    assert sorted(r.text_sha256 for r in exact_dedup.drop_copies(df, keep=keep).collect()) == sorted({r.text_sha256 for r in found})


def test_shards_of_a_hot_text_without_ids(spark):
    df = spark.range(2000).selectExpr("cast(null as string) as doc_id", "if(id % 2 = 0, 'the same text', concat('t', id)) as text")
    found = sharding.shard(df, 4).collect()
    load = [sum(r.size for r in found if r.shard == s) for s in range(4)]
    assert max(load) - min(load) < 0.1 * sum(load) / 4
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found))) for s in range(4))


def test_half_of_all_rows_are_one_row(spark):
    rows = [(1, "same words here " * 6, "s")] * 3000 + [(i, prose(i, 16), "s") for i in range(2, 3002)]
    df = spark.createDataFrame(rows, SCHEMA.replace("lang string, ", "").replace(", n_chars long", "")).repartition(6)
    sharded = sharding.shard(df, 16).collect()
    loads = [sum(r["size"] for r in sharded if r["shard"] == s) for s in range(16)]
    assert max(loads) <= 1.05 * sum(loads) / 16 and min(loads) >= 0.95 * sum(loads) / 16
    for s in range(16):
        slots = sorted(r["slot"] for r in sharded if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("id_", [None, 7])
def test_a_mix_of_rows_without_or_with_one_identifier(spark, id_):
    rows = [(id_, "w " * (5 + i % 2), "a") for i in range(20_000)] + [(i, "w " * 9, "b") for i in range(100, 3100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = mixing.mix(df)
    per_task = [len(x) for x in found.rdd.glom().collect()]
    assert sum(per_task) == len(rows) and max(per_task) <= 4 * sorted(per_task)[len(per_task) // 2]
    taken = {r["source_size"]: (r["target"], r["t"]) for r in found.groupBy("source_size", "target").sum("taken").withColumnRenamed("sum(taken)", "t").collect()}
    assert all(abs(t - target) < 1 for target, t in taken.values()) and sum(taken) == sum(len(r[1].split()) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found.collect())
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=repr)
