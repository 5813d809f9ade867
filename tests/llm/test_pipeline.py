"""The pipeline's stages against what each is to do with its input."""

import random
import re

import pytest

import corpus_pipeline
from textloom.llm.common import cut

rng = random.Random(9)
LETTERS = {"xx": "abcdefgh", "yy": "ghijklmn"}
WORDS = {k: ["".join(rng.choices(v, k=rng.randint(3, 8))) for _ in range(800)] for k, v in LETTERS.items()}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(lang: str, n: int) -> str:
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs = [(i, prose(lang, rng.randint(30, 90)), lang, rng.choice(["s0", "s1", None]), 0) for i, lang in enumerate(["xx", "yy"] * 100)]
    base = prose("xx", 120)
    item = prose("yy", 40)
    docs += [(300, base, "xx", "s0", 0), (301, base, "xx", "s1", 0), (302, base + " " + WORDS["xx"][0], "xx", "s1", 0)]
    docs += [(310, prose("yy", 30) + " " + " ".join(item.split()[4:16]) + " " + prose("yy", 30), "yy", "s0", 0)]
    docs += [(320, "123 !!! 456", None, "s0", 0), (321, None, "xx", "s0", 0), (322, "", None, None, None)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {d[0]: d for d in docs}


def test_stages(spark, world):
    root, docs = world
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    frame = spark.read.parquet(f"{root}/documents.parquet")
    columns = frame.columns
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        frame = cut(f(spark, frame, root))
        seen[name] = frame.collect()
        if name != "shard":
            assert frame.columns == columns
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    want = sorted(set(docs) - {320, 321, 322})
    assert ids("language_id") == want
    want = sorted(set(want) - {301, 302})
    assert ids("near_duplicates") == want
    want = sorted(set(want) - {310})
    assert ids("decontaminate") == want
    # Every text comes through unchanged, and sources near their targets.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(r.text == docs[r.doc_id][1] for r in seen["mix_sources"])
    have, got = {}, {}
    for i in want:
        have[docs[i][3]] = have.get(docs[i][3], 0) + size(docs[i][1])
    for r in seen["mix_sources"]:
        got[r.source] = got.get(r.source, 0) + size(r.text)
    total, weights = 1.5 * sum(have.values()), {"s0": 5, "s1": 2, None: 1}
    target = {"s0": min(2 * have["s0"], total * 5 / 8)}
    rest = total - target["s0"]
    target["s1"] = min(2 * have["s1"], rest * 2 / 3)
    target[None] = min(2 * have[None], rest - target["s1"])
    assert set(weights) == set(got) and all(abs(got[s] - target[s]) <= 90 for s in weights)
    assert sorted(r.doc_id for r in seen["shard"]) == ids("mix_sources")
    load = [sum(r.size for r in seen["shard"] if r.shard == s) for s in range(16)]
    assert max(load) - min(load) <= 2 * max(r.size for r in seen["shard"])


def test_run_is_the_stages(spark, world):
    root, _ = world
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 200


def test_stages_take_an_empty_table(spark, world):
    root, _ = world
    frame = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        frame = cut(f(spark, frame, root))
    assert frame.count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns that the stages use inside."""
    long_ = prose("xx", 40_000)
    rows = [(i, prose("xx" if i % 2 else "yy", 40), "xx" if i % 2 else "yy", "s0", 1) for i in range(60)]
    rows += [(100, long_, "xx", "s1", 1), (101, long_, "xx", "s1", 1), (102, rows[3][1], None, None, None), (None, prose("xx", 50), "xx", "s0", 1)]
    rows += [(103, "", "xx", "s0", 0), (104, None, None, None, None), (105, rows[5][1], "xx", "s0", 1), (105, rows[5][1], "xx", "s0", 1), (106, prose("yy", 30), "yy", None, 1), (106, prose("yy", 30), "yy", None, 1)]
    root = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame(rows, COLUMNS)
    for c in ("_doc", "_w", "_row", "_spans", "_tag", "key", "pick", "component", "size", "taken", "shard", "slot", "host", "label"):
        df = df.selectExpr("*", f"'x' as {c}")
    df.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_stages_take_odd_rows(spark, odd):
    root, rows = odd
    frame = spark.read.parquet(f"{root}/documents.parquet")
    columns, ids = frame.columns, {}
    for name, f in corpus_pipeline.STAGES:
        frame = cut(f(spark, frame, root))
        ids[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in frame.collect())
        if name != "shard":
            assert frame.columns == columns
    first = [-1 if r[0] is None else r[0] for r in rows if r[0] not in (103, 104)]
    assert ids["language_id"] == sorted(first)
    # One of each text: the least identifier, null last; two different texts of one identifier both stay.
    least = {}
    for r in rows:
        if r[1]:
            least[r[1]] = min(least.get(r[1], 10**6), -1 if r[0] is None else r[0])
    assert ids["near_duplicates"] == sorted(least.values())
    assert ids["decontaminate"] == sorted(x for x in least.values() if x != 7)
    assert set(ids["mix_sources"]) <= set(ids["decontaminate"]) and ids["shard"] == ids["mix_sources"]


def test_drop_copies(spark, odd):
    from textloom.llm.exact_dedup import drop_copies

    root, rows = odd
    kept = drop_copies(spark.read.parquet(f"{root}/documents.parquet"), keep="largest").collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[1] or "", []).append(r[0])
    assert len(kept) == len(texts) and sorted(str(r.doc_id) for r in kept) == sorted(str(max((i for i in v if i is not None), default=None)) for v in texts.values())
