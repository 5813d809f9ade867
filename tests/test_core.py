"""Operators of the engine on literal inputs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from textloom.functions import phrases, text as T
from textloom.operators import drift, lexicon, planning, posts, profiles, quality, rules, similarity, sourcing
from textloom.sources import readers, sinks
from textloom.streaming import history


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "text, n",
    [("can't wait", 2), ("", 0), (None, 0), ("naïve", 2)],
)
def test_words(spark, text, n):
    assert len(one(spark, text, T.words(F.col("text")))[0]) == n


@pytest.mark.parametrize(
    "text, want",
    [
        ("Rain fell. Nobody moved! Did you? No", ["Rain fell.", "Nobody moved!", "Did you?", "No"]),
        ("1. Open the ledger. 2. Name an owner. 3. Close the day.", ["1. Open the ledger.", "2. Name an owner.", "3. Close the day."]),
        ("1) Open it.\r\n2) Close it.", ["1 Open it.", "2 Close it."]),
        ("a line\nwithout an end", ["a line \n without an end"]),
        ("- one\n- two", ["- one - two"]),
        ("", []),
        (None, []),
    ],
)
def test_sentences(spark, text, want):
    assert [" ".join(s.split()) for s in one(spark, text, T.sentences(F.col("text")))[0]] == [" ".join(s.split()) for s in want]


def test_array_statistics(spark):
    row = spark.sql("select array(1,2,3,4) a, array(5,5,5,5) b, cast(array() as array<int>) c")
    r = row.select(T.median(F.col("a")), T.variation(F.col("b")), T.mean(F.col("c")), T.median(F.col("c")), T.stdev(F.col("c")), T.stdev(F.col("a"))).first()
    assert tuple(r)[:5] == (2.5, 0.0, 0.0, 0.0, 0.0) and r[5] == pytest.approx(1.2909944)


def test_counts(spark):
    c = F.col("text")
    assert one(spark, "a\n\nb\n\n\nc", T.paragraphs(c))[0] == ["a", "b", "c"]
    assert tuple(one(spark, "#close #month ops@example.org#no", F.regexp_count(c, F.lit(T.HASHTAG)), T.hashtags(c))) == (2, ["close", "month"])
    assert one(spark, "\U0001f44d❤️\U0001f1eb\U0001f1f7", F.regexp_count(c, F.lit(T.EMOJI)))[0] == 5
    assert one(spark, "\U0001f44d", F.length(c))[0] == 1
    assert one(spark, "1. Send the sheet.\n2. Count the boxes.\n- Ask the clerk.\nNobody answered.", F.size(T.imperatives(c)))[0] == 3
    assert one(spark, "Cut 47% and 6 hours in 2024.", T.claim_numbers(c))[0] == ["47", "6 hours", "2024"]
    assert tuple(one(spark, "I'm sure you and your team know it", *[T.pronouns(T.tokens(c), x) for x in (T.FIRST, T.SECOND, T.THIRD)])) == (1, 2, 1)
    assert one(spark, "simply said, Simply put: simply", lexicon.occurrences(c, F.lit("simply")))[0] == 3


def test_grams_and_overlap(spark):
    df = spark.createDataFrame([(1, "oak ash elm fir yew box"), (2, "Oak ash elm fir yew box"), (3, "cod eel ray hake ling bass"), (4, "oak ash")], "id long, text string")
    assert similarity.gram_rows(df, ["id"]).groupBy("id").count().orderBy("id").collect()[0]["count"] == 3
    out = {r.pid: (r.overlap, r.nearest) for r in similarity.worst_overlap(df.withColumnRenamed("id", "pid"), df.filter("id > 1"), "pid", "id").collect()}
    assert out == {1: (1.0, 2), 2: (1.0, 2), 3: (1.0, 3), 4: (0.0, None)}
    pairs = similarity.window_pairs(df.withColumn("g", F.lit("x")), "g", "id").collect()
    assert [(r.i, r.j, r.overlap) for r in pairs] == [(1, 2, 1.0)]


def test_style_similarity_is_symmetric_and_bounded(spark):
    df = T.style_profile(spark.createDataFrame([("Short one. Then a longer sentence follows, with commas!",), ("Why? Because.",), ("",)], "text string")).collect()
    get = lambda r: lambda k: F.lit(float(r[k]))
    for a in df:
        for b in df:
            x, y = spark.range(1).select(T.style_similarity(get(a), get(b)), T.style_similarity(get(b), get(a))).first()
            assert x == y and 0 <= x <= 1 and (a is not b or x == 1)
    assert df[2]["words"] == df[2]["sentences"] == 0


def test_total_variation(spark):
    a = spark.createDataFrame([("p", 0.5), ("q", 0.5)], "k string, share double")
    b = spark.createDataFrame([("p", 1.0), ("r", 0.0)], "k string, share double")
    assert similarity.total_variation(a, b, "k").first()[0] == 0.5


def test_dictionaries():
    for _, listed in phrases.KINDS:
        assert len(set(listed)) == len(listed)
    assert [len(x) for _, x in phrases.KINDS] == [117, 66, 16, 19]
    assert not set(phrases.HARD_BANS) & set(phrases.SOFT_TELLS)


def test_lexicon_hits(spark):
    df = spark.createDataFrame([(1, "Line one.\nHeres the thing: we DELVE INTO adjusting."), (2, None)], "doc_id long, text string")
    out = {(r.kind, r.phrase): (r.position, r.line) for r in lexicon.hits(df).collect()}
    assert out[("hard", "delve into")] == (30, 2) and out[("hard", "here's the thing")] == (10, 2) and ("soft", "just") in out


def test_hooks_and_ctas(spark):
    c = F.col("text")
    assert "direct-question" in one(spark, "Why does this cost you money?\nx", lexicon.hook_families(c))[0]
    assert one(spark, "Nothing to do here", lexicon.cta_positions(c))[0] == []
    assert one(spark, "Text. Send me a note", lexicon.cta_positions(c))[0] == [6]
    assert one(spark, "## head", lexicon.has_markdown(c))[0] and not one(spark, "#tag plain", lexicon.has_markdown(c))[0]


BAD = "We delve into results. Studies show a gain of 47 percent, 38 days, 73 x and 61 hours. In 2024 we took 3 steps."


def test_sourcing(spark):
    df = spark.createDataFrame([(1, BAD), (2, "It took 12 days.")], "doc_id long, text string")
    registry = spark.createDataFrame([(7, "The move took 12 days in total")], "item_id long, text string")
    known = sourcing.known_numbers(registry, "text")
    found = sourcing.unsourced(df, known).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.value) for r in found] == [(1, "47 percent"), (1, "38 days"), (1, "73 x"), (1, "61 hours")]
    claims = spark.createDataFrame([(1, "The total move took long")], "doc_id long, claim string")
    r = sourcing.nearest_claim(claims, registry).first()
    assert r.entry == 7 and r.score == pytest.approx(4 / 5, abs=0.21)


def test_post_rubric(spark):
    assert sum(c.points for c in rules.POST) == 100 and sum(c.points for c in rules.POST if c.judged) == 35
    df = spark.createDataFrame([(1, BAD), (2, "Use the checklist. It is short, and you can send it to your team.")], "doc_id long, text string")
    known = spark.createDataFrame([], "value string")
    m = posts.measure(df, known)
    found = rules.findings(m, *posts.checks())
    assert found.count() == 48
    no = F.lit(False)
    hb = m.select("doc_id", posts.hard_blocks(F.col("needs_source") > 0, no, no, no).alias("hard_blocks"))
    out = {r.doc_id: r for r in rules.totals(found, hard_block=hb).collect()}
    assert (out[1].total, out[1].band, out[1].hard_blocks) == (0.0, "reject", "hb1") and out[1].computed_score < out[2].computed_score
    dims = rules.dimensions(found).filter("doc_id = 1").collect()
    assert sum(d.points_possible for d in dims) == 65 and sum(d.judged_points_pending for d in dims) == 35
    failed = {r.check_id for r in found.filter("doc_id = 1 and not passed").collect()}
    assert {"s2", "vm1", "ct1"} <= failed
    ranks = rules.ordered(found).filter("doc_id = 1").orderBy("rank").collect()
    assert [r.passed for r in ranks] == sorted(r.passed for r in ranks)
    assert rules.scored_status(rules.totals(found, hard_block=hb)).filter("doc_id = 1").first().status == "rejected"
    report = rules.report_rows(found).filter("doc_id = 1").first()
    assert len(report.findings) == 24 and len(report.next_actions) == 6 and report.next_actions[0] == "s2"
    repeat = posts.measure(df, known, spark.createDataFrame([(1, 0.9)], "doc_id long, overlap double"))
    assert not rules.findings(repeat, *posts.checks()).filter("doc_id = 1 and check_id = 'vd3'").first().passed


def test_bands_have_gaps(spark):
    df = spark.createDataFrame([(59.0,), (59.5,), (60.0,), (101.0,)], "x double")
    assert [r[0] for r in df.select(rules.band(F.col("x"))).collect()] == ["reject", "unclassified", "revise", "unclassified"]


PROFILE = {
    "id": "p", "custom_url_slug": "ada-w", "publicIdentifier": None, "headline": "Operations lead for payroll automation | cut close time 40 hours", "about": ("Teams lose days to manual close. The close map fixes that. " * 10).strip() + "\nSend me a note.",
    "experience": [{"title": "Lead", "company": "A", "period": f"{y} - {y + 1}", "start": None, "end": None, "description": None, "bullets": ["cut 30 hours", "saved 12 days"]} for y in (2022, 2020, 2018)],
    "featured": [{"title": f"Case study {i}", "kind": "case", "url": "u", "description": "d"} for i in range(5)], "education": [{"school": "s", "field": "f", "year": 2010}], "licenses": [], "skills": ["payroll automation", "b", "c"], "contact": {"email": "x"},
}
PERSONA = {
    "role_titles": ["operations lead"], "primary_keyword": "payroll automation", "secondary_keywords": ["close map"], "problem": "manual close", "method": "close map", "differentiator": "fixes that", "slug": None, "banner": "b", "photo": "p",
    "proof": [{"claim": "c", "tier": 1, "source": "s", "permission": "granted"}], "paid_offers": [{"name": "Case study 1", "outcome": "o", "price_model": "m", "featured_slot": 1}], "destinations": ["https://x.y"], "avoid": ["guru"], "promises": ["faster close", "payroll"],
}


def test_profile_rubric(spark):
    assert sum(c.points for c in profiles.RUBRIC) == 100 and len(profiles.RUBRIC) == 32
    weak = PROFILE | {"id": "w", "headline": "Hello", "about": "I am a guru", "experience": [], "featured": None, "skills": None, "contact": None}
    df = spark.createDataFrame([PROFILE, weak], profiles.PROFILE)
    found, totals = profiles.score_profiles(df, PERSONA)
    out = {r.id: r for r in totals.collect()}
    assert out["p"].total >= 75 and not out["p"].capped and out["w"].total < 40
    failed = {r.check_id for r in found.filter("id = 'w' and not passed").collect()}
    assert {"pc1", "pc2", "cm3", "pcx1"} <= failed and "cv2" not in failed
    capped, _ = profiles.score_profiles(df, PERSONA | {"avoid": ["payroll"]})
    assert rules.capped(capped, ("id",), bands=profiles.BANDS).filter("id = 'p'").first().total == 59


@pytest.mark.parametrize(
    "change, verdict, failed",
    [
        ({}, "sound", None),
        ({"headline": "Sign in to continue", "about": "", "experience": [], "skills": []}, "unsound", "headline_not_placeholder"),
        ({"experience": []}, "unsound", "experience_present"),
        ({"about": PROFILE["about"][:180]}, "usable_with_caveats", "about_length_plausible"),
        ({"about": PROFILE["headline"]}, "usable_with_caveats", "about_not_duplicate_headline"),
        ({"experience": PROFILE["experience"][::-1]}, "usable_with_caveats", "experience_monotonic"),
        ({"featured": [{"title": "", "kind": "", "url": "", "description": ""}]}, "usable_with_caveats", "featured_parsed"),
        ({"about": PROFILE["about"] + " lorem ipsum"}, "unsound", "no_template_leftovers"),
        ({"headline": "A consulting firm for payroll automation teams"}, "sound", "reads_as_individual"),
    ],
)
def test_import_checks(spark, change, verdict, failed):
    found = profiles.verify_import(spark.createDataFrame([PROFILE | change], profiles.PROFILE))
    assert found.count() == 15 and profiles.import_verdict(found).first().verdict == verdict
    assert failed is None or failed in {r.check_id for r in found.filter("not passed").collect()}


def test_schema_compiler(spark):
    schema = {
        "type": "object", "required": ["id"], "$defs": {"tag": {"type": "string", "pattern": "^t"}},
        "properties": {"id": {"type": "string", "pattern": "^p[0-9]+$"}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 5}, "tags": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/tag"}}, "kind": {"enum": ["a", "b"]}},
        "allOf": [{"if": {"properties": {"kind": {"const": "b"}}, "required": ["kind"]}, "then": {"required": ["n"]}}], "anyOf": [{"required": ["n"]}, {"required": ["tags"]}],
    }
    df = spark.createDataFrame([(1, "p1", 3, ["t"], "a"), (2, "x", 9, ["t", "u", "t"], "c"), (3, None, None, None, "b"), (4, "p2", None, ["t1"], None)], "row long, id string, n int, tags array<string>, kind string")
    out = {}
    for r in quality.violations(df, schema, "row").collect():
        out.setdefault(r.row, set()).add(r.pointer)
    assert out == {2: {"/id", "/n", "/tags", "/tags/1", "/kind"}, 3: {"/id", "/n", "/"}}


def test_planner_goldens(spark):
    pillars = spark.createDataFrame([(i, f"p{i + 1}", w, []) for i, w in enumerate((0.40, 0.25, 0.20, 0.10, 0.05))], "ord int, id string, weight double, maps_to_beliefs array<string>")
    df = planning.slots(spark, date(2026, 1, 5), 30, pillars, ["h1"], [{"rung": 1, "serves": ["p1"], "archetypes": []}])
    s = df.orderBy("idx").collect()
    count = lambda k: {v: sum(r[k] == v for r in s) for v in {r[k] for r in s}}
    assert len(s) == 22 and count("pillar") == {"p1": 11, "p2": 7, "p3": 2, "p4": 1, "p5": 1} and count("claim_level") == {1: 4, 3: 16, 4: 2}
    assert sorted(count("archetype").values()) == [2] * 8 + [3, 3]
    assert all(a.pillar != b.pillar and a.archetype != b.archetype for a, b in zip(s, s[1:]))
    assert [r.rule for r in planning.plan_violations(df, 5, 5, 1).collect()] == []
    assert {r.rule for r in planning.plan_violations(df, 0, 0, 0, 2).collect()} == {"thin_proof", "no_beliefs", "no_hot_takes", "persona_incomplete"}
    assert {r[0] for r in spark.range(8).select(planning.archetype_at(F.col("id"))).collect()} == set(planning.ARCHETYPES[:8])


def test_gate_and_queue(spark, tmp_path):
    rows = [(1, "approved", "", True, "a \"b\", c\nd", 80.0, None), (2, "in_review", "", True, "x", 80.0, None), (3, "approved", "hb1", True, "x", 80.0, None), (4, "approved", "", False, "x", 80.0, None), (5, "approved", "", True, " ", 80.0, None), (6, "approved", "", True, "x", None, None), (7, "approved", "", True, "x", 50.0, None), (8, "approved", "", True, "x", 80.0, "OTHER")]
    df = spark.createDataFrame(rows, "id int, status string, hard_blocks string, approved boolean, text string, total double, visibility string").withColumn("least_score", F.lit(75.0)).withColumn("allowed_visibility", F.array(F.lit("PUBLIC")))
    gated = drift.approved_rows(df)
    assert [r.reject_reason for r in gated.orderBy("id").collect()] == [None, "status is in_review", "hard blocks present: hb1", "no approval", "empty text", "no score", "score too low", "visibility not allowed"]
    assert tuple(sinks.status(gated).select("exported", "rejected").first()) == (1, 7)
    queue = sinks.queue_rows(gated.filter("reject_reason is null"))
    assert queue.columns == sinks.QUEUE and len(queue.columns) == 24
    sinks.write_csv(queue, str(tmp_path / "q"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "q")).first()
    assert back.body == 'a "b", c\nd' and back.visibility == "PUBLIC"


def test_readers(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"text": "one", "pillar": "p1", "proof_refs": ["a"]}\n"bare"\nbroken {\n{"pillar": "p2"}\n')
    out = sorted((r.text, r.pillar or "") for r in readers.read_history(spark, str(tmp_path / "h.jsonl")).collect())
    assert out == [("bare", ""), ("one", "p1")]
    d = tmp_path / "drafts"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"id": "a", "text": "t"}))
    (d / "b.json").write_text("{")
    (d / "c.txt").write_text("no")
    assert [r.id for r in readers.read_drafts(spark, str(d), "id string, text string").collect()] == ["a"]
    md = "# Head\n## Sample 1\n" + "x" * 90 + "\n<!-- no -->\n---\n## Sample 2\nshort\n## Other\n" + "y" * 90
    assert one(spark, md, readers.voice_samples(F.col("text")))[0] == ["x" * 90]


def test_settings():
    got = readers.load_settings('# c\na: 1\nb:\n  - x\n  - y: 2.5 # c\n    z: "q: \\"r\\""\nc: [1, \'two\', [3]]\nd: |\n  line\n    more\n  # kept\ne: yes\nf:\ng: {}\nh: a:b\n')
    assert got == {"a": 1, "b": ["x", {"y": 2.5, "z": 'q: "r"'}], "c": [1, "two", [3]], "d": "line\n  more\n# kept\n", "e": True, "f": None, "g": {}, "h": "a:b"}
    for bad in ("a: &x 1", "a: *x", "a: !t 1", "a: {b: 1}", "a: 1\n---\nb: 2", "\ta: 1"):
        with pytest.raises(readers.SettingsError):
            readers.load_settings(bad)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text(f'{{"id": "p{i % 2}", "text": "Use it. Twice."}}\n')
    seen = []
    q = history.measured(history.unique(history.posts(spark, str(tmp_path / "in"))), lambda b, i: seen.extend((r.id, r.sentences) for r in b.collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert sorted(seen) == [("p0", 2), ("p1", 2)]


def test_opening_reuse(spark):
    df = spark.createDataFrame([(i, "s", "Same line!\nrest" if i < 5 else f"Line {i}") for i in range(30)], "doc_id long, source string, text string")
    r = drift.opening_reuse(drift.last_posts(df, "source", "doc_id"), "source", T.hook_key(F.col("text"))).first()
    assert (r.reused, r.posts, r.rate) == (5, 30, 0.167)


def test_report():
    text = sinks.render(40.0, "reject", [{"dimension": "hook", "ratio": 0.5, "points_earned": 6, "points_possible": 12}], [{"check_id": "h1", "passed": False, "severity": "warn", "points": 6, "measured": "9"}])
    assert "WARNINGS" in text and "1. h1" in text and "##########" in text


def test_personas(spark):
    from textloom.operators import persona

    full = {
        "persona_id": "full", "profile": {"display_name": "A", "role_title": "r", "domain": "pay-roll", "timezone": "UTC"}, "positioning": {"statement": "s", "problem": "p", "method": "m", "differentiator": "d"}, "publish": {"mode": "auto", "approval_required": True}, "primary_keyword": "k", "require_permission": True,
        "proof": [{"id": f"h{i}", "tier": "1", "claim": "c", "source": "s", "permission": "granted"} for i in range(3)], "assets": [{"id": "a1", "proof_refs": ["h1", "a1"]}], "beliefs": [{"id": f"b{i}", "claim": "c", "confidence": "high", "evidence_refs": ["h0"]} for i in range(3)], "hot_takes": [],
        "pillars": [{"id": "p1", "promise": "x", "weight": 0.6, "maps_to_beliefs": ["b0"]}, {"id": "p2", "promise": "x", "weight": 0.4, "maps_to_beliefs": []}], "segments": [{"id": "s1"}], "primary_segment": "s1", "ladder": [{"rung": 1, "id": "l1", "cta_text": "t", "serves": ["p1"]}],
        "paid_offers": [{"name": "n", "outcome": "o", "price_model": "m", "proof_refs": ["h2"]}], "voice": None, "samples": ["Use it now. This is a sample of about fourteen words that goes on for a while here. #a"] * 3,
    }
    broken = full | {"persona_id": "broken", "profile": full["profile"] | {"domain": "Bad Domain", "timezone": None}, "primary_segment": "s9", "proof": [{"id": "h0", "tier": "1", "claim": "c", "source": None, "permission": "requested"}], "pillars": [{"id": "p1", "promise": "x", "weight": 0.6, "maps_to_beliefs": ["b7"]}], "samples": ["Wow \U0001f44d."]}
    df = spark.createDataFrame([full, broken, {"persona_id": "empty"}], persona.PERSONA)
    out = {}
    for r in persona.gaps(df).collect():
        out.setdefault(r.persona_id, {})[r.gap] = r.blocks
    assert "full" not in out and out["empty"]["identity"]
    assert out["broken"] == {"profile.timezone": False, "profile.domain_format": True, "proof.entries": False, "proof.h0.source": True, "proof.h0.permission": False, "voice.samples": False, "pov-map.pillars.weight_sum": True, "pov-map.p1.maps_to_beliefs -> b7": True}
    refs = {(r.persona_id, r.reference, r.severity) for r in persona.references(df).collect()}
    assert {x for x in refs if x[0] == "full"} == set() and {("broken", "audience.primary", "blocker"), ("broken", "asset a1 -> h1", "warn"), ("broken", "offer n -> h2", "warn")} <= refs
    rules_ = {(r.persona_id, r.rule) for r in persona.publishing(df).collect()}
    assert rules_ == {("full", "auto_needs_no_approval"), ("broken", "auto_needs_no_approval"), ("broken", "auto_without_timezone"), ("broken", "auto_with_gaps")}
    found = {(r.persona_id, r.finding) for r in persona.voice(df).collect()}
    assert ("broken", "voice.emoji_conflict") in found and ("broken", "voice.mean_sentence_words") in found and ("full", "voice.hashtag_usage") not in found


def test_command_line(spark, tmp_path, capsys):
    from textloom.__main__ import main

    assert main(["list"]) == 0 and "style_profile" in capsys.readouterr().out
    spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    assert main(["run", "sentence_stats", "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--format", "json", "--fail-on-rows"]) == 1
    assert spark.read.json(str(tmp_path / "o")).first().n_sentences == 2
    assert main(["run", "sentence_stats", "--tables", str(tmp_path / "none")]) == 3
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--tables", "x"])


def test_years(spark):
    c = F.col("text")
    assert tuple(one(spark, "2013 - 2017", T.first_year(c), T.end_year(c))) == (2013, 2017)
    assert tuple(one(spark, "Since 2019, Present", T.first_year(c), T.end_year(c))) == (2019, 9999)
    assert tuple(one(spark, "12019 units", T.first_year(c), T.end_year(c))) == (None, None)
    assert one(spark, "x", planning.next_monday(F.lit(date(2026, 1, 5))))[0] == date(2026, 1, 12)


def test_numbers_of_a_profile(spark):
    rows = [PROFILE | {"headline": "Lead since 2019", "about": "In 2019 I joined. We ship 1,200 crates, then 40 hours of rest. 40 hours (again)", "experience": []}]
    df = spark.createDataFrame(rows, profiles.PROFILE)
    found = {r.value: r for r in profiles.number_contexts(df).collect()}
    assert set(found) == {"2019", "1,200", "40 hours"}
    assert found["2019"].structural and not found["40 hours"].structural and found["40 hours"].has_unit and not found["1,200"].has_unit
    assert found["40 hours"].context == "We ship 1,200 crates, then 40 hours of rest" and found["2019"].context.endswith("In 2019 I joined")
    only_years = spark.createDataFrame([rows[0] | {"about": "In 2019 and 2020 I joined."}], profiles.PROFILE)
    assert not profiles.verify_import(only_years).filter("check_id = 'numbers_present'").first().passed


def test_matcher_counts_each_phrase_once(spark):
    entries = [("a", 0, "don't"), ("a", 1, "we"), ("b", 0, "ledger")]
    df = spark.createDataFrame([("dont we we",), ("don't",), ("",), (None,), ("ledgers owe",)], "text string")
    assert [r[0] for r in df.select(lexicon.matcher(entries)("text")).collect()] == [[1, 3], [0], [], [], [1, 2]]
    words_ = lexicon.dominant(spark.createDataFrame([(1, "Ledger ledger owns owns owns a the with")], "doc_id long, text string")).orderBy("rank").collect()
    assert [(r.word, r.n) for r in words_] == [("owns", 3), ("ledger", 2)]


def test_registry_of_any_nesting(spark):
    rows = [{"id": "a", "claim": "14 of 20", "metric": {"value": 6.0, "marks": [1.5, 2.0], "notes": {"k": "from 31.5 to 7"}}}, {"id": "b", "claim": None, "metric": None}]
    df = spark.createDataFrame(rows, "id string, claim string, metric struct<value:double,marks:array<double>,notes:map<string,string>>")
    assert {r.value for r in sourcing.registry_numbers(df, "claim", "metric").collect()} == {"14", "20", "6", "1.5", "2", "31.5", "7"}


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_nearest_claim_by_broadcast_and_by_shuffle(spark, most_broadcast):
    registry = spark.createDataFrame([("x", "ledger closed early"), ("y", "ledger closed late"), ("z", "nothing else")], "item_id string, text string")
    claims = spark.createDataFrame([(1, "Our ledger closed lately."), (2, "unrelated"), (2, "unrelated"), (3, "ledger, closed")], "doc_id long, claim string")
    found = sorted((r.doc_id, r.entry or "", r.score or 0.0) for r in sourcing.nearest_claim(claims, registry, most_broadcast=most_broadcast).collect())
    assert found == [(1, "y", 1.0), (2, "", 0.0), (2, "", 0.0), (3, "x", pytest.approx(2 / 3))]


def test_blocks_of_posts(spark):
    from textloom.plans import editorial

    out = {r.id: (r.needs_source, r.hard_blocks) for r in editorial.hard_blocks(spark, "").collect()}
    assert out["good"] == (0, "") and out["invented"] == (2, "hb1,hb2") and out["machine"] == (0, "hb3") and out["queued"] == (0, "hb6") and out["bypassed"] == (0, "")
    assert out["out"] == (1, "hb1,hb2,hb5")
    gate = {r.id: r.reject_reason for r in editorial.queue_gate(spark, "").collect()}
    assert gate["good"] is None and gate["sidefeed"] == "feed distribution not allowed" and gate["unsigned"] == "no approval" and gate["unscored"] == "no score"


def test_drift_report(spark):
    from textloom.plans import editorial, fixtures

    found = {(r.feed, r.check, r.subject) for r in editorial.drift_report(spark, "").collect()}
    assert {("drifted", "archetype", "story"), ("drifted", "hook_reuse", ""), ("drifted", "repetition", ""), ("drifted", "proof_reuse", "h1"), ("drifted", "emoji", ""), ("drifted", "pillar_distribution", "")} <= found
    assert not any(f == "short" for f, _, _ in found) and {c for f, c, _ in found if f == "even"} == {"mean_sentence_words"}
    balanced = drift.report(spark.createDataFrame([r for r in fixtures.HISTORY if r["feed"] == "even"], fixtures.HISTORY_DDL), "feed", "seq", fixtures.PLANNED)
    assert balanced.collect() == []


def test_lookups_and_reports(spark):
    from textloom.operators import persona
    from textloom.plans import fixtures

    df = spark.createDataFrame(fixtures.PERSONAS, persona.PERSONA)
    refs = spark.createDataFrame([("full", "b1"), ("full", "nope"), ("empty", "b1")], "persona_id string, ref string")
    assert {(r.persona_id, r.ref, r.entry.claim if r.entry else None) for r in persona.lookup(refs, df, "beliefs").collect()} == {("full", "b1", "c"), ("full", "nope", None), ("empty", "b1", None)}
    with pytest.raises(ValueError):
        persona.entries(df, "profile")
    posts_ = spark.createDataFrame([("a",), ("b",)], "id string")
    written = {r.id: r.voice_report for r in persona.with_voice_report(posts_, spark.createDataFrame([("a", 3)], "id string, hard_bans int")).collect()}
    assert written["a"].hard_bans == 3 and written["b"] is None


def test_calendar_of_two_posts_a_day(spark):
    pillars = spark.createDataFrame([(0, "p1", 0.7, ["b1"]), (1, "p2", 0.3, [])], "ord int, id string, weight double, maps_to_beliefs array<string>")
    df = planning.slots(spark, date(2026, 1, 5), 7, pillars, [], [], ("08:00", "17:00"), ("b2",), per_day=2, claims={"b1": "x" * 100}, hot_take={"take": "t", "line": "Say it"}, segment="s")
    s = df.orderBy("idx").collect()
    assert len(s) == 10 and [r.date.day for r in s] == [5, 5, 6, 6, 7, 7, 8, 8, 9, 9] and {r.segment for r in s} == {"s"}
    assert [r.time for r in s[:4]] == ["08:00", "17:00"] * 2
    told = {r.archetype: r.hook_brief for r in s}
    assert told["opinion"] == "Argue: Say it" and ("x" * 79 + "…" in told["framework"] or "reuse" in told["framework"])
    assert {(r.kind, r.key): r["count"] for r in planning.distribution(df, pillars).collect()}[("archetype", "how_to")] == 1
    labels = planning.labelled_levels(df, spark.createDataFrame([(1, "opinion")], "level int, label string")).collect()
    assert {r.claim_level: r.label for r in labels}["1"] == "opinion" and sum(r["count"] for r in labels) == 10
    assert sinks.calendar_rows(df).columns == sinks.CALENDAR and len(sinks.CALENDAR) == 17
    assert planning.slots(spark, date(2026, 1, 10), 2, pillars, [], []).collect() == []


def test_schema_of_further_properties(spark):
    schema = {"properties": {"id": {"type": "string"}}, "additionalProperties": {"type": "object", "additionalProperties": {"type": "string", "minLength": 2}}}
    df = spark.createDataFrame([("a", {"k": "x", "l": "long"}), ("b", None)], "id string, more map<string,string>")
    assert [(r.id, r.pointer, r.message) for r in quality.violations(df, schema, "id").collect()] == [("a", "/more/k", "minLength 2")]
    assert quality.violations(df, {}, "id").collect() == []


def test_settings_folders(spark, tmp_path):
    from textloom.operators import persona

    folder = tmp_path / "one" / "persona"
    folder.mkdir(parents=True)
    (folder / "identity.yaml").write_text("profile:\n  display_name: Mira\n  domain: finance\npublish:\n  mode: auto\n")
    (folder / "proof.yaml").write_text("policy:\n  require_client_permission: true\nentries:\n  - id: h1\n    claim: c\n    tier: measured\n")
    (folder / "voice.yaml").write_text("sentence:\n  target_words: 12\n")
    (folder / "voice-samples.md").write_text("## Sample 1\n" + "Close the month. " * 8)
    got = readers.load_persona(spark, str(tmp_path / "one"))
    assert got["identity"]["profile"]["display_name"] == "Mira" and got["audience"] is None and len(got["voice-samples"]) == 1
    assert readers.load_persona(spark, str(tmp_path / "one" / "persona"))["proof"] == got["proof"]
    df = readers.read_personas(spark, {"mira": str(tmp_path / "one"), "none": str(tmp_path / "none")}, persona.PERSONA)
    out = {r.persona_id: r for r in df.collect()}
    assert out["mira"].proof[0].id == "h1" and out["mira"].voice.target_words == 12.0 and out["none"].profile is None
    assert {(r.persona_id, r.gap) for r in persona.gaps(df).filter("persona_id = 'none'").collect()} == {("none", "identity")}
    rubric = tmp_path / "rubric"
    rubric.mkdir()
    (rubric / "post-rubric.yaml").write_text("dimensions:\n  - id: hook\n    checks:\n      - id: h1\n        points: 6\n        computed: true\n      - id: h3\n        points: 4\n        computed: false\ngrade_bands:\n  - label: low\n    min: 0\n    max: 10\n")
    docs = readers.load_rubric(spark, str(tmp_path))
    assert docs["profile-rubric"] is None
    assert rules.from_document(docs["post-rubric"]) == ((rules.Check("h1", "hook", 6), rules.Check("h3", "hook", 4, judged=True)), (("low", 0, 10),))


def test_long_text_is_wrapped():
    out = sinks.wrapped("word " * 30 + "x" * 90, 3, 20).split("\n")
    assert all(line.startswith("   ") and (len(line) <= 23 or line.strip() == "x" * 90) for line in out)
    text = sinks.render(0, "reject", [], [], ["hb1: no source"], [{"gap": "identity", "blocks": True}])
    assert "HARD BLOCKS" in text and "GAPS THAT BLOCK" in text
