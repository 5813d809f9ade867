"""Copyright lines with long lists of holders."""

import re

from pyspark.sql import functions as F

from textloom.llm.license_scan import scan_words, tokens


def test_holders_of_up_to_forty_words():
    from textloom.llm.license_scan import scan_words

    line = lambda n: ["copyright", "c", *(f"name{i}" for i in range(n)), "all", "rights", "reserved"]
    for n in (1, 8, 9, 40):
        assert "copyright-reserved" in scan_words(line(n))["labels"].split(",")
    # A debate on copyright is no notice of holders, whatever stands some pages on.
    for n in (42, 5_000):
        found = scan_words(["the", *line(n), "rooms"])
        assert (found["labels"], found["score"]) == ("reserved", 0.5)


MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses(spark):
    from textloom.llm.license_scan import TEMPLATES, scan_licenses

    text = dict(TEMPLATES)
    plain = lambda label, **fills: " ".join(re.sub(r"<<(?:begin|end)Optional>>", "", re.sub(r"<<var;[^>]*>>", fills.get("who", "the authors"), text[label])).split())
    rows = [
        (1, f"Intro words. {MIT} More words."),
        (2, MIT.replace("sublicense", "lease")),
        (3, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME LTD")),
        (4, plain("bsd-3-clause", who="Acme Ltd")),
        (5, plain("bsd-2-clause")),
        (6, plain("zlib")),
        (7, plain("isc")[:-20]),
        (8, " ".join(sorted(MIT.split()))),
    ]
    found = {r.doc_id: set(r.labels.split(",")) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"mit", "mit-grant"} <= found[1] and "mit" not in found[2] and "mit-grant" in found[2] and "mit" in found[3]
    assert "bsd-3-clause" in found[4] and "bsd-2-clause" not in found[4] and "bsd-2-clause" in found[5] and "bsd-3-clause" not in found[5]
    assert "zlib" in found[6] and "isc" not in found[7] and "isc-grant" in found[7] and found[8] == {""}


def test_the_gate_passes_what_the_automata_accept(spark):
    from textloom.llm.license_scan import BASE, TEMPLATES, gate, scan_words, tokens
    from textloom.llm.common import words

    texts = [re.sub(r"<<[^>]*>>", " x ", t) for _, t in TEMPLATES] + [p for p, _ in BASE] + ["all the world", "cc", "general license", "public license general"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", gate(words(F.col("text"))).alias("ok")).collect()
    for r in rows:
        assert r.ok or not scan_words(tokens(r.text))["labels"]
    assert [r.ok for r in rows[-4:]] == [False, False, False, True]
