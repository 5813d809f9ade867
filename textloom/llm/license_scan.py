"""License scans by template markup compiled into token automata."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import words

# The base phrases with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# What the BSD licenses begin and end with.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY <<var;1;12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;1;12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
# License wordings.  <<beginOptional>> ... <<endOptional>> may be absent;
# <<var;min;max>> stands for so many words.  All other words are mandatory, in this order.
TEMPLATES = (
    ("apache-2.0", "licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0<<beginOptional>> (the License); you may not use this file except in compliance with the License<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons Attribution<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a Creative Commons Attribution NonCommercial <<endOptional>>CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a Creative Commons Attribution ShareAlike <<endOptional>>CC BY-SA 4.0"),
    ("cc-attribution", "licensed under a Creative Commons Attribution<<beginOptional>> <<var;1;2>><<endOptional>> <<var;1;1>>.0<<beginOptional>> International<<endOptional>> License"),
    ("cc0-1.0", "CC0 1.0<<beginOptional>> Universal<<endOptional>>"),
    ("gpl-2.0", "licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> version 3<<beginOptional>> or<<beginOptional>> at your option any<<endOptional>> later version<<endOptional>>"),
    ("gpl-notice", "free software you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>><<var;1;1>><<endOptional>> General Public License as published by the Free Software Foundation"),
    ("copyright-reserved", "Copyright <<beginOptional>>(c) <<endOptional>><<var;1;40>> All rights reserved"),
    ("mit-reference", "released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;1;2>>), to deal in the Software without restriction"),
    ("isc-grant", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("spdx", "SPDX-License-Identifier: <<var;1;1>>"),
    # Whole licenses.
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;1;2>>), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>"
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL <<var;1;10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;1;10>> "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;1;10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} <<beginOptional>>3. <<endOptional>>Neither the name of <<var;1;10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the <<var;1;4>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment "
        "<<beginOptional>>(see the following) <<endOptional>>in the product documentation would be appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "<<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution",
    ),
)
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_UPPER))


class Automaton:
    """Token automaton of one template: word edges, free edges (any word) and empty edges."""

    def __init__(self, template: str):
        self.words: list[dict[str, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        # Words outside optional and variable regions: a text without one of them can't match.
        self.mandatory: set[str] = set()
        at, opened = 0, []
        for piece in re.split(r"(<<[^>]*>>)", template):
            if piece == "<<beginOptional>>":
                opened.append(at)
            elif piece == "<<endOptional>>":
                self.empty[opened.pop()].append(at)
            elif piece.startswith("<<var"):
                least, most = map(int, piece.strip("<>").split(";")[1:])
                ends = []
                for i in range(most):
                    if i >= least:
                        ends.append(at)
                    to = self._state()
                    self.free[at].append(to)
                    at = to
                for e in ends:
                    self.empty[e].append(at)
            else:
                for w in tokens(piece):
                    if not opened:
                        self.mandatory.add(w)
                    to = self._state()
                    self.words[at][w] = to
                    at = to
        if opened:
            raise ValueError("an optional region is not closed")
        self.final = at

    def _state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.empty.append([])
        return len(self.words) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def first_words(self) -> set[str]:
        start = self.closed({0})
        if any(self.free[s] for s in start) or self.final in start:
            raise ValueError("a template starts with a mandatory or optional word, not with a variable")
        return {w for s in start for w in self.words[s]}

    def accept(self, text: list[str], start: int) -> int:
        """End of the longest accepted run of words from start, or -1."""
        states, end = self.closed({0}), -1
        for i in range(start, len(text)):
            step = {self.words[s][text[i]] for s in states if text[i] in self.words[s]}
            step.update(t for s in states for t in self.free[s])
            if not step:
                break
            states = self.closed(step)
            if self.final in states:
                end = i + 1
        return end


@lru_cache
def compiled(base: tuple = BASE, templates: tuple = TEMPLATES) -> tuple[dict[str, list], list]:
    """First word -> [(label, is base, automaton)], and all first words."""
    table: dict[str, list] = {}
    for kind, pairs in ((True, [(label, phrase) for phrase, label in base]), (False, list(templates))):
        for label, template in pairs:
            a = Automaton(template)
            for w in a.first_words():
                table.setdefault(w, []).append((label, kind, a))
    return table, sorted(table)


def gate(w: Column, base: tuple = BASE, templates: tuple = TEMPLATES) -> Column:
    """Whether a text's words hold all mandatory words of some template, in any order.

    The longest word of each is looked for first, all of them only where one is found.
    """
    table, _ = compiled(base, templates)
    needed = {frozenset(a.mandatory) for rows in table.values() for _, _, a in rows}
    # What needs all that another one needs is covered by that one.
    needed = sorted(sorted(x) for x in needed if not any(y < x for y in needed))
    longest = sorted({max(x, key=lambda t: (len(t), t)) for x in needed})
    whole = F.lit(False)
    for x in needed:
        whole = whole | (F.size(F.array_except(F.array(*map(F.lit, x)), w)) == 0)
    return F.when(F.arrays_overlap(w, F.array(*map(F.lit, longest))), whole).otherwise(False)


def scan_words(text: list[str], base: tuple = BASE, templates: tuple = TEMPLATES) -> dict:
    """n_base, first_word, last_word, base_labels, labels, score and matches of one list of words."""
    table, _ = compiled(base, templates)
    found = [(i, a.accept(text, i), label, kind) for i, w in enumerate(text) if w in table for label, kind, a in table[w]]
    found = [x for x in found if x[1] > 0]
    starts = [x[0] for x in found if x[3]]
    full = [x for x in found if not x[3]]
    return {
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x[2] for x in found if x[3]})),
        "labels": ",".join(sorted({x[2] for x in found})),
        "score": 1.0 if full else 0.5 if starts else 0.0,
        "matches": [{"label": x[2], "first": x[0], "end": x[1]} for x in sorted(found)],
    }


RESULT = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:int,end:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are cut in the JVM.  Only texts that hold all mandatory words of some template reach the
    automata, all words of them; the others can't match.  A template is accepted at every place
    where its mandatory words stand in order, with or without its optional regions and with any words, as many as
    the template allows, in its variables; those of copyright-reserved take up to 40 words of holders and years.
    score is 1 for an accepted template, 0.5 for base phrases alone, else 0.

    Null text has no words: n_base 0, first_word and last_word null, empty labels, score 0.  Repeated rows are
    scanned one by one.  An empty table gives no rows.
    """
    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        none = scan_words([])
        out = pd.DataFrame([scan_words(list(x), base, templates) if x is not None and len(x) else none for x in texts], columns=list(none))
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        return out

    cut = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    sent = cut.select("doc_id", F.size("_w").cast("long").alias("n_words"), scan(F.when(gate(F.col("_w"), base, templates), F.col("_w")).otherwise(F.expr("cast(array() as array<string>)"))).alias("_r"))
    return sent.select("doc_id", "n_words", "_r.*")
