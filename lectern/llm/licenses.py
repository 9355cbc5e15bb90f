"""License scans: phrases and template-markup wordings found in texts by token automata.

A template is a wording with markup: ``<<optional>> ... <<end>>`` may be absent (regions nest), and
``<<var:LO-HI>>`` stands for any LO to HI words. Everything else is mandatory. A template is compiled into an
automaton over words; a text carries its label if the mandatory words stand in it one after the other, exactly.
Wordings are read as texts are: lower-cased words, without punctuation.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the query contract and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Wordings of common notices, with labels of our own.
TEMPLATES = (
    ("apache-notice", "licensed under the apache license <<optional>> version <<var:1-2>> <<end>>"),
    ("mit-notice", "<<optional>> released <<end>> under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-notice", "licensed under <<optional>> a <<end>> cc by nc <<optional>> nd <<end>> <<optional>> sa <<end>> <<optional>> <<var:1-2>> <<end>>"),
    ("cc-by-notice", "licensed under <<optional>> a <<end>> cc by <<optional>> sa <<end>> <<var:1-1>> 0"),
    ("cc-long-notice", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<optional>> <<var:1-3>> <<end>> license"),
    ("gpl-notice", "licensed under the <<optional>> gnu <<end>> <<optional>> lesser <<end>> <<optional>> affero <<end>> general public license <<optional>> version <<var:1-2>> <<end>>"),
    ("reserved-notice", "copyright <<optional>> c <<end>> <<var:1-8>> all rights reserved"),
    ("public-domain-notice", "<<optional>> dedicated <<end>> <<optional>> released <<end>> to the public domain"),
)

#: Parts of public licenses, with names and numbering of clauses as replaceable or optional regions.
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<optional>> <<var:1-1>> <<end>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<optional>> <<var:1-1>> <<end>> Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<optional>> <<var:1-1>> <<end>> Neither the name of <<var:1-12>> nor the names of <<optional>> its <<end>> <<optional>> <<var:1-3>> <<end>>
contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var:1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_GPL_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<optional>> Lesser <<end>> <<optional>> Affero <<end>> General Public License for more details."""

#: Whole licenses and whole notices, under labels of their common short names.
BODIES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<optional>> (including the next paragraph) <<end>>
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:1-6>> DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-6>>
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<var:1-8>> Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License."""),
    ("gpl-or-later", f"""is free software; you can redistribute it and/or modify it under the terms of the GNU <<optional>> Lesser <<end>>
        <<optional>> Affero <<end>> General Public License as published by the Free Software Foundation; either version <<var:1-2>> of the License, or
        (at your option) any later version. {_GPL_END}"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at <<var:1-6>>"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means."""),
)
TEMPLATES = (*TEMPLATES, *BODIES)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_LOWER))


_WORDS = re.compile(WORD)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Automaton:
    """States are places in a template; an arc reads one given word (or any, for a variable) and free arcs skip."""

    def __init__(self, wording: str):
        self.arcs: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        opened: list[int] = []
        at = 0

        def new() -> int:
            self.arcs.append([])
            self.free.append([])
            return len(self.arcs) - 1

        for part in re.findall(rf"<<.*?>>|{WORD}", wording.translate(_LOWER)):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.free[opened.pop()].append(at)
            elif part.startswith("<<var:"):
                lo, hi = map(int, part[6:-2].split("-"))
                skips = []
                for i in range(hi):
                    if i >= lo:
                        skips.append(at)
                    self.arcs[at].append((None, to := new()))
                    at = to
                for s in skips:
                    self.free[s].append(at)
            else:
                if not opened:
                    self.mandatory.append(part)
                self.arcs[at].append((part, to := new()))
                at = to
            if part.startswith("<<") and part != "<<optional>>" or opened:
                # a region must not begin where another begins, else its skip would be another's too
                self.free[at].append(to := new())
                at = to
        if opened:
            raise ValueError("an optional region has no end")
        if not self.mandatory:
            raise ValueError("a template needs a mandatory word outside its optional regions")
        self.last = at
        self.first = {w for s in self._closed({0}) for w, _ in self.arcs[s]}

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: Sequence[str], at: int) -> int:
        """Number of words of the longest match that starts at ``at``; 0 if there is none."""
        states, best = self._closed({0}), 0
        for i in range(at, len(words)):
            states = self._closed({t for s in states for w, t in self.arcs[s] if w is None or w == words[i]})
            if not states:
                break
            if self.last in states:
                best = i + 1 - at
        return best


def _anchor(words: Sequence[str]) -> str:
    """The mandatory word by which texts are preselected: the longest one."""
    return max(words, key=lambda w: (len(w), w))


def _scan(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [(label, Automaton(wording)) for label, wording in templates]
        split = [(tuple(p.split()), label) for p, label in phrases]
        starts = {p[0] for p, _ in split} | {w for _, a in automata for w in a.first}
        anywhere = None in starts
        for batch in batches:
            out = []
            for text in batch["text"]:
                row = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
                if text is not None:
                    words, base, more, spans = words_of(text), set(), set(), []
                    for i, w in enumerate(words):
                        if not anywhere and w not in starts:
                            continue
                        for phrase, label in split:
                            if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                                base.add(label)
                                row["n_base"] += 1
                                row["first_word"] = i if row["first_word"] is None else row["first_word"]
                                row["last_word"] = i
                        for label, a in automata:
                            if (w in a.first or None in a.first) and (n := a.longest(words, i)):
                                more.add(label)
                                spans.append(f"{label}:{i}:{n}")
                    row |= {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": 1.0 if more else 0.5 if base else 0.0, "spans": spans}
                out.append(row)
            found = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("n_base", "first_word", "last_word"):
                found[c] = found[c].astype("Int64")
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), found], axis=1)

    return run


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are read whole, A-Z lower-cased; words are runs of digits, a-z and characters beyond ASCII. n_base counts
    all places of phrases, first_word and last_word are the smallest and largest start of one (null if none). labels
    adds those of matched templates; spans lists them as label:start:words. The score is 1 if a template matches, 0.5
    if only phrases do, 0 otherwise. Null and empty texts have no words and score 0. Only texts that hold a template's
    or phrase's longest mandatory word go to the automata; the others cannot match. Repeated rows stay.
    """
    anchors = sorted({_anchor(p.split()) for p, _ in phrases} | {_anchor(Automaton(t).mandatory) for _, t in templates})
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("text"))
    hit = F.rlike("text", F.lit("|".join(map(re.escape, anchors))))
    rows = folded.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(hit, F.col("text")).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    return rows.mapInPandas(_scan(phrases, templates), schema)
