"""Licence scans: template markup compiled to token automata.

A template is text with two kinds of marked regions: [[...]] is optional, and {{n}} is replaceable by up to n words of any
kind ({{a|b}} by one of the given wordings). Everything else is mandatory and must match word for word. Templates are
compiled to an automaton over words and sought at every place of a text; beside them, plain phrases are counted.

Words: A-Z lower-cased, then runs of ASCII digits, letters and of bytes beyond ASCII.
Defined results: null counts as empty; no match gives null places, empty labels and score 0; repeated rows, null ids and
other columns, whatever their names, aren't read; very long texts are read whole, with the states of one place at a time; an empty table gives an empty result. score is 1 where a template
is accepted, else 0.5 where a phrase stands, else 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_texts

#: Phrases of words and the label that each gives.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public licence notices, and whole licence texts with their disclaimers, as (label, marked-up wording).
TEMPLATES = [
    ("mit", "[[this [[software|work|project|file|code]] is]] {{released|licensed|distributed|available|made available}} under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license [[,]] version 2 [[.0]]"),
    ("cc-by-nc", "[[this [[work|text|page|article]] is]] licensed under [[a|the]] cc by nc [[sa|nd]] [[2|2.0|2.5|3|3.0|4|4.0]] [[international|unported]]"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial [[sharealike|noderivatives|noderivs]] {{4}} license"),
    ("cc-by", "licensed under a creative commons attribution {{2.0|3.0|4.0}} [[international|unported]] license"),
    ("gpl-3", "[[this {{program|work|software|library|file}} is]] licensed under the gnu general public license [[,]] version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license [[or at your option any later version]]"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license [[or at your option any later version]]"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at {{http|https}} mozilla org mpl 2 0",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at {{http|https}} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
    ),
    *(
        (
            f"gpl-{v}",
            "{{2}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
            f"software foundation either version {v} of the license or at your option any later version {{{{2}}}} is distributed in the hope that it will be useful "
            "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
            "license for more details [[you should have received a copy of the gnu general public license along with {{2}} if not see {{8}}]]",
        )
        for v in (2, 3)
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and {{or distribute|distribute}} this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and {{12}} disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness in no event shall {{12}} be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    *(
        (
            label,
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
            "are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            f"documentation and or other materials provided with the distribution {third} this software is provided by {{{{12}}}} as is and any express or implied "
            "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
            "event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
            "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
            "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
            "even if advised of the possibility of such damage",
        )
        for label, third in (
            ("bsd-2", ""),
            ("bsd-3", "[[3]] neither the name of {{12}} nor the names of {{its|the}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        )
    ),
]

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MARK = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|\||[^\[\]{}|]+")


def license_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Automaton:
    """States are numbers; moves[s] maps a word to next states, any_[s] holds next states by whatever word, skips by none."""

    label: str
    moves: list[dict[bytes, list[int]]]
    any_: list[list[int]]
    skips: list[list[int]]
    start: int
    end: int
    needed: tuple[bytes, ...]
    first: frozenset[bytes] = frozenset()

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at a word, or -1."""
        states, best, i = self.closure({self.start}), -1, at
        while states:
            if self.end in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({t for s in states for t in (*self.moves[s].get(w, ()), *self.any_[s])})
            i += 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Compiles marked-up wording. Mandatory words become `needed`: a text without one of them can't match."""
    a = Automaton(label, [], [], [], 0, 0, ())
    needed: set[bytes] = set()

    def state() -> int:
        for x, empty in ((a.moves, dict), (a.any_, list), (a.skips, list)):
            x.append(empty())
        return len(a.moves) - 1

    def wording(text: str, s: int) -> int:
        for w in license_words(text):
            t = state()
            a.moves[s].setdefault(w, []).append(t)
            s = t
        return s

    parts = _MARK.findall(markup)

    def sequence(i: int, s: int, depth: int) -> tuple[int, list[int]]:
        """Compiles until the region closes: the part reached and the ends of the branches."""
        begin, ends = s, []
        while i < len(parts):
            p = parts[i]
            if p == "]]":
                return i, [*ends, s]
            if p == "|":
                ends.append(s)
                s = begin
            elif p == "[[":
                inner = state()
                a.skips[s].append(inner)
                i, branch = sequence(i + 1, inner, depth + 1)
                after = state()
                for b in branch:
                    a.skips[b].append(after)
                a.skips[s].append(after)
                s = after
            elif p.startswith("{{"):
                body, after = p[2:-2], state()
                if body.isdigit():
                    for _ in range(int(body)):
                        t = state()
                        a.skips[s].append(after)
                        a.any_[s].append(t)
                        s = t
                    a.skips[s].append(after)
                else:
                    for option in body.split("|"):
                        inner = state()
                        a.skips[s].append(inner)
                        a.skips[wording(option, inner)].append(after)
                s = after
            else:
                if not depth:
                    needed.update(license_words(p))
                s = wording(p, s)
            i += 1
        return i, [*ends, s]

    a.start = state()
    _, branch = sequence(0, a.start, 0)
    a.end = state()
    for b in branch:
        a.skips[b].append(a.end)
    # long words first: they are the rarest
    a.needed = tuple(b" " + w + b" " for w in sorted(needed, key=lambda w: (-len(w), w)))
    a.first = frozenset(w for s in a.closure({a.start}) for w in a.moves[s])
    return a


def scan_text(text: str | None, automata: list[Automaton], phrases: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
    words = license_words(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases.items():
        sought = f" {phrase} ".encode()
        at, word, counted = joined.find(sought), 0, 0
        while at >= 0:
            word, counted = word + joined.count(b" ", counted, at), at
            starts.append(word)
            base.add(label)
            at = joined.find(sought, at + 1)
    found = set()
    for a in automata:
        if a.label in found or not all(w in joined for w in a.needed):
            continue
        if any(a.match(words, i) >= 0 for i, w in enumerate(words) if w in a.first):
            found.add(a.label)
    score = 1.0 if found else 0.5 if base else 0.0
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | found)), score,
    )


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id and the columns of SCAN. One pass over the texts, no shuffle."""
    automata = [compile_template(*t) for t in templates or TEMPLATES]
    phrases = phrases or PHRASES

    def run(texts: list) -> list:
        return list(zip(*(scan_text(t, automata, phrases) for t in texts), strict=True)) or [[]] * 7

    return map_texts(docs, ["doc_id"], SCAN, run)
