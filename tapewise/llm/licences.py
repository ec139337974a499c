"""Operator 7, license scans by template-markup matching.

A template is mandatory wording with optional regions ``[[ ... ]]`` and
replaceable regions ``<<a-b>>`` (from a to b words of anything). Templates are
compiled into token automata: a text is accepted at the places where all
mandatory words stand exactly, in order, with nothing between but what the
regions allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapewise.llm._common import documents

# The base phrases of the contract and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

_AS_IS = "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_2 = " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = " this software is provided by <<1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Endings of the labels of templates that are less than a licence or its notice: accepted, but not certain.
PARTS = ("-opening", "-name")

# Notices of public licences. [[ ]] is optional, <<a-b>> replaceable.
TEMPLATES = [
    ("mit", "[[this work is]] [[this software is]] [[code is]] released under the [[terms of the]] MIT license"),
    ("mit", "licensed under the [[terms of the]] MIT license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software. " + _AS_IS),
    ("mit-opening", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the Software)]] to deal in the software without restriction"),
    ("apache-2.0", "licensed under the Apache License [[,]] Version 2.0 [[(the License)]]"),
    ("apache-2.0", "released under the Apache License [[,]] Version 2.0"),
    ("apache-2.0-notice", "licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with the License [[you may obtain a copy of the License at <<1-8>>]] unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis without warranties or conditions of any kind either express or implied see the License for the specific language governing permissions and limitations under the License"),
    ("gpl-notice", "<<1-2>> is free software you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation either version <<1-2>> of the license or at your option any later version <<1-2>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the GNU general public license for more details"),
    ("gpl-3.0", "[[this work is]] [[this program is]] licensed under the GNU general public license [[,]] [[as published by the free software foundation, either]] version 3 [[of the license]]"),
    ("gpl-2.0", "[[this work is]] [[this program is]] licensed under the GNU general public license [[,]] [[as published by the free software foundation, either]] version 2 [[of the license]]"),
    ("gpl-any", "free software you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation either version <<1-2>> of the license or at your option any later version"),
    ("lgpl-name", "GNU lesser general public license"),
    ("agpl-name", "GNU affero general public license"),
    ("bsd-2-clause", _BSD + _BSD_2 + _BSD_END),
    ("bsd-3-clause", _BSD + _BSD_2 + " [[3]] neither the name of <<1-12>> nor the names of [[its]] [[their]] [[<<0-8>>]] contributors may be used to endorse or promote products derived from this software without specific prior written permission" + _BSD_END),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "[[licensed]] [[released]] under the [[<<1-2>> clause]] BSD license"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc-opening", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the Mozilla public license [[,]] v 2.0"),
    ("unlicense-opening", "this is free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1.0 [[universal]]"),
    ("cc-by-nc", "[[this work is]] licensed under [[a]] [[the]] CC BY NC [[<<0-1>>]] 4.0"),
    ("cc-by-sa", "[[this work is]] licensed under [[a]] [[the]] CC BY SA [[<<0-1>>]] 4.0"),
    ("cc-by-4.0", "[[this work is]] licensed under [[a]] [[the]] CC BY 4.0"),
    ("cc", "licensed under [[a]] [[the]] creative commons <<1-4>> [[4.0]] [[international]] license"),
    ("reserved-by", "copyright [[c]] <<1-8>> all rights reserved"),
]

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_ISWORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Automaton:
    """States are numbered places in the template; ``step`` maps a state and a
    word to states, ``any`` marks places that take any word, ``skip`` holds the
    places reachable without a word."""

    label: str
    step: list[dict[bytes, set[int]]] = field(default_factory=lambda: [{}])
    any: list[set[int]] = field(default_factory=lambda: [set()])
    skip: list[set[int]] = field(default_factory=lambda: [set()])
    anchor: bytes = b""
    end: int = 0

    def _new(self) -> int:
        self.step.append({})
        self.any.append(set())
        self.skip.append(set())
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``."""
        states, best, i = self._closed({0}), None, at
        while states:
            if self.end in states:
                best = i
            if i >= len(words):
                break
            word = words[i]
            states = self._closed({t for s in states for t in (*self.step[s].get(word, ()), *self.any[s])})
            i += 1
        return best

    def first_words(self) -> set[tuple[bytes, int]]:
        """Words that may come first of the wording, each with how many words of
        replaceable regions may stand before it."""
        out, states, before = set(), self._closed({0}), 0
        while states:
            out |= {(w, before) for s in states for w in self.step[s]}
            states, before = self._closed({t for s in states for t in self.any[s]}), before + 1
        return out


def compile_template(label: str, template: str) -> Automaton:
    """Automaton of a template. Words are those of the scan; optional regions
    nest; unbalanced marks are an error."""
    auto = Automaton(label)
    at, opened = 0, []
    mandatory: list[list[bytes]] = [[]]
    for part in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\[\]<]+|.", template):
        if part == "[[":
            opened.append(at)
            mandatory.append([])
        elif part == "]]":
            auto.skip[opened.pop()].add(at)
            mandatory.append([])
        elif m := re.fullmatch(r"<<(\d+)-(\d+)>>", part):
            lo, hi = map(int, m.groups())
            gates = [at]
            for _ in range(hi):
                new = auto._new()
                auto.any[at].add(new)
                at = new
                gates.append(at)
            for g in gates[lo:-1]:
                auto.skip[g].add(at)
            mandatory.append([])
        else:
            for word in _TOKEN.findall(part.encode().translate(_LOWER)):
                new = auto._new()
                auto.step[at].setdefault(word, set()).add(new)
                at = new
                if not opened:
                    mandatory[-1].append(word)
    if opened:
        raise ValueError(f"optional region without an end: {template}")
    auto.end = at
    # the rarest-looking mandatory word: a text without it needs no automaton
    auto.anchor = max((w for run in mandatory for w in run), key=len)
    return auto


class Scanner:
    """All templates and base phrases; one a worker process."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, base: dict[tuple[str, ...], str] = BASE):
        self.autos = [compile_template(*t) for t in templates]
        self.base = {tuple(w.encode() for w in k): v for k, v in base.items()}
        anchors = {a.anchor for a in self.autos} | {max(k, key=len) for k in self.base}
        self.first = [sorted(a.first_words()) for a in self.autos]
        self.wanted = {k[0] for k in self.base} | {w for first in self.first for w, _ in first}
        self.hint = re.compile(b"|".join(sorted(map(re.escape, anchors))))

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
        inside = _ISWORD[np.frombuffer(raw, dtype=np.uint8)]
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
        if not self.hint.search(raw):
            return n, 0, None, None, "", "", 0.0
        words = _TOKEN.findall(raw)
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.wanted:
                places.setdefault(w, []).append(i)
        starts, base = [], set()
        for phrase, label in self.base.items():
            hits = [i for i in places.get(phrase[0], ()) if tuple(words[i : i + len(phrase)]) == phrase]
            starts += hits
            base |= {label} if hits else set()
        own, covered = set(), 0
        for auto, first in zip(self.autos, self.first, strict=True):
            if auto.anchor not in raw:
                continue
            for i in sorted({i - n for w, n in first for i in places.get(w, ()) if i >= n}):
                if (end := auto.match(words, i)) is not None:
                    own.add(auto.label)
                    covered = max(covered, end - i)
        # an accepted licence or notice is certain, an opening or a name less; a bare phrase is a hint
        score = 1.0 if any(not x.endswith(PARTS) for x in own) else 0.75 if own else 0.5 if base else 0.0
        ends = (min(starts), max(starts)) if starts else (None, None)
        return n, len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | own)), score


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score`` is 1 where a whole licence or notice is accepted, 0.75 where only the
    opening or the name of one is, 0.5 where only a base phrase
    stands, else 0. Whole texts are scanned; null and empty texts have no words
    and no labels. Rows are independent: repeated rows get equal results, an
    empty table gives none."""
    kind = docs.schema[doc].dataType.simpleString()
    held: list[Scanner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Scanner(templates))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["key", *(x.split()[0] for x in RESULT.split(", "))]
        for batch in batches:
            rows = [held[0].scan(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], types[i]) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return docs.select(doc, text).mapInArrow(run, f"key {kind}, {RESULT}").withColumnRenamed("key", doc)


def op7_template_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents against the base phrases and the templates."""
    return scan(documents(spark, sf_dir))
