"""License scans by template-markup matching.

A template is mandatory wording with two kinds of marked regions: <<opt>> ... <<end>> may be missing (regions can be
nested), and <<var:N>> stands for up to N words of any wording. It is compiled to an automaton over tokens; a text is
accepted where a run of its words leads from the start to the end, so all mandatory words match exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# The public texts of licenses (whole texts, or the whole notices that licenses ask to put into files)
# in lower case and without punctuation, and the usual lines that name one. Markup is described above; a label may
# have several templates.
MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files <<opt>>the software<<end>> to deal in the software without restriction including without limitation
the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions"""
MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var:6>>
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
of or in connection with the software or the use or other dealings in the software"""
BSD_OPENING = """redistribution and use in source and binary forms with or without modification are permitted provided that
the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the <<opt>>above<<end>> copyright
notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce
the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution"""
BSD_WARRANTY = """this software is provided by <<var:12>> as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but
not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage"""
BSD_NAMES = """<<opt>>3<<end>> neither the name of <<var:12>> nor the names of <<opt>>its<<end>> <<opt>>his<<end>> <<opt>>their<<end>>
contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
FREE_PROGRAM = """this program is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>{kind}<<end>>
general public license as published by the free software foundation either version {number} of the license or <<opt>>at your
option<<end>> any later version <<opt>>this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<opt>>{kind}<<end>> general
public license for more details<<end>>"""
TEMPLATES = {
    "apache-2.0-header": [
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
        law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license"""
    ],
    "apache-2.0-notice": ["licensed under the apache license version 2 0", "licensed under the apache license 2 0", "licensed under the apache 2 0 license"],
    "bsd-2-clause": [f"{BSD_OPENING} {BSD_WARRANTY}"],
    "bsd-3-clause": [f"{BSD_OPENING} {BSD_NAMES} {BSD_WARRANTY}"],
    "cc-by-nc-4.0-notice": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>creative commons<<end>> <<opt>>cc<<end>> by nc <<opt>>4 0 <<opt>>international<<end>><<end>> <<opt>>license<<end>>"],
    "gpl-2.0-header": [FREE_PROGRAM.format(kind="", number="2").replace("<<opt>><<end>>", "")],
    "gpl-3.0-header": [FREE_PROGRAM.format(kind="", number="3").replace("<<opt>><<end>>", "")],
    "gpl-2.0-notice": ["gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 2", "gnu general public license v2"],
    "gpl-3.0-notice": ["gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3", "gnu general public license v3"],
    "isc": [
        """permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and <<var:6>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <<var:6>> be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software"""
    ],
    "mit-text": [
        f"""<<opt>>copyright <<opt>>c<<end>> <<var:12>><<end>> {MIT_GRANT} the above copyright notice and this permission notice <<opt>>including
        the next paragraph<<end>> shall be included in all copies or substantial portions of the software {MIT_WARRANTY}"""
    ],
    "mit-notice": ["<<opt>>released<<end>> <<opt>>licensed<<end>> under the <<opt>>terms of the<<end>> mit license"],
    "mpl-2.0-header": [
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http <<opt>>s<<end>> <<opt>>www<<end>> mozilla org mpl 2 0""",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at https <<opt>>www<<end>> mozilla org mpl 2 0""",
    ],
    "unlicense": [
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means"""
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated
        but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being
        the original software 3 this notice may not be removed or altered from any source distribution"""
    ],
}

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"


class Automaton:
    """States are numbered along the template; a state has steps by one word, a step by any word, and free moves."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        opened: list[int] = []
        needed: list[str] = []
        here = 0
        for part in re.findall(r"<<[^>]*>>|[^<\s]+", template):
            if part == "<<opt>>":
                opened.append(here)
            elif part == "<<end>>":
                start = opened.pop()
                here, before = self.state(), here
                self.free[before].add(here)
                self.free[start].add(here)
            elif part.startswith("<<var:"):
                end = self.state()
                self.free[here].add(end)
                for _ in range(int(part[6:-2])):
                    after = self.state()
                    self.any[here].add(after)
                    self.free[after].add(end)
                    here = after
                here = end
            else:
                after = self.state()
                self.words[here].setdefault(part.encode(), set()).add(after)
                here = after
                if not opened:
                    needed.append(part)
        self.last = here
        self.anchor = max(needed, key=len, default="").encode()  # on every way through, so each accepted text holds it
        self.starts = self.closed({0})
        self.first_words = {w for s in self.starts for w in self.words[s]}
        self.any_first = any(self.any[s] for s in self.starts)

    def state(self) -> int:
        for table in (self.any, self.free):
            table.append(set())
        self.words.append({})
        return len(self.words) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def accept(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted run from `start` stops."""
        states, best = self.starts, None
        for i in range(start, len(words)):
            states = self.closed({t for s in states for t in (*self.words[s].get(words[i], ()), *self.any[s])})
            if not states:
                break
            if self.last in states:
                best = i + 1
        return best


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]] = TEMPLATES):
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ([ts] if isinstance(ts, str) else ts)]
        self.by_word: dict[bytes, list[int]] = {}
        self.anywhere = [i for i, (_, automaton) in enumerate(self.automata) if automaton.any_first]
        for i, (_, automaton) in enumerate(self.automata):
            for word in automaton.first_words:
                if i not in self.anywhere:
                    self.by_word.setdefault(word, []).append(i)
        self.phrases = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
        self.anchors = {max(p, key=len) for p, _ in self.phrases} | {a.anchor for _, a in self.automata}

    def scan(self, text: str | None) -> tuple:
        low = text.encode().lower() if text else b""
        words = WORDS.findall(low)
        base: list[tuple[int, str]] = []
        spans: list[tuple[str, int, int]] = []
        if any(anchor in low for anchor in self.anchors):
            stops: dict[int, int] = {}
            for phrase, label in self.phrases:
                base += [(i, label) for i in range(len(words) - len(phrase) + 1) if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase]
            likely = {k for k, (_, automaton) in enumerate(self.automata) if automaton.anchor in low}
            for i, word in enumerate(words):
                for k in (*self.by_word.get(word, ()), *self.anywhere):
                    if k not in likely:
                        continue
                    label, automaton = self.automata[k]
                    if i >= stops.get(k, 0) and (stop := automaton.accept(words, i)) is not None:
                        stops[k] = stop
                        spans.append((label, i, stop))
        places = [i for i, _ in base]
        base_labels = {label for _, label in base}
        covered = set()
        for _, start, stop in spans:
            covered.update(range(start, stop))
        for i, label in base:
            covered.update(range(i, i + next(len(p) for p, name in self.phrases if name == label)))
        score = len(covered) / len(words) if words else 0.0
        labels = base_labels | {label for label, _, _ in spans}
        return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [{"label": x, "start": a, "stop": b} for x, a, b in spans]


def scan_licenses(docs: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base (places where a base phrase stands), first_word and
    last_word (smallest and largest such place, from 0; null without one), base_labels, labels (with those of the
    accepted templates), score (share of the words that a phrase or an accepted run covers) and the accepted spans.

    Takes doc_id and text; other columns are left out. A-Z are lower-cased; words are runs of ASCII letters, digits
    and characters beyond ASCII. A null text is empty: no words, empty label lists, score 0. Very long texts are read
    whole, in time in proportion to their length and that of the templates. Of one template, runs that overlap count
    once, the earliest and then longest; other templates may overlap them, and the score counts each word once.
    Repeated rows come out alike, null ids as null, an empty table as an empty table.
    """
    wanted = dict(TEMPLATES if templates is None else templates)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for batch in batches:
            rows = [(i, *scanner.scan(t.as_py())) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(search, RESULT)
