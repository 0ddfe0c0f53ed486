"""License scans: base phrases, and templates with optional and replaceable regions matched as token automata.

Markup of a template: `[[ ... ]]` is optional, `{{n}}` stands for up to n words of any wording, `a|b` for either word,
`!a|b` at the end for a next word that must not follow. Regions can be nested.
A template accepts a place of a text where all its mandatory words stand in order with nothing else between them, unless
a word of NEGATIONS stands right before it. Words are compared as they are; their fingerprints only find the places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as t

#: Fixed phrases and labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_GIVEN = "licensed|released|distributed|available|redistributed|published"
_TERMS = "[[the terms of]]"
_CC = f"{_GIVEN} under {_TERMS} [[a|the]] [[creative commons]] cc"
_CREATIVE = f"{_GIVEN} under {_TERMS} [[a|the]] creative commons attribution"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this {{4}} and associated documentation files the {{4}} to deal in the {{4}} without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{4}} and to permit persons to whom the {{4}} is furnished to do so"
)

# The wording of public licenses and of usual notices.
#: Templates and labels.
TEMPLATES = (
    ("licensed under [[the terms of]] [[the]] apache license [[version]] 2 [[0]]", "apache-2"),
    ("redistributed under [[the terms of]] the apache license [[version]] 2 [[0]]", "apache-2"),
    (
        "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license "
        "[[you may obtain a copy of the license at {{8}}]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2-notice",
    ),
    (f"{_GIVEN} under {_TERMS} the [[expat]] mit license", "mit"),
    (f"{_MIT} subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the {{{{4}}}}", "mit"),
    (f"{_MIT} the software is provided as is without warranty of any kind", "mit-0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    *(
        (f"{how} the {name} [[as published by the free software foundation]] [[either]] [[version|v]] {n} [[0]] [[of the license]] [[or at your option any later version]]", f"{label}-{n}")
        for how in (f"{_GIVEN} under {_TERMS}", "redistribute it and or modify it under the terms of")
        for name, label in (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"))
        for n in (2, 3)
        if (label, n) != ("agpl", 2)
    ),
    ("gnu general public license version|v 3", "gpl-3"),
    ("gnu general public license version|v 2", "gpl-2"),
    (f"{_CC} by [[4|3|2]] [[0|5]] !nc|sa|nd|4|3|2|0|5", "cc-by"),
    (f"{_CC} by nc [[sa|nd]] [[4|3|2]] [[0|5]]", "cc-by-nc"),
    (f"{_CC} by sa [[4|3|2]] [[0|5]]", "cc-by-sa"),
    (f"{_CC} by nd [[4|3|2]] [[0|5]]", "cc-by-nd"),
    (f"{_CC} 0|zero", "cc0"),
    (f"{_CREATIVE} [[4|3|2]] [[0|5]] [[international]] license !nc", "cc-by"),
    (f"{_CREATIVE} noncommercial [[4|3|2]] [[0|5]] [[international]] license", "cc-by-nc"),
    (f"{_CREATIVE} sharealike [[4|3|2]] [[0|5]] [[international]] license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (f"{_BSD} [[3]] neither the name of {{{{8}}}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause"),
    (f"{_BSD} this software is provided by", "bsd-2-clause"),
    (f"{_GIVEN} under {_TERMS} the [[2|3]] [[clause]] bsd [[2|3]] [[clause]] license", "bsd"),
    (f"{_GIVEN} under {_TERMS} the mozilla public license [[v|version]] 2 [[0]]", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
)

#: Words that, right before a template, say the opposite.
NEGATIONS = ("not", "never", "isn", "aren", "wasn", "neither", "nor")
#: The part of a template that has to be gone through before a text that doesn't match it whole gets a score.
SHARE = 0.5


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode("utf-8"), np.uint8)
    return int(t.word_values(t.LOWER[data], t.Words(np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])


@dataclass(frozen=True)
class Automaton:
    """States are places in the template. steps[s]: (words or None for any, next state); skips[s]: states reached by no word."""

    label: str
    steps: tuple
    skips: tuple
    never: frozenset

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def after(self, states: set[int], word: bytes) -> set[int]:
        return self.closure({to for s in states for wanted, to in self.steps[s] if wanted is None or word in wanted})

    def run(self, words: list[bytes]) -> tuple[bool, int]:
        """(accepted, the furthest place of the template) from the first of the words."""
        states, best, end = self.closure({0}), 0, len(self.steps) - 1
        for i, w in enumerate(words):
            states = self.after(states, w)
            if not states:
                break
            best = max(best, max(states))
            if end in states and not (i + 1 < len(words) and words[i + 1] in self.never):
                return True, end
        return False, best

    def openings(self) -> list[tuple[bytes, bytes | None]]:
        """Pairs of words that a match begins with; None for any second word, or none."""
        end, out = len(self.steps) - 1, []
        for wanted, _ in (x for s in self.closure({0}) for x in self.steps[s]):
            if wanted is None:
                raise ValueError("a template begins with a word")
            for first in wanted:
                states = self.after(self.closure({0}), first)
                seconds = [w for s in states for w, _ in self.steps[s]]
                out += [(first, None)] if end in states or None in seconds else [(first, second) for w in seconds for second in w]
        return out


def compile_template(markup: str, label: str) -> Automaton:
    steps, skips = [[]], [[]]
    open_at: list[int] = []
    never: frozenset = frozenset()
    for token in markup.replace("[[", " [[ ").replace("]]", " ]] ").split():
        here = len(steps) - 1
        if token == "[[":
            open_at.append(here)
        elif token == "]]":
            skips[open_at.pop()].append(here)
        elif token.startswith("!"):
            never = frozenset(token[1:].encode().split(b"|"))
        elif token.startswith("{{"):
            for _ in range(int(token[2:-2])):
                here = len(steps) - 1
                steps[here].append((None, here + 1))
                skips[here].append(here + 1)
                steps.append([])
                skips.append([])
        else:
            steps[here].append((frozenset(token.encode().split(b"|")), here + 1))
            steps.append([])
            skips.append([])
    return Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, skips)), never)


OUT = "doc_id long, n_words long, base_places array<struct<label:string,word:long>>, labels array<string>, score double"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def _work(phrases: tuple, templates: tuple) -> Callable:
    base = [(np.array([word_hash(w) for w in p.split()], np.uint64), p.encode().split(), label) for p, label in phrases]
    machines = [compile_template(*x) for x in templates]
    by_first: dict[bytes, list] = {}
    for m in machines:
        for first in {x for x, _ in m.openings()}:
            by_first.setdefault(first, []).append((m, {y for x, y in m.openings() if x == first}))
    pairs = {x for m in machines for x in m.openings()}
    alone = np.array(sorted(word_hash(x.decode()) for x, y in pairs if y is None), np.uint64)
    opening = np.array(sorted({word_hash(x.decode()) for x, y in pairs if y is not None}), np.uint64)
    second = np.array(sorted({word_hash(y.decode()) for _, y in pairs if y is not None}), np.uint64)
    negations = {x.encode() for x in NEGATIONS}
    longest = max((len(m.steps) for m in machines), default=1) + 1

    def work(batches):
        for block in t.blocks(batches):
            data = t.LOWER[block.data]
            found = t.words(data, block.offs, t.ALNUM)
            value = t.word_values(data, found)
            places: dict[int, list] = {}
            labels: dict[int, set] = {}
            score: dict[int, float] = {}
            for hashes, words, label in base:
                n = len(value) - len(hashes) + 1
                at = np.flatnonzero(value[:n] == hashes[0]) if n > 0 else np.zeros(0, np.int64)
                for k in range(1, len(hashes)):
                    at = at[value[at + k] == hashes[k]]
                doc = np.searchsorted(found.offs, at, "right") - 1
                at, doc = (x[at + len(hashes) <= found.offs[doc + 1]] for x in (at, doc))
                for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                    if all(data[found.starts[i + k] : found.ends[i + k]].tobytes() == w for k, w in enumerate(words)):
                        places.setdefault(d, []).append({"label": label, "word": i - int(found.offs[d])})
                        labels.setdefault(d, set()).add(label)
                        score[d] = 1.0
            follows = np.zeros(len(value), bool)
            follows[:-1] = np.isin(value[1:], second)
            at = np.flatnonzero(np.isin(value, alone) | np.isin(value, opening) & follows)
            doc = np.searchsorted(found.offs, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                begin, end = int(found.offs[d]), min(i + longest, int(found.offs[d + 1]))
                word = lambda k: data[found.starts[k] : found.ends[k]].tobytes()
                machines_here = by_first.get(word(i), ())
                before = next((word(k) for k in range(i - 1, begin - 1, -1) if word(k) != b"t"), b"")  # "isn't" is two words
                if not machines_here or before in negations:
                    continue
                words = [word(k) for k in range(i, end)]
                for m, seconds in machines_here:
                    if None not in seconds and not (len(words) > 1 and words[1] in seconds):
                        continue
                    accepted, far = m.run(words)
                    part = far / (len(m.steps) - 1)
                    if accepted:
                        labels.setdefault(d, set()).add(m.label)
                        score[d] = 1.0
                    elif part >= SHARE:
                        score[d] = max(score.get(d, 0.0), 0.9 * part)
            n = len(block.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, mask=block.id_null),
                    pa.array(np.diff(found.offs)),
                    pa.array([sorted(places.get(i, ()), key=lambda x: (x["word"], x["label"])) for i in range(n)], _PLACE),
                    pa.array([sorted(labels.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    pa.array([score.get(i, 0.0) for i in range(n)], pa.float64()),
                ],
                names=["doc_id", "n_words", "base_places", "labels", "score"],
            )

    return work


def license_scan(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_words, base_places (label, word: where a phrase starts), labels (all, sorted), score.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII. score: 1 if anything was accepted, else
    0.9 times the largest part of a template that a place of the text went through, where that is SHARE or more, else 0. Null text: empty. Null ids stay
    null; repeated rows are scanned as often; other columns are not read. Empty table: no rows.
    """
    return t.id_text(docs, id_col, text_col).mapInArrow(_work(tuple(phrases), tuple(templates)), OUT)
