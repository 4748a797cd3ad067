"""License scans by template markup.

A template is license wording in which ``[[...]]`` encloses words that may be left out, ``{{a-b}}`` stands for from a to
b words of any kind, and ``{{this|or that}}`` for one of the listed wordings. Templates are compiled into one automaton
over words: each element becomes states, optional ones get empty edges around them, and sets of states are turned into
single states as texts reach them, within a bound. A text holds a template where the automaton accepts a run of its
words, so all mandatory wording matches exactly, word for word; case (of A to Z) and punctuation do not count. Beside
the templates stand the base phrases, found wherever their words stand consecutively.

Each word of a chunk of texts gets its number in the templates' vocabulary (0 for all others) from its hash, in one
pass; the automaton runs from those places alone whose word can begin a template, and no further than its longest
template, so the work is linear in the text.

Per row: ``n_words`` and ``matches``, an array of ``label, start, end, base`` in words from 0, end exclusive. Of the
matches of one template label that begin at or before the end of an earlier one only the first, at its longest, counts; base
phrases count at every place.

Defined results: a null or empty text has no words and no matches; null ids stay null; repeated rows give repeated
results; an empty table gives an empty result; other columns, whatever their names, are set aside in one struct. Texts are
read whole. Words are known by 64-bit hashes. Matches with equal places go by label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import aside, row_chunks, text_buffers, word_bounds, word_hashes

#: The base phrases and what they name.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{1-8}} BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {{1-12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
#: Wording of licenses and of the notices that name them, with the regions that may vary.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the
        Software. """
        + _AS_IS,
    ),
    "isc-text": (
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    "bsd-2-clause-text": (_BSD_START + _BSD_END,),
    "bsd-3-clause-text": (
        _BSD_START
        + """[[3]] Neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. """
        + _BSD_END,
    ),
    "apache-2.0-text": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at [[http]] [[https]] www.apache.org/licenses/LICENSE-2.0 [[html]] [[txt]]
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    "gpl-2.0-or-later-text": ("This {{program|library|software}} is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License or (at your option) any later version",),
    "gpl-3.0-or-later-text": ("This {{program|library|software}} is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or (at your option) any later version",),
    "mit-notice": ("{{released|licensed|distributed|available}} under [[the terms of]] the MIT License",),
    "apache-2.0-notice": ("{{released|licensed|distributed|available}} under [[the terms of]] the Apache License[[,]] [[Version]] 2.0",),
    "gpl-2.0-notice": ("{{released|licensed|distributed|available}} under [[the terms of]] the GNU General Public License[[,]] {{version 2|v2}}[[.0]]",),
    "gpl-3.0-notice": ("{{released|licensed|distributed|available}} under [[the terms of]] the GNU General Public License[[,]] {{version 3|v3}}[[.0]]",),
    "cc-by-notice": ("{{released|licensed|distributed|available}} under [[a]] [[the]] {{CC BY|Creative Commons Attribution}} {{2.0|2.5|3.0|4.0}}",),
    "cc-by-sa-notice": ("{{released|licensed|distributed|available}} under [[a]] [[the]] {{CC BY-SA|Creative Commons Attribution-ShareAlike}} {{2.0|2.5|3.0|4.0}}",),
    "cc-by-nc-notice": ("{{released|licensed|distributed|available}} under [[a]] [[the]] {{CC BY-NC|Creative Commons Attribution-NonCommercial}} {{2.0|2.5|3.0|4.0}}",),
    "rights-reserved": ("copyright [[c]] {{1-12}} all rights reserved",),
}

#: Sets of states that a worker keeps as single states before it starts anew.
MOST_STATES = 1 << 16
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\s*(\d+)\s*-\s*(\d+)\s*\}\}|\{\{([^{}]*)\}\}|[^\[\]{}]+", re.S)


def words_of(text: str) -> list[str]:
    """Lower-cased words: letters and digits of ASCII and all other characters beyond it."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


class Automaton:
    """All templates as one automaton over word numbers, made deterministic where texts lead."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.labels = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.edges: list[list[tuple[int, int]]] = []  # of each state: a word's number (-1: any word) and where it leads
        self.empty: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.first = self._state()
        for k, label in enumerate(self.labels):
            for markup in templates[label]:
                self.accepts[self._compiled(markup)] = k
        self._reset()
        opening = [t for t, _ in self._moves(self.start)]
        if -1 in opening or self.states[self.start][1]:
            raise ValueError("a template has to begin with a word of its own")
        self.opening = np.array(sorted(set(opening)), np.int64)

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _spell(self, at: int, text: str) -> int:
        for word in words_of(text):
            to = self._state()
            self.edges[at].append((self.vocabulary.setdefault(word, len(self.vocabulary) + 1), to))
            at = to
        return at

    def _compiled(self, markup: str) -> int:
        at, open_regions, done = self.first, [], 0
        for part in _MARKUP.finditer(markup):
            if part.start() != done:
                raise ValueError(f"not markup: {markup[done : part.start()]!r}")
            done = part.end()
            if part[0] == "[[":
                open_regions.append(at)
                at = self._after(at)
            elif part[0] == "]]":
                if not open_regions:
                    raise ValueError("a region ends that did not begin")
                self.empty[open_regions.pop()].append(at)
            elif part[1] is not None:
                least, most = int(part[1]), int(part[2])
                if least > most:
                    raise ValueError(f"no number of words: {part[0]}")
                skips, at = [], self._after(at)
                for i in range(most):
                    if i >= least:
                        skips.append(at)
                    to = self._state()
                    self.edges[at].append((-1, to))
                    at = to
                for x in skips:
                    self.empty[x].append(at)
            elif part[3] is not None:
                end = self._state()
                for way in part[3].split("|"):
                    self.empty[self._spell(self._after(at), way)].append(end)
                at = end
            else:
                at = self._spell(at, part[0])
        if open_regions or done != len(markup):
            raise ValueError("a region does not end")
        return self._after(at)

    def _after(self, at: int) -> int:
        to = self._state()
        self.empty[at].append(to)
        return to

    def _reset(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.states: list[tuple[frozenset, list[int]]] = []
        self.next: list[dict[int, int]] = []
        self.start = self._number({self.first})

    def _number(self, members: set[int]) -> int:
        """The state that stands for ``members`` and all that empty edges reach; -1 for none."""
        todo, held = list(members), set(members)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in held:
                    held.add(x)
                    todo.append(x)
        if not held:
            return -1
        key = frozenset(held)
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append((key, sorted({self.accepts[x] for x in held if x in self.accepts})))
            self.next.append({})
        return self.known[key]

    def _moves(self, state: int) -> Iterator[tuple[int, int]]:
        for x in self.states[state][0]:
            yield from self.edges[x]

    def step(self, state: int, word: int) -> int:
        to = self.next[state].get(word)
        if to is None:
            to = self.next[state][word] = self._number({x for t, x in self._moves(state) if t == word or t == -1})
        return to

    def matches(self, numbers: np.ndarray) -> list[tuple[str, int, int]]:
        """``label, start, end`` in a text whose words have these numbers."""
        found, free = [], [0] * len(self.labels)
        for at in np.flatnonzero(np.isin(numbers, self.opening)).tolist():
            if len(self.states) > MOST_STATES:
                self._reset()
            state, to, ends = self.start, at, {}
            while to < len(numbers):
                state = self.step(state, int(numbers[to]))
                if state < 0:
                    break
                to += 1
                for k in self.states[state][1]:
                    ends[k] = to
            for k, end in ends.items():
                if at >= free[k]:
                    found.append((self.labels[k], at, end))
                    free[k] = end
        return found


class Scanner:
    """Numbers words, finds phrases and runs the automaton; one for each worker process."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        self.automaton = Automaton(templates)
        vocabulary = self.automaton.vocabulary
        self.phrases = [([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(p)], label) for p, label in phrases.items()]
        words = [w.encode() for w in vocabulary]
        ends = np.cumsum([0, *(len(w) + 1 for w in words)])
        hashes = word_hashes(np.frombuffer(b" ".join([*words, b""]), np.uint8), ends[:-1], ends[1:] - 1)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.fromiter(vocabulary.values(), np.int64)[order]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[str, int, int, bool]]]]:
        """The number of words of each text and its matches."""
        data = _LOWER[data]
        starts, ends, counts = word_bounds(data, offsets, _INSIDE)
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        numbers = np.where(self.hashes[at] == hashes, self.numbers[at], 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        found: list[list] = [[] for _ in counts]
        for phrase, label in self.phrases:
            n = len(phrase)
            places = np.flatnonzero(numbers[: max(0, len(numbers) - n + 1)] == phrase[0])
            for k, number in enumerate(phrase[1:], 1):
                places = places[numbers[places + k] == number]
            rows = np.searchsorted(first, places, side="right") - 1
            inside = places + n <= first[rows + 1]
            for row, place in zip(rows[inside].tolist(), (places - first[rows])[inside].tolist()):
                found[row].append((label, place, place + n, True))
        opening = np.flatnonzero(np.isin(numbers, self.automaton.opening))
        for row in np.unique(np.searchsorted(first, opening, side="right") - 1).tolist():
            found[row] += [(*x, False) for x in self.automaton.matches(numbers[first[row] : first[row + 1]])]
        for row in found:
            row.sort(key=lambda x: (x[1], x[0], x[2]))
        return counts, found


_MATCH = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``row, text, n_words, matches``: the other columns of each row in a struct, its text, and what it holds.

    Templates and phrases go to each task as they are: they are settings, not data.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    rows = aside(docs)
    out = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("matches", _MATCH)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets):
                counts, found = scanner.scan(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                told = [[{"label": k, "start": a, "end": b, "base": base} for k, a, b, base in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), batch.column("text").slice(low, high - low), pa.array(counts, pa.int64()), pa.array(told, kind)], ["row", "text", "n_words", "matches"])

    return rows.mapInArrow(scan, out)


def digest(found: DataFrame) -> DataFrame:
    """Counts, places and labels of the rows of ``find_licenses``. The score is 1 where a template is accepted, 0.5 where
    phrases alone name a license, else 0."""
    base = F.filter("matches", lambda m: m.base)
    starts = F.transform(base, lambda m: m.start)
    named = lambda x: F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    score = F.when(F.exists("matches", lambda m: ~m.base), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    return found.select(
        "row.doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("matches")).alias("labels"), score.alias("score"),
    )
