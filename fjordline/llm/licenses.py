"""License scans by template-markup matching.

A template is license wording with markup: plain words are mandatory, `[[ ... ]]`
is a region that may be left out (regions nest), `{{a-b}}` is a region replaced by
a to b words of any kind.  Every template compiles to an automaton over words; all
are joined into one nondeterministic automaton, made deterministic as it is used.
It is started at the places whose first two words it can read, and accepts where
the mandatory wording is there exactly, word by word; the longest acceptance of
each template from a place counts.

Defined results: a null or empty text has no words and no match; places may
overlap and are all reported; of templates that match the same words each is told; repeated
documents are scanned each; a very long text is scanned whole; only id and text are read, so columns
that clash are left alone; an empty table gives an empty result.  A match never crosses the end of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordline.llm import text as tx
from fjordline.llm.spark import small_batches


class Template(NamedTuple):
    name: str
    label: str
    markup: str
    base: bool = False


#: Short phrases that any scan reports.
BASE = (
    Template("phrase-cc-by", "cc-by", "cc by", True),
    Template("phrase-gpl", "gpl", "general public license", True),
    Template("phrase-reserved", "reserved", "all rights reserved", True),
)
#: Notices and grants of common licenses.
NOTICES = (
    Template("apache-2.0-notice", "apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    Template("mit-notice", "mit", "[[released]] [[licensed]] under the mit license"),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software [[and associated documentation files]] [[the software]] to deal in the software without restriction"),
    Template("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    Template("cc-by-4.0-notice", "cc-by-4.0", "[[licensed under]] cc by 4 0"),
    Template("cc-by-3.0-notice", "cc-by-3.0", "[[licensed under]] cc by 3 0"),
    Template("cc-by-2.5-notice", "cc-by-2.5", "[[licensed under]] cc by 2 5"),
    Template("cc-by-2.0-notice", "cc-by-2.0", "[[licensed under]] cc by 2 0"),
    Template("cc-by-1.0-notice", "cc-by-1.0", "[[licensed under]] cc by 1 0"),
    Template("cc-by-nc-notice", "cc-by-nc", "[[licensed under]] cc by nc [[{{1-1}} 0]]"),
    Template("cc-by-sa-notice", "cc-by-sa", "[[licensed under]] cc by sa [[{{1-1}} 0]]"),
    Template("gpl-3-notice", "gpl-3.0", "[[this work is]] [[licensed under the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or [[at your option]] any later version]]"),
    Template("gpl-2-notice", "gpl-2.0", "[[this work is]] [[licensed under the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or [[at your option]] any later version]]"),
    Template("mpl-notice", "mpl-2.0", "subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
    Template("copyright-notice", "copyright", "copyright [[c]] {{1-8}} all rights reserved"),
    Template("mit-text", "mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall {{1-8}} be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    Template("isc-text", "isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {{1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall {{1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    Template("bsd-text", "bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[ [[3]] neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ]]
        this software is provided by {{1-8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    Template("apache-2.0-header", "apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    Template("gpl-header", "gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license
        as published by the free software foundation either version {{1-2}} of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"""),
    Template("mpl-2.0-header", "mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"""),
)

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
ANY = -1


class Automaton:
    """The union of the templates' automata.  A state is a place in a template; it has arcs (word or ANY, state) and empty arcs."""

    def __init__(self, templates: tuple[Template, ...]) -> None:
        self.templates = templates
        self.words: dict[str, int] = {}
        self.arcs: list[list[tuple[int, int]]] = []
        self.skips: list[list[int]] = []
        self.final: dict[int, int] = {}
        self.memo: dict[tuple[frozenset, int], frozenset] = {}
        starts = []
        for number, template in enumerate(templates):
            start = at = self._state()
            open_at: list[int] = []
            for mark in _MARK.finditer(template.markup):
                if mark[0] == "[[":
                    open_at.append(at)
                elif mark[0] == "]]":
                    self.skips[open_at.pop()].append(at)
                elif mark[1]:
                    nodes = [at]
                    for _ in range(int(mark[2])):
                        nodes.append(self._step(nodes[-1], ANY))
                    at = self._state()
                    for node in nodes[int(mark[1]) :]:
                        self.skips[node].append(at)
                else:
                    at = self._step(at, self.words.setdefault(mark[0], len(self.words) + 1))
            if open_at:
                raise ValueError(f"{template.name}: a region is not closed")
            self.final[at] = number
            starts.append(start)
        self.total = [len([m for m in _MARK.finditer(t.markup) if m[0] not in ("[[", "]]") and not m[1]]) for t in templates]
        #: No match reads further than this many words from its start.
        self.longest = max((len(_MARK.findall(t.markup)) + sum(int(m[2]) for m in _MARK.finditer(t.markup) if m[2]) for t in templates), default=0)
        self.vocabulary = np.array(sorted(int(tx.seed_of(w)) for w in self.words), np.uint64)
        #: Word numbers by place in the sorted vocabulary; 0 is any other word.
        by_hash = {int(tx.seed_of(w)): n for w, n in self.words.items()}
        self.number = np.array([by_hash[int(h)] for h in self.vocabulary], np.int64)
        self.start = self._close(frozenset(starts))
        size = len(self.words) + 1
        #: Whether some match may begin with these two words.
        self.pairs = np.zeros((size, size), bool)
        for a in range(size):
            one = self.step(self.start, a)
            if one:
                self.pairs[a] = bool(self.accepts(one)) or [bool(self.step(one, b)) for b in range(size)]
        self.alone = np.array([bool(self.accepts(self.step(self.start, a))) for a in range(size)])

    def _state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def _step(self, at: int, word: int) -> int:
        to = self._state()
        self.arcs[at].append((word, to))
        return to

    def _close(self, states: frozenset) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states: frozenset, word: int) -> frozenset:
        found = self.memo.get((states, word))
        if found is None:
            found = self.memo[states, word] = self._close(frozenset(t for s in states for w, t in self.arcs[s] if w in (word, ANY)))
        return found

    def accepts(self, states: frozenset) -> list[int]:
        return [self.final[s] for s in states if s in self.final]

    def matches(self, numbers: list[int]) -> dict[int, int]:
        """Template -> length of its longest match from the first word on."""
        found: dict[int, int] = {}
        states = self.start
        for n, number in enumerate(numbers):
            states = self.step(states, number)
            if not states:
                break
            for t in self.accepts(states):
                found[t] = n + 1
        return found


def _scan(templates: tuple[Template, ...], text_col: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(templates)
        for batch in batches:
            counts, matches = [], []
            for chunk in tx.chunks(batch.column(text_col)):
                w = tx.words(chunk)
                place = np.searchsorted(auto.vocabulary, w.hash)
                place[place == len(auto.vocabulary)] = 0
                numbers = np.where(auto.vocabulary[place] == w.hash, auto.number[place], 0)
                follows = np.zeros(len(numbers), bool)
                follows[:-1] = w.row[:-1] == w.row[1:]
                after = np.zeros(len(numbers), np.int64)
                after[:-1] = numbers[1:]
                begin = np.flatnonzero(np.where(follows, auto.pairs[numbers, after], auto.alone[numbers]))
                own: list[list] = [[] for _ in range(len(w.first) - 1)]
                for at in begin.tolist():
                    r = int(w.row[at])
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    for t, end in sorted(auto.matches(numbers[at : min(b, at + auto.longest)].tolist()).items()):
                        template = templates[t]
                        own[r].append({"template": template.name, "label": template.label, "base": template.base, "start": at - a, "end": at - a + end, "fill": min(1.0, end / auto.total[t])})
                counts += np.diff(w.first).tolist()
                matches += own
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(counts, pa.int64()), pa.array(matches, schema)], names=[*keep, "n_words", "matches"])

    return run


_MATCHES = "array<struct<template string, label string, base boolean, start long, end long, fill double>>"
_ARROW = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("fill", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """Per row of docs: the id, n_words, and matches: every template found with its label, words [start, end) and
    the share of the template's words that the match holds (fill)."""
    small_batches(docs.sparkSession)
    narrow = docs.select(*dict.fromkeys([id_col, text_col]))
    schema = T.StructType([narrow.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("matches", T._parse_datatype_string(_MATCHES))])
    return narrow.mapInArrow(_scan(templates, text_col, [id_col], _ARROW), schema)


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows with counts and places of base phrases, label lists and a score: the best fill of a match that isn't a base phrase, half that of base ones, 0 without any."""
    base = F.filter("matches", lambda m: m.base)
    starts = F.transform(base, lambda m: m.start)
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m.label))), ",")
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: F.when(m.base, m.fill / 2).otherwise(m.fill))), F.lit(0.0))
    return found.select("*", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score")).drop("matches")
