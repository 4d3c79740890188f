"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

The blocks of a text, for a template, are all its windows of as many words as the template has and a fifth more, wherever
lines, sentences or comment marks part them. A block matches if it has at least the threshold of the template's distinct
words. Where matches of several labels overlap, the one of greatest containment names the place, of equal ones the
larger template, and both where these are equal too: so a notice of one license is not also called a cousin's.

The join is exact. Template words are ordered by how many documents of the whole collection have them, rarest first. A
match must share one of the template's first ``size - needed + 1`` words (prefix), so only windows about such words are
looked at; the words of the template about there must be ``needed`` at least (length), and a window is counted as it
slides from one of their places to the next (position). Templates are few and of checked size, so their index travels to
the texts; no text is shuffled.

Defined cases: a null or empty text has no words, empty labels and score 0; overlapping places of a phrase all count;
labels are distinct and sorted; equal rows are scanned alike; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85
#: Words of a window for each word of the template.
SLACK = 1.2
MOST_TEMPLATE_WORDS = 100_000
#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Labels, and texts or usual notices of the licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Bytes to words: A-Z become a-z; digits, letters and all of non-ASCII stay; the rest become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    needed: int
    window: int

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


@dataclass(frozen=True)
class Match:
    template: Template
    common: int
    first: int
    last: int

    @property
    def containment(self) -> float:
        return self.common / len(self.template.words)


def templates(frequency: dict[bytes, int], given: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> list[Template]:
    out = []
    for label, text in given:
        every = words_of(text.encode())
        words = sorted(set(every), key=lambda w: (frequency.get(w, 0), w))
        out.append(Template(label, tuple(words), max(1, math.ceil(threshold * len(words) - 1e-9)), math.ceil(slack * len(every))))
    if sum(len(t.words) for t in out) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have over {MOST_TEMPLATE_WORDS} words")
    return out


def _slide(t: Template, own: frozenset[bytes], words: Sequence[bytes], hits: Sequence[int]) -> Iterator[Match]:
    """Matches of a template about the places of its prefix words: the best window of each run of overlapping ones."""
    best = None
    k = 0
    while k < len(hits):
        low = max(0, hits[k] - t.window + 1)
        while k + 1 < len(hits) and hits[k + 1] - hits[k] < t.window:
            k += 1
        high = min(len(words), hits[k] + t.window)
        k += 1
        places = [(i, words[i]) for i in range(low, high) if words[i] in own]
        if len({w for _, w in places}) < t.needed:
            continue
        inside: Counter[bytes] = Counter()
        begin = 0
        for i, w in places:
            inside[w] += 1
            while i - places[begin][0] >= t.window:
                gone = places[begin][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                begin += 1
            if len(inside) >= t.needed:
                if best and places[begin][0] > best.last:
                    yield best
                    best = None
                if best is None or len(inside) > best.common:
                    best = Match(t, len(inside), places[begin][0], i)
    if best:
        yield best


def settle(found: Sequence[Match]) -> list[Match]:
    """found without the matches that overlap one of another label with more containment, or as much of a larger template."""
    rank = lambda m: (m.containment, m.common)
    ahead = lambda m, x: x.template.label != m.template.label and x.first <= m.last and m.first <= x.last and rank(x) > rank(m)
    return [m for m in found if not any(ahead(m, x) for x in found)]


class Index:
    """Which templates have a word in their prefix."""

    def __init__(self, given: Sequence[Template]):
        self.templates = list(given)
        self.own = [frozenset(t.words) for t in self.templates]
        self.by_word: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.prefix:
                self.by_word.setdefault(w, []).append(k)
        self.prefixes = frozenset(self.by_word)

    def matches(self, words: Sequence[bytes]) -> list[Match]:
        """Every template that a window of the words contains to its threshold, at each of its places."""
        there = self.prefixes.intersection(words)
        hits: dict[int, list[int]] = {}
        if there:
            for i, w in enumerate(words):
                if w in there:
                    for k in self.by_word[w]:
                        hits.setdefault(k, []).append(i)
        return [m for k in sorted(hits) for m in _slide(self.templates[k], self.own[k], words, hits[k])]


def places(words: Sequence[bytes], phrase: str) -> list[int]:
    """The places, in words, where a phrase's words stand one after another."""
    text, sought = b" " + b" ".join(words) + b" ", b" " + phrase.encode() + b" "
    out, at, seen, last = [], text.find(sought), 0, 0
    while at >= 0:
        seen += text.count(b" ", last, at)
        out.append(seen)
        last, at = at, text.find(sought, at + 1)
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))


def word_frequency(docs: DataFrame, given: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text") -> dict[bytes, int]:
    """In how many documents, of all there are, each template word stands: a row per word and task before the sum."""
    sought = frozenset(w for _, t in given for w in words_of(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    n.update(sought.intersection(words_of(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # at most one row per template word


def matches(docs: DataFrame, threshold: float = THRESHOLD, given: Sequence[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label, containment, first_word and n_words of every block that contains a template to the threshold, the best one of those that overlap."""
    index = Index(templates(word_frequency(docs, given, text), given, threshold))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for k, x in enumerate(batch.column(1)):
                for m in index.matches(words_of(x.as_py() or b"")):
                    of.append(k)
                    rows.append((m.template.label, m.containment, m.first, m.last - m.first + 1))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "label", "containment", "first_word", "n_words"])

    chosen = _texts(docs, doc_id, text)
    return chosen.mapInArrow(found, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, label string, containment double, first_word long, n_words long")


def scan(docs: DataFrame, threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES, given: Sequence[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document; score is the largest containment that met the threshold, 1 with a base label, else 0."""
    index = Index(templates(word_frequency(docs, given, text), given, threshold))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                words = words_of(x.as_py() or b"")
                at, base = [], set()
                for phrase, label in phrases:
                    if here := places(words, phrase):
                        at += here
                        base.add(label)
                labels, score = set(base), float(bool(base))
                for m in settle(index.matches(words)):
                    labels.add(m.template.label)
                    score = max(score, m.containment)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    chosen = _texts(docs, doc_id, text)
    return chosen.mapInArrow(scanned, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
