"""Licence scans: a generalised suffix automaton of licence texts gives each document's matching statistics.

The automaton holds the word sequences of all templates and base phrases. A document's words are streamed through it: at each word it knows the
longest run ending there that stands in some template, and where. From that come

* base places: a phrase stands where the run is long enough and the phrase's state is the current one or a suffix of it;
* spans: runs of at least LEAST words that can't be extended are anchors; anchors in the same order in document and template, at most GAP words apart
  in the document, are chained, and a chain that covers at least SHARE of the template is a span of it. Of spans over the same words the one that
  covers more stays, so that a notice isn't also taken for a relative that shares most of its words.

Only words in known pairs enter the automaton, for every run of two words or more is made of such pairs; pairs are looked up in whole arrays. Nothing is
shuffled; the automaton (about 1,500 words, fixed) goes with the task.

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z only. Null and empty texts have no words, places or labels and
score 0. Rows that repeat an id get a row each; a null id stays null. Extra columns are ignored. The score is the largest share of a template or
phrase that the document covers in order: 1 where a base phrase stands.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, prefix_hashes, span_hashes, words

LEAST, GAP, SHARE = 4, 30, 0.6

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The licences' own notices, as published by their authors.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should
        have received a copy of the GNU Lesser General Public License along with this library""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should
        have received a copy of the GNU Affero General Public License along with this program.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions""",
}

#: Bytes that stand between words, after lower-casing.
BREAK = np.ones(256, dtype=bool)
BREAK[0x30:0x3A] = BREAK[0x61:0x7B] = BREAK[0x80:] = False


class Automaton:
    """The generalised suffix automaton of some word sequences: every run of words that stands in one of them is a path from state 0."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, last word) of each state's runs
        for s, sequence in enumerate(sequences):
            state = 0
            for p, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].append((s, p))
        # a state's runs also end where longer runs with them as suffix end
        for state in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, source: int, word: bytes) -> int:
        """The state of source's longest run and word, parted from the longer runs that share its place if need be."""
        target = self.next[source][word]
        if self.length[target] == self.length[source] + 1:
            return target
        part = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = part
            source = self.link[source]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:  # an earlier sequence has this run
            return self._split(last, word)
        state = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word)
        return state

    def statistics(self, sequence: list[bytes]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest known run that ends there."""
        state, length, edges, link = 0, 0, self.next, self.link
        for word in sequence:
            while state and word not in edges[state]:
                state = link[state]
                length = self.length[state]
            to = edges[state].get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield state, length


def split_words(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    s, e, _ = words(data, np.array([0, len(data)]), BREAK)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Scanner:
    """Finds phrases and spans of templates in word sequences."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(split_words(p), label) for p, label in phrases.items()]
        self.templates = [(split_words(t), label) for label, t in templates.items()]
        sequences = [t for t, _ in self.templates] + [p for p, _ in self.phrases]
        self.sam = sam = Automaton(sequences)
        # the phrases that end with each state's run: those of its suffix links, and its own from some length on
        own: dict[int, list[int]] = {}
        for k, (phrase, _) in enumerate(self.phrases):
            state = 0
            for word in phrase:
                state = sam.next[state][word]
            own.setdefault(state, []).append(k)
        self.found: list[list[tuple[int, int]]] = [[] for _ in sam.link]
        for state in sorted(range(1, len(sam.link)), key=lambda x: sam.length[x]):
            self.found[state] = self.found[sam.link[state]] + [(len(self.phrases[k][0]), k) for k in own.get(state, ())]
        vocabulary = sorted({w for s in sequences for w in s})
        self.hashes = np.sort(self._hashes(vocabulary))
        number = {w: int(np.searchsorted(self.hashes, h)) for w, h in zip(vocabulary, self._hashes(vocabulary), strict=True)}
        self.pairs = np.unique(np.array([number[a] * len(number) + number[b] for s in sequences for a, b in zip(s, s[1:])], dtype=np.int64))
        self.vocabulary = frozenset(vocabulary)

    @staticmethod
    def _hashes(vocabulary: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        return span_hashes(prefix_hashes(data), np.append(0, ends[:-1]), ends)

    def stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each maximal run of words whose neighbours are known pairs."""
        if len(starts) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = span_hashes(prefix_hashes(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        ok = np.flatnonzero(known[:-1] & known[1:] & (rows[:-1] == rows[1:]))
        ok = ok[np.isin(at[ok] * len(self.hashes) + at[ok + 1], self.pairs)]
        if not len(ok):
            return ok, ok
        new = np.append(True, np.diff(ok) > 1)
        return ok[new], ok[np.append(new[1:], True)] + 1

    def run(self, sequence: list[bytes], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, first word) of the phrases, (template, document's and template's word after the run, length) of the anchors."""
        places, anchors = [], []
        sam, n = self.sam, len(self.templates)
        stats = list(sam.statistics(sequence))
        for i, (state, length) in enumerate(stats):
            places += [(k, first + i + 1 - size) for size, k in self.found[state] if size <= length]
            if length >= LEAST and (i + 1 == len(stats) or stats[i + 1][1] != length + 1):
                anchors += [(s, first + i + 1, p + 1, length) for s, p in sam.ends[state] if s < n]
        return places, anchors

    def spans(self, anchors: list[tuple[int, int, int, int]]) -> tuple[float, list[tuple[int, int, int, int]]]:
        """The largest share of a template that a chain covers, and (template, first word, word after, words covered) of the spans that stay."""
        best, chains = 0.0, {}
        before: list[tuple[int, int, int, int, int]] = []  # template, document's and template's end, covered, chain's first word
        for s, d, t, length in sorted(anchors):
            if before and before[-1][0] != s:
                before = []
            covered, start = length, d - length
            for _, d0, t0, c0, start0 in before:
                gain = min(length, d - d0, t - t0)
                if gain > 0 and d - length - d0 <= GAP and c0 + gain > covered:
                    covered, start = c0 + gain, start0
            before = [b for b in before if d - b[1] <= GAP + len(self.templates[s][0])] + [(s, d, t, covered, start)]
            share = covered / len(self.templates[s][0])
            best = max(best, share)
            if share >= SHARE and covered > chains.get((s, start), (0, 0))[0]:
                chains[s, start] = covered, d
        kept: list[tuple[int, int, int, int]] = []
        for (s, a), (covered, b) in sorted(chains.items(), key=lambda x: (-x[1][0], x[0])):
            if not any(a < y and x < b and (c > covered or s == k) for k, x, y, c in kept):
                kept.append((s, a, b, covered))
        return best, kept


@functools.lru_cache(maxsize=4)
def _scanner(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> Scanner:
    """Built once a worker."""
    return Scanner(dict(phrases), dict(templates))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, word), spans (label, first word, word after, words covered), score."""
    what = tuple((phrases or PHRASES).items()), tuple((templates or TEMPLATES).items())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*what)
        place, span = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.int64())])
        for batch in batches:
            for lo, data, offsets in chunks(batch.column("text")):
                data, n = LOWER[data], len(offsets) - 1
                s, e, rows = words(data, offsets, BREAK)
                count, first = np.bincount(rows, minlength=n), np.searchsorted(rows, np.arange(n))
                places, anchors = [[] for _ in range(n)], [[] for _ in range(n)]
                for a, b in zip(*(x.tolist() for x in scanner.stretches(data, s, e, rows)), strict=True):
                    r = rows[a]
                    sequence = [data[s[i] : e[i]].tobytes() for i in range(a, b + 1)]
                    p, q = scanner.run(sequence, int(a - first[r]))
                    places[r] += p
                    anchors[r] += q
                chains = [scanner.spans(x) if x else (0.0, []) for x in anchors]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), pa.array(count, pa.int64()),
                        pa.array([[{"label": scanner.phrases[k][1], "word": w} for k, w in x] for x in places], pa.list_(place)),
                        pa.array([[{"label": scanner.templates[t][1], "first": a, "after": b, "covered": c} for t, a, b, c in x] for _, x in chains], pa.list_(span)),
                        pa.array([1.0 if p else min(1.0, best) for p, (best, _) in zip(places, chains, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "n_words", "places", "spans", "score"],
                )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(scanned, f"doc_id {kind}, n_words long, places array<struct<label string, word long>>, spans array<struct<label string, first long, after long, covered long>>, score double")


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat("places.label", "spans.label")).alias("labels"), "score",
    )
