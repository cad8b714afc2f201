"""Licence scan with a generalised suffix automaton over the words of licence templates.

A text's words run through the automaton once, which gives the longest match that ends at each word (matching
statistics) and, by its suffix links, all places in templates of its last few words. Places that go on from word to
word are maximal matches. The best chain of matches in order in both text and template gives covered template spans,
and of spans that overlap the one that explains most words stays. Phrases are reported wherever they stand in full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, ascii_words, documents, small_batches

#: Phrase to label; all places where a phrase's words stand consecutively are reported.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_FREE_SOFTWARE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_END = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
    "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
    "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
    "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
    "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom '
    "the Software is furnished to do so"
)

#: (label, template text): whole short licences, and the notices by which works are usually put under a licence.
TEMPLATES: list[tuple[str, str]] = [
    ("gpl-3.0", _FREE_SOFTWARE.format(name="GNU General Public License", version=3)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", _FREE_SOFTWARE.format(name="GNU General Public License", version=2)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", _FREE_SOFTWARE.format(name="GNU Lesser General Public License", version=3)),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", _FREE_SOFTWARE.format(name="GNU Affero General Public License", version=3)),
    ("apache-2.0", _APACHE),
    ("apache-2.0", _APACHE + _APACHE_END),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", _MIT),
    ("mit", _MIT + _MIT_END),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("bsd-2-clause", _BSD),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", _BSD_NAMES),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("isc", _ISC),
    ("isc", _ISC + _ISC_END),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("zlib", _ZLIB),
    ("bsl-1.0", _BOOST),
    ("unlicense", _UNLICENSE),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
] + [(f"cc-by{kind.lower()}-{version}", f"Licensed under CC BY{kind} {version}.") for kind in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND") for version in ("3.0", "4.0")]


class SuffixAutomaton:
    """Of several sequences of integers, with the places where each state's strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, x in enumerate(sequence):
                last = self._extend(last, x)
                self.ends[last].add((s, at))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, x: int) -> int:
        """The state after p by x whose longest string is one longer than p's; cloned where there is none."""
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x)
        return new

    def state_of(self, sequence: Iterable[int]) -> int:
        v = 0
        for x in sequence:
            v = self.next[v][x]
        return v


class LicenseScanner:
    """Finds phrases and covered template spans in texts.

    Matches have at least ``min_match`` words. A span covers at least ``min_coverage`` of its template, and between two
    of its matches lie at most ``max_gap`` words of the text. A template of less than ``whole_below`` words has too
    little to tell it from other sentences, so it must stand in full and without a gap.
    """

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int = 4, min_coverage: float = 0.8, max_gap: int = 30, whole_below: int = 14):
        self.labels = [label for label, _ in templates]
        self.min_match, self.min_coverage, self.max_gap, self.whole_below = min_match, min_coverage, max_gap, whole_below
        words = [ascii_words(t) for _, t in templates] + [ascii_words(p) for p in phrases]
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in x] for x in words]
        n = len(templates)
        self.sizes = [len(x) for x in ids[:n]]
        self.automaton = a = SuffixAutomaton(ids)
        own = defaultdict(list)
        for label, x in zip(phrases.values(), ids[n:]):
            if x:
                own[a.state_of(x)].append((len(x), label))
        # For each state the phrases that end wherever the state's longest string ends, and the places in templates
        # where the last min_match words of its strings end.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in a.link]
        self.places: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for v in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            up = a.link[v]
            self.phrases[v] = self.phrases[up] + own[v]
            if a.length[v] >= min_match:
                self.places[v] = self.places[up] if a.length[up] >= min_match else sorted(e for e in a.ends[v] if e[0] < n)
        self.least = min([min_match, *(len(x) for x in ids[n:] if x)])

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words; (label, first word) of each phrase; (label, first word, last word, coverage) of spans."""
        words = ascii_words(text) if text else []
        ids = list(map(self.vocabulary.get, words))
        found: list[tuple[str, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        if len(ids) - ids.count(None) < self.least:
            return len(words), found, []
        following, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        least, live = self.min_match, {}
        v = n = 0
        for i, x in enumerate(ids):
            if x is None:
                v = n = 0
            else:
                if x not in following[v]:
                    while v and x not in following[v]:
                        v = link[v]
                    n = min(n, length[v])
                if x in following[v]:
                    v = following[v][x]
                    n += 1
                if phrases[v]:
                    found += [(label, i - k + 1) for k, label in phrases[v] if k <= n]
            if n >= least:
                live = self._go_on(matches, live, v, i)
            elif live:
                self._close(matches, live, i)
                live = {}
        self._close(matches, live, len(ids))
        return len(words), found, self._spans(matches) if matches else []

    def _go_on(self, matches: dict, live: dict, v: int, i: int) -> dict:
        """The matches that hold word i, by template and shift of their place, with their first word; the others end before it."""
        now = {}
        for template, last in self.places[v]:
            key = (template, last - i)
            now[key] = live.pop(key, i - self.min_match + 1)
        self._close(matches, live, i)
        return now

    def _close(self, matches: dict, live: dict, end: int) -> None:
        for (template, shift), first in live.items():
            matches[template].append((first, first + shift, end - first))

    def _chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(covered words, first word, end) of the best chain that ends with each match.

        A chain goes forward in text and template; a match counts with what it adds to both.
        """
        out: list[tuple[int, int, int]] = []
        recent: list[int] = []
        found = sorted(found)
        for at, inside, n in found:
            covered, first, end, goal = n, at, at + n, inside + n
            recent = [i for i in recent if at - out[i][2] <= self.max_gap]
            for i in recent:
                before = found[i][1] + found[i][2]
                if found[i][1] <= inside and before < goal and out[i][2] < end:
                    sum_ = out[i][0] + min(n, goal - before, end - out[i][2])
                    if sum_ > covered:
                        covered, first = sum_, out[i][1]
            recent.append(len(out))
            out.append((covered, first, end))
        return out

    def _spans(self, matches: dict) -> list[tuple[str, int, int, float]]:
        """Spans of the chains that cover enough of a template; of overlapping ones the one with most words covered less those missing."""
        spans = []
        for template, found in matches.items():
            size = self.sizes[template]
            if size < self.whole_below:
                chains = [(n, at, at + n) for at, _, n in found if n == size]
            else:
                chains = [c for c in self._chains(found) if c[0] >= self.min_coverage * size]
            spans += [(size - 2 * covered, first, end, self.labels[template], covered / size) for covered, first, end in chains]
        taken: list[tuple[int, int]] = []
        out = []
        for _, first, end, label, coverage in sorted(spans):
            k = bisect_left(taken, (end, 0))
            if k and taken[k - 1][1] > first:
                continue
            insort(taken, (first, end))
            out.append((label, first, end - 1, coverage))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, **how) -> DataFrame:
    """doc_id, n_words, places and spans of every whole text.

    places: array of (label, word) of phrases; spans: array of (label, first_word, last_word, coverage) of
    templates. Words count from 0. Null and empty texts have no word, place or span. Repeated rows give
    repeated rows. Only doc_id and text are read. One pass in linear time, no shuffle; the automaton is of the
    templates' size.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    def make():
        scanner = LicenseScanner(templates, phrases, **how)

        def step(batch: pa.RecordBatch) -> dict:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "n_words": [x[0] for x in found],
                "places": [[{"label": a, "word": b} for a, b in x[1]] for x in found],
                "spans": [[{"label": a, "first_word": b, "last_word": c, "coverage": d} for a, b, c, d in x[2]] for x in found],
            }

        return step

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, make)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licence notices of every text of documents, as counts and label lists."""
    found = scan_licenses(documents(spark, sf_dir))
    base, span = F.col("places.label"), F.col("spans.label")
    best = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, span)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"),
    )
