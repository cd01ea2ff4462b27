"""Licence scans: texts against licence templates by the Dice coefficient over word bigrams.

A notice is any run of words, wherever it lies: across blank lines, in a line, or all of a text. A span is
normalised (lower case, letters and digits only, lines that name no more than a holder gone) and becomes a multiset of
word bigrams. Dice is at most 2 min(a, b) / (a + b) of the two sizes, so spans within bounds of a template's size alone
can reach the least value, and such a span has at least two thirds (at 0.8) of the template's bigrams. So, of any
more than a third of them, it has some; the rarest are the template's anchors (of long templates three fifths, of which
over a quarter of its size must be there). Texts without enough anchors, nearly all, aren't looked at further.

Around anchors each window of words that starts at one of the template's bigrams is compared, at every end within
bounds. Of windows that overlap the one with the most bigrams in common, weighed by Dice, is taken, and what is left is
searched again. If the text, the paragraph or the line that a window lies in matches the same licence too, that is the
span told.

Each text is read whole, once, where it lies; nothing is shuffled. The templates are few and fixed. Time is in
proportion to the text, and around anchors to the template's size for each word.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinspan.plans.scratch import bounded_batches
from twinspan.sources.tables import table

LEAST = 0.8

# Public licence notices in short forms. Complete texts are in licence_texts.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
    ("All-Rights-Reserved", "All rights reserved."),
)

COMPLETE = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")


def _headers() -> Iterator[tuple[str, str]]:
    """The notice at the head of a file of each GNU licence, made of the one of GPL-3.0."""
    base = next(text for name, text in NOTICES if name == "GPL-3.0" and text.startswith("This program is free software"))
    post = ", write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    for name, kind, version in (("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
        text = base.replace("GNU General", f"GNU {kind}").replace("version 3", f"version {version}")
        yield name, text
        if version < "3":
            yield name, text.replace(", see <https://www.gnu.org/licenses/>.", post)


TEMPLATES: tuple[tuple[str, str], ...] = (
    *NOTICES,
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    *_headers(),
    *((name, (pkgutil.get_data("twinspan.llm", f"licence_texts/{name}.txt") or b"").decode()) for name in COMPLETE),
)

_TOKEN = re.compile(r"[^\W_]+")
#: Lines that name a holder only; they differ from copy to copy of a notice.
_MAY_HOLD = re.compile(r"copyright|\(c\)|\xa9", re.I)
_HOLDER = re.compile(r"\W*(?:copyright\b|\(c\)|\xa9)(?!.*rights reserved)", re.I)


def tokens(text: str) -> list[str]:
    """Normalised words: runs of letters and digits in lower case."""
    return _TOKEN.findall(text.lower())


def bigrams(words: list[str]) -> Counter[tuple[str, str]]:
    return Counter(zip(words, words[1:], strict=False))


class Template(NamedTuple):
    name: str
    grams: Counter[tuple[str, str]]
    size: int


class Span(NamedTuple):
    licence: str
    dice: float
    start: int  # in code points of the text
    end: int
    kind: str  # words, line, paragraph or text


class Unit(NamedTuple):
    """A line, a paragraph or the text: its place, and that of its words among all that are compared."""

    start: int
    end: int
    first: int
    last: int


class Window(NamedTuple):
    score: float
    first: int  # words, the last one included
    last: int
    licence: str
    dice: float


class Scanner:
    """Templates in order of size, with an index of their bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        found = [Template(name, bigrams(tokens(text)), len(tokens(text)) - 1) for name, text in templates]
        self.templates = sorted(found, key=lambda t: (t.size, t.name))
        self.sizes = [t.size for t in self.templates]
        self.least = least
        self.index: dict[tuple[str, str], set[int]] = defaultdict(set)
        for i, t in enumerate(self.templates):
            for g in t.grams:
                self.index[g].add(i)
        self.words = {w for g in self.index for w in g}
        # Sizes of a span that some template can match.
        self.fits = {n for t in found for n in range(1, int(t.size * (2 - least) / least) + 2) if 2 * min(n, t.size) >= least * (n + t.size)}
        # At most so many of a template's bigrams can be missing from a span that matches; of any more, the others are there.
        common = Counter(w for t in found for g, k in t.grams.items() for w in g * k)
        self.anchors: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.needed: list[int] = []
        for i, t in enumerate(self.templates):
            missing, chosen = int(t.size - least * t.size / (2 - least) + 1e-9), 0
            for g, k in sorted(t.grams.items(), key=lambda x: (common[x[0][0]] * common[x[0][1]], x[0])):
                if chosen > missing and chosen >= (0.6 * t.size if t.size >= 60 else 0):
                    break
                self.anchors[g].append(i)
                chosen += k
            self.needed.append(chosen - missing)

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The template most like a span, if it reaches the least value; on a tie the first by name."""
        n = len(words) - 1
        if n not in self.fits or self.words.isdisjoint(words):
            return None
        low = bisect_left(self.sizes, n * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, n * (2 - self.least) / self.least + 1e-9)
        grams = bigrams(words)
        near = {i for g in grams for i in self.index.get(g, ()) if low <= i < high}
        scored = [(2 * sum(min(k, grams[g]) for g, k in self.templates[i].grams.items() if g in grams) / (n + self.sizes[i]), self.templates[i].name) for i in near]
        dice, name = min(((-d, x) for d, x in scored), default=(0.0, ""))
        return (name, -dice) if -dice >= self.least else None

    def scan(self, text: str | None) -> list[Span]:
        """Spans that match, in text order. What lies in a match isn't told again for its parts."""
        text = text or ""
        anchors = self.anchors.keys()
        if not _MAY_HOLD.search(text) and not self._zones(list(pairwise(tokens(text)))):
            return []
        words: list[str] = []
        places: list[tuple[int, int]] = []
        lines: list[Unit] = []
        for line in text.split("\n"):
            start, first = lines[-1].end + 1 if lines else 0, len(words)
            if not _HOLDER.match(line) or not anchors.isdisjoint(pairwise(tokens(line))):
                for m in _TOKEN.finditer(line):
                    said = tokens(m[0])
                    words += said
                    places += [(start + m.start(), start + m.end())] * len(said)
            lines.append(Unit(start, start + len(line), first, len(words)))
        if not self._zones(list(pairwise(words))):
            return []
        paragraphs: list[list[Unit]] = [[]]
        for line in lines:
            if text[line.start : line.end].strip():
                paragraphs[-1].append(line)
            elif paragraphs[-1]:
                paragraphs.append([])
        whole = Unit(0, len(text), 0, len(words))
        levels = {"text": [whole], "paragraph": [Unit(x[0].start, x[-1].end, x[0].first, x[-1].last) for x in paragraphs if len(x) > 1], "line": lines}
        told: dict[tuple[int, int], Span] = {}
        for window in self._notices(words):
            if any(s.licence == window.licence and s.start <= places[window.first][0] and places[window.last][1] <= s.end for s in told.values()):
                continue
            found = Span(window.licence, window.dice, places[window.first][0], places[window.last][1], "words")
            for kind, units in levels.items():
                k = bisect_right(units, window.first, key=lambda u: u.first) - 1
                if k < 0 or units[k].last <= window.last or (units[k].start, units[k].end) in told:
                    continue
                hit = self.best(words[units[k].first : units[k].last])
                if hit and hit[0] == window.licence:
                    found = Span(*hit, units[k].start, units[k].end, kind)
                    break
            told[found.start, found.end] = found
        return sorted(told.values(), key=lambda s: (s.start, -s.end))

    def _notices(self, words: list[str]) -> list[Window]:
        """Windows that match and don't overlap, those with the most in common first."""
        grams = list(pairwise(words))
        taken = bytearray(len(words))
        parts, out = [(0, len(grams))], []
        while parts:
            found, again = [], set()
            for low, high in parts:
                found += self._windows(grams, low, high)
            for window in sorted(found, key=lambda w: (-w.score, w[1:])):
                if 1 in taken[window.first : window.last + 1]:
                    again.add(window.first)
                    continue
                taken[window.first : window.last + 1] = b"\1" * (window.last + 1 - window.first)
                out.append(window)
            # Where windows overlapped one that was taken, shorter ones may still match beside it.
            parts = [(m.start(), m.end() - 1) for m in re.finditer(rb"\0{2,}", taken)] if again else []
        return sorted(out, key=lambda w: (-w.score, w[1:]))

    def _windows(self, grams: list[tuple[str, str]], low: int, high: int) -> list[Window]:
        """For each template and each start in a part of a text the end that is most like the template, if that is enough."""
        part = grams[low:high]
        return [w for i, start, end, longest in self._zones(part) for w in self._zone(self.templates[i], part[start:end], low + start, longest)]

    def _zones(self, grams: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
        """Templates, and where windows that match them can lie: those with as many anchors as are needed."""
        hits = self.anchors.keys() & set(grams)
        near: dict[int, list[int]] = defaultdict(list)
        for p, g in enumerate(grams) if hits else ():
            if g in hits:
                for i in self.anchors[g]:
                    near[i].append(p)
        out = []
        for i, at in near.items():
            longest = int(self.sizes[i] * (2 - self.least) / self.least + 1e-9)
            zones: list[list[int]] = []
            for first, last in zip(at, at[self.needed[i] - 1 :], strict=False):
                if last - first >= longest:
                    continue
                start, end = max(0, last - longest + 1), min(len(grams), first + longest)
                if zones and start <= zones[-1][1]:
                    zones[-1][1] = end
                else:
                    zones.append([start, end])
            out += [(i, *z, longest) for z in zones]
        return out

    def _zone(self, t: Template, grams: list[tuple[str, str]], at: int, longest: int) -> list[Window]:
        # A bigram counts in a window if it isn't one more there than the template has: if the one that many back is before the window.
        never = len(grams)
        back = np.full(len(grams), never)
        seen: dict[tuple[str, str], list[int]] = defaultdict(list)
        for p, g in enumerate(grams):
            if k := t.grams.get(g):
                before = seen[g]
                back[p] = before[-k] if len(before) >= k else -1
                before.append(p)
        total = np.concatenate(([0], np.cumsum(back < never)))
        starts = np.flatnonzero(back < never)
        starts = starts[total[np.minimum(starts + longest, len(grams))] - total[starts] >= self.least * t.size / (2 - self.least) - 1e-9]
        sizes = np.arange(1, longest + 1) + t.size
        out = []
        for s in starts.tolist():
            same = np.cumsum(back[s : s + longest] < s)
            dice = 2 * same / sizes[: len(same)]
            k = int(dice.argmax())
            if dice[k] >= self.least:
                out.append(Window(float(same[k] * dice[k]), at + s, at + s + k + 1, t.name, float(dice[k])))
        return out


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, dice, start, end, kind) of every span found in any document.

    start and end count code points. Null and empty texts, and texts without a notice, give no row; a
    document with several notices gives several, and repeated rows are scanned each for itself. On equal
    values the first template by name is given.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            found = [(i, s) for i, text in enumerate(batch.column("text").to_pylist()) for s in scanner.scan(text)]
            ids = batch.column("doc_id").take(pa.array([i for i, _ in found], pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([s[k] for _, s in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *Span._fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licence string, dice double, start long, end long, kind string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
