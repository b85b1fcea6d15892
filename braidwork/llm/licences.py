"""Licence scans: normalised text compared to templates by Dice's coefficient over word bigrams.

A text is lower-cased and cut into words of letters, digits and inner dots or hyphens. A template of n bigrams is held
against windows of the text: 2 * shared / (window + n), bigrams counted as often as they occur. At Dice t, a window has n * t / (2 - t) to n * (2 - t) / t
bigrams and shares at least n * t / (2 - t) of the template's. These bounds prune: a template is looked at only
where so many of its bigrams lie within its longest window, and only there are windows compared.

Of windows of one template that overlap, the best stays (the earlier, then the shorter on ties). Of templates
that match in one place, all are given; ``best`` marks the one of the highest Dice, then the longest;
a match inside one of a template at least 1.5 times as long is a part of that and not the best.

Defined cases: a null, empty or blank text has no match; a text shorter than a template may match it within
the size bounds; repeated rows are treated alike; columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import free, read, small_batches
from braidwork.llm.licence_texts import BODIES

LEAST = 0.8
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: A match gives way to one around it whose template is so many times longer.
PART = 1.5
#: Starts times hits that are looked at together.
CELLS = 1 << 20

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: GNU licences whose header notices differ in a word or two: name and version.
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.0": ("Library ", "2"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}


def _gnu_notices(kind: str, version: str) -> tuple[str, ...]:
    """The header with a later version allowed and not, short and with the line on the copy."""
    name, what = f"GNU {kind}General Public License", "library" if kind in ("Library ", "Lesser ") else "program"
    out = []
    for terms in (f"{name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.", f"{name} version {version} as published by the Free Software Foundation."):
        short = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {terms} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        out += [short, f"{short} You should have received a copy of the {name} along with this {what}. If not, see https://www.gnu.org/licenses/."]
    return (*out, f"Licensed under the {name} version {version}.", f"This work is licensed under the {name}, version {version}.")


#: Short lines, notices and whole texts of public licences, by SPDX id.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-2-Clause": (_BSD, _BSD + _DISCLAIMER, "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (_BSD + _THIRD, _BSD + _THIRD + _DISCLAIMER, "Licensed under the BSD 3-Clause License."),
    "ISC": (_ISC, _ISC + _ISC_DISCLAIMER, "Licensed under the ISC License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
for _licence, _named in _GNU.items():
    TEMPLATES[_licence] = tuple(dict.fromkeys((*TEMPLATES.get(_licence, ()), *_gnu_notices(*_named))))
for _licence, _body in BODIES.items():
    TEMPLATES[_licence] = (*TEMPLATES[_licence], _body)


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and where they are."""
    found = [(m[0].lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


class Scanner:
    """The templates' bigrams by number, and which templates hold each."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.least = least
        self.templates = [(licence, Counter(zip(w, w[1:], strict=False))) for licence, texts in templates.items() for w in (words_of(t)[0] for t in texts)]
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.holders[g].append(k)

    def shared(self, n: int) -> int:
        """The fewest of n bigrams that a match shares."""
        return max(1, int(np.ceil(n * self.least / (2 - self.least) - 1e-9)))

    def scan(self, text: str) -> list[tuple[str, int, int, float, bool]]:
        """``licence, start, end, dice, best`` in order of place."""
        words, at = words_of(text)
        places: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            for k in self.holders.get(g, ()):
                places[k].append(i)
        out = []
        for k, hits in places.items():
            licence, grams = self.templates[k]
            n = sum(grams.values())
            if len(hits) >= self.shared(n):
                out += [(licence, at[a][0], at[b][1], dice, n) for a, b, dice in self._windows(words, hits, grams, n)]
        out.sort(key=lambda m: (m[1], m[2], m[0], -m[3]))
        return self._marked(out)

    def _windows(self, words: list[str], hits: list[int], grams: Counter, n: int) -> list[tuple[int, int, float]]:
        """Best windows of words a to b. They begin and end with hits: cutting others off raises Dice.

        Each start's best window is found once; they are taken from a heap, and a start is looked at again only when
        a window taken before cuts off a part of its own.
        """
        longest, need = int(n * (2 - self.least) / self.least + 1e-9), self.shared(n)
        at = np.array(hits)
        # a hit counts in a window if as many equal hits as the template has don't lie between the window's start and it
        seen: dict[tuple[str, str], list[int]] = defaultdict(list)
        full = np.empty(len(at), np.int64)
        for j, i in enumerate(hits):
            g = (words[i], words[i + 1])
            own = seen[g]
            full[j] = own[-grams[g]] if len(own) >= grams[g] else -1
            own.append(j)
        stops = np.searchsorted(at, at + longest)
        heap = self._starts(at, full, stops, n, need)
        heapq.heapify(heap)
        found, taken = [], list[tuple[int, int]]()  # hits of windows that were taken, and of those that touch them
        while heap:
            worse, i, j, stop = heapq.heappop(heap)
            k = bisect(taken, (i, len(at)))
            if k and taken[k - 1][1] > i:
                continue
            end = min(stop, taken[k][0]) if k < len(taken) else stop
            if j < end:
                found.append((int(at[i]), int(at[j]) + 1, -worse))
                insort(taken, (int(np.searchsorted(at, at[i] - 1)), int(np.searchsorted(at, at[j] + 2))))
            elif end - i >= need:
                dice = 2 * np.cumsum(full[i:end] < i) / (at[i:end] - at[i] + 1 + n)
                j = int(dice.argmax())
                if dice[j] >= self.least:
                    heapq.heappush(heap, (-float(dice[j]), i, i + j, end))
        return found

    def _starts(self, at: np.ndarray, full: np.ndarray, stops: np.ndarray, n: int, need: int) -> list[tuple[float, int, int, int]]:
        """``-dice, start, end, stop`` of each hit that begins a window good enough, many starts at a time."""
        out = []
        able = np.flatnonzero(stops - np.arange(len(at)) >= need)
        width = int((stops - np.arange(len(at)))[able].max(initial=0))
        step = max(1, CELLS // max(1, width))
        for a in range(0, len(able), step):
            own = able[a : a + step]
            place = own[:, None] + np.arange(width)
            inside = place < stops[own][:, None]
            place = np.minimum(place, len(at) - 1)
            shared = np.cumsum((full[place] < own[:, None]) & inside, axis=1)
            dice = np.where(inside, 2 * shared / (at[place] - at[own][:, None] + 1 + n), 0.0)
            best = dice.argmax(axis=1)
            top = dice[np.arange(len(own)), best]
            out += [(-float(top[k]), int(own[k]), int(own[k] + best[k]), int(stops[own[k]])) for k in np.flatnonzero(top >= self.least)]
        return out

    @staticmethod
    def _marked(found: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, bool]]:
        best, taken = set(), list[tuple[int, int]]()
        # windows of one length of templates, by start, with the furthest end so far
        around: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for _, a, b, _, n in found:
            starts, ends = around[n]
            starts.append(a)
            ends.append(max(b, ends[-1]) if ends else b)

        def inside(m: tuple[str, int, int, float, int]) -> bool:
            for n, (starts, ends) in around.items():
                if n >= PART * m[4] and (k := bisect(starts, m[1])) and ends[k - 1] >= m[2]:
                    return True
            return False

        part = {k for k, m in enumerate(found) if inside(m)}
        for k in sorted(set(range(len(found))) - part, key=lambda k: (-found[k][3], -found[k][4], found[k][1], found[k][0])):
            if free(taken, *found[k][1:3]):
                best.add(k)
        return [(*m[:4], k in best) for k, m in enumerate(found)]


def scan(docs: DataFrame, text_col: str = "text", into: str = "licences", templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST) -> DataFrame:
    """``docs`` with an array of ``licence, start, end, dice, best`` (code points, ends exclusive)."""
    small_batches(docs.sparkSession)
    templates = templates or TEMPLATES

    @F.pandas_udf("array<struct<licence string, start int, end int, dice double, best boolean>>")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner, names = Scanner(templates, least), ("licence", "start", "end", "dice", "best")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in scanner.scan(t or "")] for t in texts], dtype=object)

    return docs.withColumn(into, matches(F.col(text_col).cast("string")))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and their places in every document; a null or blank text has none, repeated rows are treated alike."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_sort(F.array_distinct(F.transform(F.filter("licences", lambda m: m["best"]), lambda m: m["licence"])))
    spans = F.transform("licences", lambda m: F.concat_ws(":", m["licence"], m["start"].cast("string"), m["end"].cast("string"), F.round(m["dice"], 4).cast("string")))
    return found.select("doc_id", F.array_join(best, ",").alias("licences"), F.array_join(spans, ",").alias("spans"))
