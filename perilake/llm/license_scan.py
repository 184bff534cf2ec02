"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text and templates are normalised the same way: lower case, words of letters, digits and inner dots,
everything else a gap. Compared is every window of the text's words, across line feeds; line numbers are
only reported. A window is at least as long as its template, or ends with a line. The best one begins with
a bigram of the template and, if longer, ends with one, so only those are tried, and only where enough of them lie close together: with b bigrams in the template,
coefficient d needs b d / (2 - d) shared ones within b (2 - d) / d. Among windows of one beginning the
largest coefficient counts; overlapping matches give way to the one with the most shared bigrams, then the
larger coefficient. All that don't overlap are reported, by the line where they begin. A line that matches
as a whole is reported with the whole line's coefficient.

Templates are a parameter, by default notices of common licences and the full texts of the short ones (MIT, BSD, ISC). They are few and written
here, so what a task gets doesn't grow with the data.

Defined results: a missing or empty text has no licence; every row gives one row, also with repeated
or missing ids; an empty table gives an empty result. Of equal coefficients the template first in
order wins. Texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, query, table

# --- fixed values: notices as licensors ask to state them, and texts of the short licences ---
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", _APACHE),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD}\n{_AS_IS}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", f"{_BSD}\n{_BSD_NAMES}\n{_AS_IS}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", _GPL),
    "ISC": ("Licensed under the ISC License.", _ISC),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Proprietary": ("All rights reserved.",),
}
# ----------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring words; a single word pairs with nothing."""
    return list(zip(words, words[1:], strict=False)) or [(w, "") for w in words]


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / (a.total() + b.total())


class LicenceMatcher:
    """Templates in order of their size, with the bigrams that lead to them."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], least: float):
        self.least = least
        forms = [(Counter(bigrams(_WORD.findall(text.lower()))), name) for name, texts in templates.items() for text in texts]
        self.forms = sorted(((grams.total(), i, grams, name) for i, (grams, name) in enumerate(forms)), key=lambda f: f[:2])
        self.sizes = [f[0] for f in self.forms]
        self.holders: dict[tuple[str, str], set[int]] = defaultdict(set)
        for number, (_, _, grams, _) in enumerate(self.forms):
            for gram in grams:
                self.holders[gram].add(number)
        share = least / (2 - least)
        self.need = [max(1, ceil(b * share - 1e-9)) for b in self.sizes]
        self.reach = [floor(b / share + 1e-9) for b in self.sizes]

    def best(self, grams: list[tuple[str, str]], candidates: set[int]) -> tuple[float, int]:
        """(coefficient, template) of the best candidate that size lets reach the threshold, or (0, -1)."""
        n = len(grams)
        low = bisect_left(self.sizes, n * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, n * (2 - self.least) / self.least + 1e-9)
        counted, top = None, (0.0, -1)
        for number in sorted(candidates):
            if low <= number < high:
                counted = counted or Counter(grams)
                value = dice(counted, self.forms[number][2])
                if value >= self.least - 1e-12 and value > top[0]:
                    top = (value, number)
        return top

    def window(self, grams: list[tuple[str, str]], ends: list[int], marks: list[int], k: int, form: int, stop: int) -> tuple[int, float, int] | None:
        """(shared bigrams, coefficient, end) of the best window from mark ``k`` that ends before ``stop``, if one matches."""
        counts, size, start = self.forms[form][2], self.sizes[form], marks[k]
        stop = min(stop, start + self.reach[form])
        used, shared, top = {}, 0, None
        for i in range(k, len(marks)):
            at = marks[i]
            if at >= stop:
                break
            gram = grams[at]
            n = used[gram] = used.get(gram, 0) + 1
            if n <= counts[gram]:
                shared += 1
                line = ends[bisect_right(ends, at)]
                value = 2 * shared / (max(at + 1 - start, min(size, line - start)) + size)
                if value >= self.least - 1e-12 and (top is None or value >= top[1]):
                    top = (shared, value, at + 1)
        return top

    def match(self, text: str) -> list[tuple[float, str, int]]:
        """(coefficient, licence, line) of all matches that don't overlap, in order of their lines."""
        words, firsts, ends = [], [], []
        for line in text.split("\n"):
            firsts.append(len(words))
            words += _WORD.findall(line.lower())
            ends.append(len(words) - 1)  # after the last bigram of the line
        ends[-1] = max(1, ends[-1])
        grams = bigrams(words)
        places: dict[int, list[int]] = defaultdict(list)
        for i, gram in enumerate(grams):
            if gram in self.holders:
                for form in self.holders[gram]:
                    places[form].append(i)
        heap = []  # most shared bigrams first, then whole lines, larger coefficients, earlier templates
        lines = set()
        for form, marks in places.items():
            need, reach = self.need[form], self.reach[form]
            for k in range(len(marks) - need + 1):
                if marks[k + need - 1] - marks[k] < reach and (found := self.window(grams, ends, marks, k, form, len(grams))):
                    heap.append((-found[0], 1, -found[1], form, marks[k], found[2], k))
                    lines.add(bisect_right(firsts, marks[k]) - 1)
        for line in lines:
            low, high = firsts[line], firsts[line + 1] if line + 1 < len(firsts) else len(words)
            own = bigrams(words[low:high])
            value, form = self.best(own, set().union(*(self.holders.get(g, set()) for g in own)))
            if form >= 0:
                stop = max(low + 1, high - 1)
                marks = places[form][bisect_left(places[form], low) : bisect_left(places[form], stop)]
                shared = round(value * (len(own) + self.sizes[form]) / 2)
                found = [(w[0], -marks[k], w[2]) for k in range(len(marks)) if (w := self.window(grams, ends, marks, k, form, stop))]
                _, start, end = max(found, default=(0, -marks[0], marks[-1] + 1))
                heap.append((-shared, 0, -value, form, -start, end, -1))
        heapify(heap)
        taken: list[tuple[int, int]] = []  # disjoint, in order; an end is the place after the last bigram
        out = []
        while heap:
            shared, kind, value, form, start, end, k = heappop(heap)
            at = bisect_right(taken, (start, len(grams)))
            if at and taken[at - 1][1] + 1 > start:
                continue  # a match reaches here; bigrams across its border are nobody's
            if at < len(taken) and end + 1 > taken[at][0]:
                if kind and (found := self.window(grams, ends, places[form], k, form, taken[at][0] - 1)):
                    heappush(heap, (-found[0], 1, -found[1], form, start, found[2], k))
                continue
            taken.insert(at, (start, end))
            out.append((bisect_right(firsts, start) - 1, kind, start, -value, form))
        return [(value, self.forms[form][3], line) for line, _, _, value, form in sorted(out)]


def scan_licenses(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_matches``, the best ``license`` with its ``dice``, and ``matches`` (``license:line``, comma-joined)."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenceMatcher(templates, least)
        for batch in batches:
            found = [matcher.match(t or "") for t in column_values(batch, "__text")]
            top = [max(f, key=lambda m: m[0]) if f else (None, None, 0) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([t[1] for t in top], pa.string()),
                pa.array([t[0] for t in top], pa.float64()), pa.array([",".join(f"{m[1]}:{m[2]}" for m in f) for f in found], pa.string()),
            ], names=["doc_id", "n_matches", "license", "dice", "matches"])

    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_matches long, license string, dice double, matches string")


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
