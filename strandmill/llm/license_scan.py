"""Licence scanning: normalised text against licence templates by the Dice coefficient over word bigrams.

Every window of words of a text, whatever its line breaks, that is within the size bounds of a template and begins and ends
with one of its bigrams is compared with it, where at least as many of the template's bigrams are close together as a match
needs. (Cutting other bigrams off a window's ends only raises its coefficient, so this finds whatever line, group of lines
or whole text matches.) From each first word the best one is taken. Words are lower-cased runs of ASCII letters, digits and
other non-ASCII characters; bigrams count as a multiset. With A bigrams against B, the coefficient is at most
2 min(A, B) / (A + B), so only windows with B t / (2 - t) <= A <= B (2 - t) / t bigrams are looked at, and a template only
where that many of its bigrams are found.

Defined cases: null and empty texts match nothing. A text of one word has no bigram and matches nothing. A stretch that
matches several templates is given for each. Rows with equal doc_id are scanned each for itself. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.decontamination import _NOT_WORD as NOT_WORD
from strandmill.llm.decontamination import words_of

DICE = 0.8

#: Licence notices as their owners ask for them, the one-line forms in common use, and whole short licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    """Templates (bigrams, id, licence, multiset of bigrams) by size, and which of them hold a bigram."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.all = sorted(((sum((g := bigrams(words_of(t))).values()), f"{name}#{i}", name, g) for name, texts in templates.items() for i, t in enumerate(texts)), key=lambda x: x[:2])
        self.least = least
        self.holders = defaultdict(list)
        for k, (*_, grams) in enumerate(self.all):
            for g in grams:
                self.holders[g].append(k)

    def windows(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(first word, end word, template, dice) of the windows of ``words`` that match, for each first word the best."""
        places = defaultdict(list)
        get = self.holders.get
        for at, g in enumerate(zip(words, words[1:])):
            for k in get(g, ()):
                places[k].append(at)
        out = []
        for k, spots in places.items():
            size, _, _, grams = self.all[k]
            # with c common bigrams the window has c or more, so c >= least / 2 (c + size)
            needed = max(1, ceil(size * self.least / (2 - self.least) - 1e-9))
            widest = int(size * (2 - self.least) / self.least + 1e-9)
            for i in range(len(spots) - needed + 1):
                first = spots[i]
                if spots[i + needed - 1] - first >= widest:
                    continue
                common, seen, best, stop = 0, {}, self.least - 1e-12, 0
                for at in spots[i : i + widest]:
                    if at - first >= widest:
                        break
                    g = (words[at], words[at + 1])
                    seen[g] = seen.get(g, 0) + 1
                    if seen[g] <= grams[g]:
                        common += 1
                        if (d := 2 * common / (at - first + 1 + size)) > best or not stop and d >= best:
                            best, stop = d, at + 2
                if stop:
                    out.append((first, stop, k, best))
        return out


@lru_cache(maxsize=4)
def _default(least: float) -> Templates:
    return Templates(TEMPLATES, least)


def _word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) code points of the words of ``text`` as ``words_of`` finds them."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(NOT_WORD)
    if len(raw) == len(text):
        return [m.span() for m in re.finditer(rb"[^ ]+", raw)]
    owner = [k for k, c in enumerate(text) for _ in c.lower().encode("utf-8", "surrogatepass")]
    return [(owner[m.start()], owner[m.end() - 1] + 1) for m in re.finditer(rb"[^ ]+", raw)]


def scan_text(text: str | None, index: Templates) -> list[tuple[int, int, str, str, float]]:
    """(start, end, template, licence, dice) of the stretches of ``text`` that match, start and end in code points.

    Of overlapping stretches that match one template the one with the largest coefficient is returned, the earliest and
    shortest if tied.
    """
    found = index.windows(words_of(text))
    if not found:
        return []
    spans = _word_spans(text)
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out: list[tuple] = []
    for first, stop, k, d in sorted(found, key=lambda x: (-round(x[3], 12), x[0], x[1])):
        own = taken[k]
        at = bisect_left(own, (stop,))
        if not at or own[at - 1][1] <= first:
            own.insert(at, (first, stop))
            out.append((spans[first][0], spans[stop - 1][1], index.all[k][1], index.all[k][2], d))
    return sorted(out)


SCAN = "doc_id long, start int, end int, template string, license string, dice double"


def _scan(templates: dict[str, tuple[str, ...]] | None, least: float):
    def run(batches):
        index = _default(least) if templates is None else Templates(templates, least)
        names = ["doc_id", "start", "end", "template", "license", "dice"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows = [(i, *x[:4], round(x[4], 6)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan_text(t, index)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def license_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = DICE) -> DataFrame:
    """(doc_id, start, end, template, license, dice) of every match in ``docs`` (doc_id, text); no shuffle."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan(templates, least), SCAN)
