"""Licence scans: which licence notices a text holds, where, and how much of each.

A text that has enough of a template lacks at most a known number of its words; so of one more than that
one at least is there. These fingerprints are the template's words that are likely to be rare. The
inverted index from them to templates and places picks candidates among a document's words; those with
enough of the template's words near them are aligned word by word within a band around each diagonal that
a fingerprint's match can be in the band of, and reported with the share of the template's words that
match and the characters from its first to its last one. So nothing is missed that alignment at all
places would find.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bounded_batches, slices

#: Words of a template at least.
SHORTEST = 3
#: Words that are frequent in any text: fingerprints only if a template has too few others.
FREQUENT = frozenset("a an and any are as at be by can for from has have if in into is it its may no nor not of on or other that the their this to under use was which with without you your".split())
#: Words by which an alignment may leave its diagonal, besides a tenth of the template's.
BAND = 4
#: The index goes to all tasks, so templates are a bounded list.
MOST_TEMPLATES = 2000

#: Notices in the licences' public wording.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License",
    "MIT licensed notice": "Licensed under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD notice": "Released under the BSD License",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0 work notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 work notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL notice": "This work is licensed under the GNU Lesser General Public License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced or transmitted in any form without permission",
}

_WORD = re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index:
    def __init__(self, templates: dict[str, str], least: float = 0.8):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"at most {MOST_TEMPLATES} templates")
        self.names = sorted(templates)
        self.words = [_words(templates[n]) for n in self.names]
        if short := [n for n, w in zip(self.names, self.words, strict=True) if len(w) < SHORTEST]:
            raise ValueError(f"templates of fewer than {SHORTEST} words: {short}")
        self.counts = [Counter(w) for w in self.words]
        self.need = [max(1, next((m for m in range(len(w)) if m >= least * len(w)), len(w))) for w in self.words]
        spread = Counter(w for c in self.counts for w in c)
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            rare = sorted(range(len(words)), key=lambda i: (words[i] in FREQUENT or len(words[i]) == 1, self.counts[t][words[i]], spread[words[i]], -len(words[i]), i))
            for at in rare[: len(words) - self.need[t] + 1]:
                self.postings.setdefault(words[at], []).append((t, at))

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        """Candidates: (template, word at which it would begin); all others have too few matches, or
        overlap an unchanged copy."""
        found: dict[int, set[int]] = {}
        for at, word in enumerate(words):
            if word in self.postings:
                for t, place in self.postings[word]:
                    found.setdefault(t, set()).add(at - place)
        out = []
        for t, diagonals in found.items():
            n, band = len(self.words[t]), self.band(t)
            near = [d for d in sorted(diagonals) if self.enough(t, words, d - 2 * band, d + n + 2 * band)]
            copies = [d for d in near if self.same(t, words, d)]
            alone = {d for k, d in enumerate(copies) if (not k or d - copies[k - 1] >= n) and (k + 1 == len(copies) or copies[k + 1] - d >= n)}
            begins = {b for d in near if d not in alone for b in range(d - band, d + band + 1)}
            out += [(t, b) for b in sorted(begins | alone) if self.enough(t, words, b - band, b + n + band)]
        return out

    def enough(self, t: int, words: list[str], start: int, stop: int) -> bool:
        """Whether these words hold as many of the template's, in any order, as it needs."""
        counts, need = self.counts[t], self.need[t]
        there = list(filter(counts.__contains__, words[max(start, 0) : max(stop, 0)]))
        return len(there) >= need and sum(min(n, counts[w]) for w, n in Counter(there).items()) >= need

    def same(self, t: int, words: list[str], begin: int) -> bool:
        return begin >= 0 and words[begin : begin + len(self.words[t])] == self.words[t]

    def band(self, t: int) -> int:
        return BAND + len(self.words[t]) // 10

    def align(self, t: int, words: list[str], begin: int) -> tuple[int, int, int]:
        """Matched words of the template, first and last matched word of the text: the alignment with
        most matches (then the shortest) within the band around the diagonal from `begin`."""
        template, band = self.words[t], self.band(t)
        if self.same(t, words, begin):
            return len(template), begin, begin + len(template) - 1
        width = 2 * band + 1
        none = (0, 0, -1, -1)
        # a cell: matches, -gaps, first and last matched word; column c of row i is the text's word begin + i + c - band
        above = [none] * (width + 1)
        for i, word in enumerate(template):
            row, left = [], none
            for c in range(width):
                at = begin + i + c - band
                diagonal = above[c]
                if 0 <= at < len(words) and words[at] == word:
                    best = (diagonal[0] + 1, diagonal[1], diagonal[2] if diagonal[0] else at, at)
                else:
                    best = (diagonal[0], diagonal[1] - 1, *diagonal[2:])
                up = above[c + 1] if c + 1 < width else none
                for other in ((up[0], up[1] - 1, *up[2:]), (left[0], left[1] - 1, *left[2:])):
                    if other[:2] > best[:2]:
                        best = other
                row.append(best)
                left = best
            above = [*row, none]
        best = max(above[:width], key=lambda x: x[:2])
        return best[0], best[2], best[3]


def spans_of(text: str, index: Index, places: Iterable[tuple[int, int]] | None = None) -> list[tuple[str, float, int, int, int]]:
    """Template, coverage, n_matched, start and stop of each hit, aligned at the index's places or those given."""
    words = _words(text)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for t, begin in index.places(words) if places is None else places:
        matched, first, last = index.align(t, words, begin)
        if matched >= index.need[t]:
            found.setdefault(t, []).append((matched, first, last))
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    exact = len(text) == len(text.lower())
    kept: list[tuple[int, int, int, int]] = []
    for t, hits in found.items():
        own: list[tuple[int, int, int]] = []
        for hit in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
            if all(hit[2] < k[1] or hit[1] > k[2] for k in own):
                own.append(hit)
        kept += [(t, *hit) for hit in own]
    share = lambda h: h[1] / len(index.words[h[0]])
    out = []
    for hit in sorted(kept, key=lambda h: (h[2], h[0])):
        t, matched, first, last = hit
        # a notice that differs in a word or two is another licence's
        if any(first <= k[3] and k[2] <= last and (share(k) > share(hit) and k[1] >= matched or share(k) == share(hit) and k[1] > matched and k[2:] == (first, last)) for k in kept):
            continue
        start, stop = spans[first][0], spans[last][1]
        if not exact:  # lower-casing made the text longer: count back
            start, stop = _origin(text, start), _origin(text, stop)
        out.append((index.names[t], share(hit), matched, start, stop))
    return out


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of licence templates in whole texts.

    Returns id_col, template, coverage (share of the template's words that match in order, `least` at
    least), n_matched, start and stop (code points of the text, from the first matched word to after
    the last). A template found at several places gives a row for each; places that overlap give the best
    one, and a place that another template matches better, and with as many words, is that one's alone; so
    is one of which another matches more words from the same first to the same last.
    Null and empty texts have none; repeated rows give repeated results; other columns of
    docs don't matter. No shuffle: the index is of bounded size and goes to all tasks.
    """
    index = Index(TEMPLATES if templates is None else templates, least)
    kind = bounded_batches(docs).schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = spans_of(text, index)
                rows += [k] * len(hits)
                out += hits
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "template", "coverage", "n_matched", "start", "stop"])

    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, template string, coverage double, n_matched long, start long, stop long")


def _origin(text: str, lowered: int) -> int:
    """The place in a text of a place in its lower-cased form."""
    n = 0
    for at, c in enumerate(text):
        if n >= lowered:
            return at
        n += len(c.lower())
    return len(text)
