"""Licence scans: normalised text against licence templates by the Dice
coefficient over word bigrams.

Text and templates become lower-case words (runs of letters and digits). A
stretch of a text matches a template if twice the bigrams they share, as
multisets, is at least ``least`` of the bigrams both have. That bounds the size
of a stretch from below and above, and the number of template bigrams it needs:
templates and starts outside the bounds are pruned. Only stretches that start
and end with a bigram of the template are looked at, as any other gains by
cutting its ends. Words of many texts at once are compared with the templates' by
hash; a text in which something is found is read again word by word. Of overlapping matches the one with the higher Dice stays,
then the longer one, then the first licence in alphabetical order.

Defined cases: null, empty and word-less texts, and texts of one word, match
nothing (licence null, dice 0). Repeated rows get a row each. Texts are scanned
whole. Only doc_id and text are read, so further columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.8

# Public licence notices and short licence texts, as their owners word them.
_GNU = """This {subject} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General
    Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option)
    any later version. This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General
    Public License for more details."""
_GNU_KINDS = [("AGPL-3.0", "program", "Affero ", "3"), ("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("LGPL-3.0", "program", "Lesser ", "3")]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation
    the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
    to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
    copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software."""
_MIT_END = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
    OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
    ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
    THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""
_BSD_3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
    SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
    THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = [
    *((name, _GNU.format(subject=subject, kind=kind, version=version, stop=":", comma=",")) for name, subject, kind, version in _GNU_KINDS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_END),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


_SPACE = np.array([32], "<u4")


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """Of each code point, whether words() takes it for part of a word."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float = LEAST):
        self.least = least
        lists = [(name, words(t)) for name, t in templates]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in lists for w in ws}))}
        self.each = []  # (licence, number of bigrams, counts by bigram)
        for name, ws in lists:
            ids = [self.vocabulary[w] for w in ws]
            grams = Counter(a * len(self.vocabulary) + b for a, b in zip(ids, ids[1:], strict=False))
            self.each.append((name, len(ids) - 1, grams))
        self.arrays = [np.array(sorted(g)) for _, _, g in self.each]
        self.needed = [least * (size * least / (2 - least) + size) / 2 - 1e-9 for _, size, _ in self.each]
        names = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in self.vocabulary]
        hashes = np.array([common.range_hash(common.prefix_hash(n), np.array([0]), np.array([len(n)]))[0] for n in names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its words' numbers in the vocabulary, -1 for others."""
        out = [np.zeros(0, np.int64)] * len(texts)
        for who, part in common.slices([(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts], b""):
            codes = np.concatenate([x for p in part for x in (np.frombuffer(p, "<u4"), _SPACE)])
            start, end = common.runs(_alnum()[codes])
            h = common.range_hash(common.prefix_hash(codes), start, end)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.order[at], -1)
            cut = np.searchsorted(start, np.cumsum([len(p) // 4 + 1 for p in part]))[:-1]
            for i, x in zip(who, np.split(ids, cut), strict=True):
                out[i] = x
        return out

    def all_of(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """find() of each text."""
        return [self.find(t) if len(ids) > 1 and self.matches(ids) else [] for t, ids in zip(texts, self.ids_of(texts), strict=True)]

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first word, word after the last) by first word."""
        return self.matches(np.array([self.vocabulary.get(w, -1) for w in words(text)], np.int64))

    def matches(self, ids: np.ndarray) -> list[tuple[str, float, int, int]]:
        if len(ids) < 2:
            return []
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        gram = ids[at] * len(self.vocabulary) + ids[at + 1]
        found: list[tuple[float, int, str, int]] = []
        for (name, size, counts), mine, needed in zip(self.each, self.arrays, self.needed, strict=True):
            longest = size * (2 - self.least) / self.least
            if len(gram) < needed:
                continue
            own = np.isin(gram, mine)
            p, g = at[own], gram[own]
            # a start needs enough template bigrams within the longest stretch
            reach = np.searchsorted(p, p + longest, "left") - np.arange(len(p))
            starts = np.flatnonzero(reach >= needed)
            starts = starts[np.argsort(-reach[starts], kind="stable")]
            dice, after = self._best(p, g, starts, reach[starts], size, counts, needed)
            ok = np.flatnonzero(after)
            found += [(d, q - i, name, i) for d, q, i in zip(dice[ok].tolist(), after[ok].tolist(), p[starts[ok]].tolist(), strict=True)]
        found.sort(key=lambda m: (-m[0], -m[1], m[2], m[3]))
        taken, kept = np.zeros(len(ids), bool), []
        for dice, length, name, start in found:
            if not taken[start : start + length + 1].any():
                taken[start : start + length + 1] = True
                kept.append((name, dice, start, int(start + length + 1)))
        return sorted(kept, key=lambda m: m[2])

    def _best(self, p, g, starts, reach, size: int, counts: Counter, needed: float) -> tuple[np.ndarray, np.ndarray]:
        """For each start the highest dice of a stretch from it, of equal ones the
        longest's, and the bigram after it (0: none reaches the least). All starts
        take their next bigram together; they come by falling reach, so those that
        are not at their end are the first ones."""
        best, after = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        if not len(starts):
            return best, after
        # a bigram is shared unless the template's number of it lies between the start and it
        order = np.argsort(g, kind="stable")
        values, first, n = np.unique(g[order], return_index=True, return_counts=True)
        rank = np.arange(len(g)) - np.repeat(first, n) - np.repeat([counts[v] for v in values.tolist()], n)
        before = np.full(len(g), -1)
        own = rank >= 0
        before[order[own]] = order[np.repeat(first, n)[own] + rank[own]]
        shared, until = np.zeros(len(starts), np.int32), -reach
        for j in range(int(reach[0])):
            live = np.searchsorted(until, -j, "left")
            at = starts[:live] + j
            shared[:live] += before[at] < starts[:live]
            near = np.flatnonzero(shared[:live] >= needed)
            end = p[at[near]] + 1
            dice = 2 * shared[near] / (end - p[starts[near]] + size)
            better = (dice >= self.least) & (dice >= best[near])
            best[near[better]], after[near[better]] = dice[better], end[better]
        return best, after


MATCHES = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, licence and dice of its best match, and
    matches (licence, dice, start, end in words)."""
    table = Templates(templates or TEMPLATES, least)

    def work(texts: list) -> dict:
        found = table.all_of(texts)
        best = [max(f, key=lambda m: (m[1], m[3] - m[2], -m[2]), default=(None, 0.0)) for f in found]
        rows = [[dict(zip(("licence", "dice", "start", "end"), m, strict=True)) for m in f] for f in found]
        return {"licence": pa.array([b[0] for b in best], pa.string()), "dice": [float(b[1]) for b in best], "matches": pa.array(rows, MATCHES)}

    return common.per_text(docs, ["doc_id"], "licence string, dice double, matches array<struct<licence:string,dice:double,start:long,end:long>>", work)


def op3_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in every document. The cases are those of the module."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "licence", "dice", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.licence")), ",").alias("licences"))
