"""Licence statements and texts found by the Dice coefficient of word bigrams.

A text's words are compared, whatever its lines, in windows sized by each
template: from a bigram that the template has to another, and no longer than the
size bound allows, which the threshold sets. A window's distinct bigrams are
compared to the template's. Templates of which a window can't have enough bigrams
are pruned before any set is made. Words are runs of a-z and 0-9 after lower-casing
A-Z. Each row is worked on alone; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import ship
from motifloom.llm.textkit import Words, chunks, mix, text_buffer

#: Dice coefficient from which a window is a licence statement.
THRESHOLD = 0.75

_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_ENDORSE_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)

# Licence names (SPDX identifiers where there are some), the statements that name them, titles, headers and texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _GRANT_BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _GRANT_BSD + _ENDORSE_BSD + _WARRANTY_BSD),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_JOIN = np.uint64(0xA0761D6478BD642F)


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of each bigram inside a row."""
    on = np.flatnonzero(words.row[1:] == words.row[:-1]) if len(words.row) else np.zeros(0, np.int64)
    return on, mix(words.hash[on] * _JOIN + words.hash[on + 1]) if len(on) else np.zeros(0, np.uint64)


class Matcher:
    """Templates as bigram sets, and an index from bigrams to templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        raw, at = text_buffer(pa.array([text for _, text in templates], pa.string()))
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        words = Words(raw, at, 0, len(templates), _FOLD, _GAP)
        on, value = _bigrams(words)
        self.sets = [set(value[words.row[on] == k].tolist()) for k in range(len(templates))]
        # A window shares at least ``fewest`` of a template's bigrams and has at most ``longest``, or it can't reach the threshold.
        self.fewest = [max(1, int(np.ceil(len(s) * threshold / (2 - threshold) - 1e-9))) for s in self.sets]
        self.longest = [int(len(s) * (2 - threshold) / threshold + 1e-9) for s in self.sets]
        pairs = sorted((b, k) for k, s in enumerate(self.sets) for b in s)
        self.table, first, count = np.unique(np.array([b for b, _ in pairs], np.uint64), return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.owner = np.array([k for _, k in pairs], np.int64)

    def _windows(self, value: np.ndarray, place: np.ndarray, k: int) -> tuple[float, int, int, int] | None:
        """(score, bigrams shared, first, last bigram) of template k's best window in one text.

        ``place``: where ``value`` has its bigrams. Of equal scores the one that
        shares more wins, then the earlier, then the shorter.
        """
        own, m = self.sets[k], len(self.sets[k])
        reach = np.searchsorted(place, place + self.longest[k])
        best = None
        values = None
        for i in np.flatnonzero(reach - np.arange(len(place)) >= self.fewest[k]).tolist():
            a = int(place[i])
            values = value[a : a + self.longest[k]].tolist()
            seen: set[int] = set()
            shared = 0
            for offset, b in enumerate(values):
                if b in seen:
                    continue
                seen.add(b)
                if b in own:
                    shared += 1
                    score = 2.0 * shared / (len(seen) + m)
                    if score >= self.threshold and (best is None or (-score, -shared, a) < (-best[0], -best[1], best[2])):
                        best = (score, shared, a, a + offset)
        return best

    def scan(self, raw: np.ndarray, at: np.ndarray, first: int, last: int) -> Iterator[tuple[int, str, float, int, int, int, int, int]]:
        """(row, name, score, bigrams shared, start and end bytes in the row's text, first and last word) of each licence that a text names, by its best window."""
        words = Words(raw, at, first, last, _FOLD, _GAP)
        on, value = _bigrams(words)
        if not len(on) or not len(self.table):
            return
        spot = np.minimum(np.searchsorted(self.table, value), len(self.table) - 1)
        hit = np.flatnonzero(self.table[spot] == value)
        if not len(hit):
            return
        many = self.count[spot[hit]]
        place = np.repeat(hit, many)
        owner = self.owner[np.repeat(self.first[spot[hit]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        row = words.row[on[place]]
        order = np.lexsort((place, row, owner))
        owner, row, place = owner[order], row[order], place[order]
        edge = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]), [True])))
        begin = np.searchsorted(words.row[on], np.arange(words.rows + 1))
        found: dict[tuple[int, str], tuple] = {}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k, r = int(owner[a]), int(row[a])
            if b - a < self.fewest[k]:
                continue
            low = int(begin[r])
            best = self._windows(value[low : int(begin[r + 1])], place[a:b] - low, k)
            key = (r, self.names[k])
            if best and (key not in found or (-best[0], -best[1], best[2]) < (-found[key][0], -found[key][1], found[key][2])):
                found[key] = (*best, low)
        for (r, name), (score, shared, a, b, low) in sorted(found.items()):
            base = int(at[first + r])
            yield r, name, score, shared, int(words.start[on[low + a]]) - base, int(words.end[on[low + b] + 1]) - base, a, b + 1


_MATCH = pa.struct([("license", pa.string()), ("score", pa.float64()), ("shared", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def scan_licenses(docs: DataFrame, keep: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` and ``matches`` of each text, one for each licence found there, by name.

    A match is the best window of any of the licence's templates: ``license``,
    ``score``, ``shared`` (bigrams), ``start`` and ``end`` (bytes of the UTF-8
    text, from its first to its last word), ``first`` and ``last`` (those
    words' numbers, from 0). Of equal scores the window that
    shares more bigrams wins, then the earlier, then the shorter one. Texts of
    fewer than two words have no bigrams and match nothing, as do null and
    empty texts; repeated rows stay; an empty table gives an empty table.
    Other columns are not read, and kept ones may have any name but
    ``matches``. A text is worked on whole: about 40 bytes of memory a byte of
    the longest text.
    """
    ship(docs.sparkSession)
    narrow = docs.select(*keep, F.col("text").cast("string"))
    names = narrow.columns[:-1]
    narrow = narrow.toDF(*[f"c{k}" for k in range(len(narrow.columns))])  # by place, so that any name will do
    out = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]], "matches array<struct<license:string,score:double,shared:int,start:int,end:int,first:int,last:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            raw, at = text_buffer(batch.columns[-1])
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, last in chunks(at):
                for row, *told in matcher.scan(raw, at, first, last):
                    found[first + row].append(dict(zip(_MATCH.names, told, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_MATCH))], names=[*batch.schema.names[:-1], "matches"])

    return narrow.mapInArrow(run, out).toDF(*names, "matches")


def oracle_sql() -> str:
    """DuckDB SQL of the query ``op7_licenses``."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda text: f"regexp_extract_all({lower.format(text)}, '[a-z0-9]+')"
    grams = "list_transform(list_zip(w, w[2:]), lambda z: z[1] || ' ' || z[2])[:greatest(len(w) - 1, 0)]"
    names = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    return f"""
WITH t AS MATERIALIZED (SELECT k, name, b, len(b) AS m, CAST(greatest(1, ceil(len(b) * {THRESHOLD} / {2 - THRESHOLD} - 1e-9)) AS BIGINT) AS fewest, CAST(floor(len(b) * {2 - THRESHOLD} / {THRESHOLD} + 1e-9) AS BIGINT) AS longest
  FROM (SELECT row_number() OVER () AS k, name, list_distinct({grams}) AS b FROM (SELECT name, {words("text")} AS w FROM (VALUES {names}) AS v(name, text)))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {grams} AS g FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents)),
h AS MATERIALIZED (SELECT r, k, place FROM (SELECT r, unnest(g) AS b, generate_subscripts(g, 1) AS place FROM d) JOIN (SELECT k, unnest(b) AS b FROM t) USING (b)),
dense AS MATERIALIZED (SELECT x.r, x.k, x.place AS a FROM h x JOIN h y ON y.r = x.r AND y.k = x.k JOIN t ON t.k = x.k WHERE y.place >= x.place AND y.place < x.place + t.longest GROUP BY x.r, x.k, x.place, t.fewest HAVING count(*) >= t.fewest),
pairs AS (SELECT dense.r, dense.k, a, y.place AS z FROM dense JOIN h y ON y.r = dense.r AND y.k = dense.k JOIN t ON t.k = dense.k WHERE y.place >= a AND y.place < a + t.longest),
sized AS MATERIALIZED (SELECT pairs.r, pairs.k, a, z, len(list_intersect(list_distinct(d.g[a:z]), t.b)) AS shared, len(list_distinct(d.g[a:z])) AS n, t.m, t.name FROM pairs JOIN d ON d.r = pairs.r JOIN t ON t.k = pairs.k),
scored AS (SELECT *, 2.0::DOUBLE * shared / (n + m) AS score FROM sized),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY score DESC, shared DESC, a, z) AS place FROM scored WHERE score >= {THRESHOLD}) WHERE place = 1)
SELECT d.doc_id, CAST(count(b.name) AS BIGINT) AS n_licenses, coalesce(string_agg(b.name || ':' || b.shared || ':' || (b.a - 1) || ':' || b.z, ',' ORDER BY b.name), '') AS licenses, max(b.score) AS best_score
FROM d LEFT JOIN best b ON b.r = d.r GROUP BY d.r, d.doc_id"""
