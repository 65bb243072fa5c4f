"""Licence notices in texts (operator 4): Dice coefficient over word bigrams.

Texts are normalised byte by byte: A-Z lower-cased, every other ASCII sign that is no letter or
digit a blank.  Three kinds of unit are compared with the templates: every line, every paragraph
of several lines (a run of lines with words), and a text of several paragraphs as a whole.  A
licence that no unit reaches is looked for in word windows, whatever lines and paragraphs they
cross: from a template's bigram to another, at most (2 - t) / t times as long as the template.
Two sets of distinct word bigrams score 2 * common / (size + size); for a threshold t only templates
whose size is between t / (2 - t) and (2 - t) / t times the unit's can reach it, and a unit that
holds too few bigrams of any template is never looked at.  A document's best unit per licence is
reported.  A bigram in a window counts for one licence: that of the window that holds most of its
template, so the words of one notice are not taken for a similar one.

The SQL twin states the three units, not the windows; both agree on texts whose notices are units.

It is one scan; templates are the fixed list below or the caller's, at most ``MOST_TEMPLATES``.

Edge cases: null texts and units of fewer than two words match nothing; of equal scores the line
before the paragraph before the text, then the first, is reported; rows with a null id are left out;
rows that share an id are looked at each and reported each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus
from . import textcore as tc
from .decontaminate import NORMAL

THRESHOLD = 0.8
MOST_TEMPLATES = 10_000
UNITS = ("line", "paragraph", "text", "window")
#: Notices and texts by licence.  Their wording is the licences' own.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("proprietary", "All rights reserved."),
]


class Templates:
    """The templates' bigram sets by size, and the fewest of their bigrams that a matching unit holds."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        buf, off = tc.flat(pa.array([t for _, t in templates], pa.string()))
        h, woff = tc.word_hashes(NORMAL[buf], off)
        pairs = tc.rolling(h, 2)
        self.threshold = threshold
        sets = [(name, frozenset(pairs[a : b - 1].tolist())) for (name, _), a, b in zip(templates, woff[:-1], woff[1:], strict=True) if b - a >= 2]
        self.sets = sorted(sets, key=lambda x: len(x[1]))
        self.sizes = np.array([len(s) for _, s in self.sets])
        self.every = np.unique(np.array([x for _, s in self.sets for x in s], np.uint64))
        # which templates hold a bigram, fewest common bigrams and most places of a window that matches
        has = [(int(np.searchsorted(self.every, np.uint64(x))), k) for k, (_, s) in enumerate(self.sets) for x in s]
        at, self.of = np.array(sorted(has), np.int64).reshape(-1, 2).T
        self.begins = np.searchsorted(at, np.arange(len(self.every) + 1))
        self.least = np.ceil(threshold / (2 - threshold) * self.sizes - 1e-9).astype(np.int64)
        self.most = np.floor((2 - threshold) / threshold * self.sizes + 1e-9).astype(np.int64)
        self.fewest = int(np.ceil(threshold / (2 - threshold) * self.sizes.min() - 1e-9)) if sets else 0

    def matches(self, unit: np.ndarray):
        """(licence, score) of templates that the unit's bigrams reach the threshold with."""
        mine = set(unit.tolist())
        n, t = len(mine), self.threshold
        a, b = np.searchsorted(self.sizes, [n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9])
        for name, s in self.sets[a:b]:
            score = 2 * len(mine & s) / (n + len(s))
            if score >= t - 1e-12:
                yield name, score


    def dense(self, at: np.ndarray, which: np.ndarray, doc: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
        """By text and template, the template's bigrams where enough of them stand close together; `at` are the places of known bigrams, `which` and `doc` their numbers and texts."""
        many = self.begins[which + 1] - self.begins[which]
        k = self.of[np.repeat(self.begins[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        order = np.lexsort((at, k, doc))
        at, k, doc = at[order], k[order], doc[order]
        last = np.arange(len(at)) + self.least[k] - 1
        there = np.minimum(last, len(at) - 1)
        full = (last < len(at)) & (k[there] == k) & (doc[there] == doc) & (at[there] - at < self.most[k])
        out: dict[int, dict[int, np.ndarray]] = {}
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])))), [len(at)])) if len(at) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if full[a:b].any():
                out.setdefault(int(doc[a]), {})[int(k[a])] = np.stack([at[a:b], full[a:b]])
        return out

    def windows(self, pairs: np.ndarray, end: int, close: dict[int, np.ndarray]):
        """(licence, score, first word) of the windows of a text that ends at `end`, those with most common bigrams first."""
        found = []
        for k, (hits, full) in close.items():
            size, stop = int(self.sizes[k]), int(self.most[k])
            for x in hits[full > 0].tolist():
                run = pairs[x : min(x + stop, end - 1)]
                mine = hits[np.searchsorted(hits, x) : np.searchsorted(hits, x + len(run))]
                new = np.zeros(len(run), bool)
                new[np.unique(run, return_index=True)[1]] = True
                n = np.cumsum(new)[mine - x]
                c = np.cumsum(new[mine - x])
                score = 2 * c / (n + size)
                j = int(score.argmax())
                if score[j] >= self.threshold - 1e-12:
                    found.append((-int(c[j]), -float(score[j]), x, k, mine[: j + 1], int(n[j])))
        taken: dict[int, str] = {}
        for _, _, x, k, mine, n in sorted(found, key=lambda f: f[:4]):
            name = self.sets[k][0]
            free = [p for p in mine.tolist() if taken.get(p, name) == name]
            score = 2 * len(set(pairs[free].tolist())) / (n + int(self.sizes[k]))
            if score >= self.threshold - 1e-12:
                taken |= dict.fromkeys(free, name)
                yield name, score, x


def units(doc: bytes, words: np.ndarray):
    """(kind, number, first word, end) of each unit; `words` are the starts of the text's words."""
    feeds = np.flatnonzero(np.frombuffer(doc, np.uint8) == 10)
    edge = np.concatenate(([0], np.searchsorted(words, feeds), [len(words)]))
    full = np.flatnonzero(np.diff(edge) > 0)
    for i in full.tolist():
        yield 0, i, int(edge[i]), int(edge[i + 1])
    cut = np.flatnonzero(np.diff(full) > 1) + 1
    blocks = np.split(full, cut) if len(full) else []
    for b in blocks:
        if len(b) > 1:
            yield 1, int(b[0]), int(edge[b[0]]), int(edge[b[-1] + 1])
    if len(blocks) > 1:
        yield 2, 0, 0, len(words)


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence, dice, unit ("line", "paragraph", "text" or "window") and the unit's first line, from 0; one row per document and licence."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES or not 0 < threshold <= 1:
        raise ValueError(f"at most {MOST_TEMPLATES} templates, and a threshold in (0, 1]")

    def run(batches):
        known = Templates(templates, threshold)
        for batch in tc.each(batches):
            ids, (buf, off) = batch.column(0).to_pylist(), tc.flat(batch.column(1))
            out = {"key": [], "licence": [], "dice": [], "unit": [], "line": []}
            for a, b in tc.slabs(off) if len(known.every) else ():
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                norm = NORMAL[part]
                s, e, woff = tc.words(norm, o)
                pairs = tc.rolling(tc.spans_hash(norm, s, e), 2)
                near = np.zeros(len(s) + 1, np.int64)
                where = np.minimum(np.searchsorted(known.every, pairs), len(known.every) - 1)
                near[1 : len(pairs) + 1] = known.every[where] == pairs
                at = np.flatnonzero(near[1 : len(pairs) + 1])
                doc = np.searchsorted(woff, at, "right") - 1
                inside = at + 1 < woff[doc + 1]
                close = known.dense(at[inside], where[at[inside]], doc[inside])
                near = np.cumsum(near)
                for i in np.flatnonzero(near[np.maximum(woff[1:] - 1, woff[:-1])] - near[woff[:-1]] >= known.fewest).tolist():
                    first = int(woff[i])
                    best: dict[str, tuple] = {}
                    for kind, line, x, y in units(part[o[i] : o[i + 1]].tobytes(), s[woff[i] : woff[i + 1]] - o[i]):
                        x, y = x + first, y + first
                        if y - x > 1 and near[y - 1] - near[x] >= known.fewest:
                            for name, score in known.matches(pairs[x : y - 1]):
                                best[name] = min(best.get(name, (0.0, 0, 0)), (-score, kind, line)) if name in best else (-score, kind, line)
                    listed = set(best)
                    for name, score, x in known.windows(pairs, int(woff[i + 1]), close.get(i, {})):
                        if name not in listed:
                            line = int((part[o[i] : s[x]] == 10).sum())
                            best[name] = min(best.get(name, (0.0, 0, 0)), (-score, 3, line))
                    for name in sorted(best):
                        for c, v in zip(out, (ids[a + i], name, -best[name][0], UNITS[best[name][1]], best[name][2]), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("line", pa.int32())])).rename_columns([key, "licence", "dice", "unit", "line"])

    return corpus.usable(docs.select(key, text), key).mapInArrow(run, f"`{key}` long, licence string, dice double, unit string, line int")


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("dice", F.round("dice", 6))


def oracle() -> str:
    quoted = ", ".join("('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    norm = lambda x: f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g')"
    words = lambda x: f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"
    return f"""
WITH templates(licence, tid, body) AS (VALUES {quoted}),
t AS (SELECT licence, tid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT licence, tid, {words('body')} AS w FROM templates) WHERE len(w) >= 2),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS (SELECT r, doc_id, u.i - 1 AS line, {words('ls[u.i]')} AS w FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT *, line - row_number() OVER (PARTITION BY r ORDER BY line) AS block FROM l WHERE len(w) > 0),
p AS (SELECT r, doc_id, block, min(line) AS line, count(*) AS n, flatten(list(w ORDER BY line)) AS w FROM f GROUP BY r, doc_id, block),
u AS (
  SELECT r, doc_id, 0 AS kind, line, w FROM f
  UNION ALL SELECT r, doc_id, 1, line, w FROM p WHERE n > 1
  UNION ALL SELECT r, doc_id, 2, 0, flatten(list(w ORDER BY line)) FROM p GROUP BY r, doc_id HAVING count(*) > 1),
b AS (SELECT r, doc_id, kind, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM u WHERE len(w) >= 2),
c AS (SELECT r, doc_id, kind, line, len(b) AS n, unnest(b) AS g FROM b),
s AS (SELECT licence, tid, len(b) AS n, unnest(b) AS g FROM t),
m AS (SELECT c.r, c.doc_id, c.kind, c.line, s.licence, s.tid, 2.0 * count(*) / (c.n + s.n) AS dice FROM c JOIN s USING (g) GROUP BY c.r, c.doc_id, c.kind, c.line, s.licence, s.tid, c.n, s.n),
k AS (SELECT *, row_number() OVER (PARTITION BY r, licence ORDER BY dice DESC, kind, line) AS pos FROM m WHERE dice >= {THRESHOLD} - 1e-12)
SELECT doc_id, licence, round(dice, 6) AS dice, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' ELSE 'text' END AS unit, CAST(line AS INTEGER) AS line FROM k WHERE pos = 1
"""
