"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates (license texts and notices) are sets of 5-word shingles. Templates of 2^c to 2^(c+1) - 1 shingles form class c;
for each class every document is cut into windows of 2^(c+1) + s shingles at steps of s = 2^(c-1), the last one shorter,
so that every stretch of twice a template's shingles lies in some window. A template is in a window that contains CONTAINMENT
or more of its shingles. Such a window has a Jaccard similarity J of at least CONTAINMENT n / (window + (1 - CONTAINMENT) n)
with the template, and BANDS bands of one row retrieve it with probability 1 - (1 - J)^BANDS: MISSED at most stays unseen,
which is checked for every class. Only bands retrieve; the (template, window) pairs they give are verified on the words.
A band orders shingles by a bijection of their hashes, so it can agree only on a window that holds the very shingle that is
the template's least. One lookup of every shingle finds these, and bands are computed for the windows around them: the
pairs are those of all windows, while texts without any such shingle cost one lookup a word.

Every occurrence is reported: where windows that contain a template overlap, its shingles are read in order, and a new
occurrence begins at a shingle that the current one has already, once that one holds CONTAINMENT of the template. Copies
in a row are thus told apart, and one in pieces is one.

Words are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. Defined cases: null
and empty texts, and texts of fewer than five words, have no license; repeated documents and null ids are each reported;
an empty table gives no rows; other columns are ignored. Templates need five words; a store of more than TEMPLATE_BYTES is
dealt into parts of at most that (a longer template is a part by itself), and every part is scanned over all documents.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op07_decontaminate import Words
from .segments import slices
from .shared import HashIndex, cut, documents, mix

SHINGLE, CONTAINMENT, BANDS, MISSED = 5, 0.8, 40, 1e-5
TEMPLATE_BYTES = 4 << 20

#: Public license notices and texts.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-2-Clause/disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause/third": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "BSL-1.0/text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
        the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
        whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "GPL-2.0/notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1/notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0/notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "Zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
}


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder, such as whole license texts, named by the files."""
    return {p.stem: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def grid(c: int) -> tuple[int, int]:
    """Step of class c and the shingles in its window."""
    step = max(1, 1 << c >> 1)
    return step, (2 << c) + step


class Templates:
    """Signatures of templates by class, and the shingles of each."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        words = Words(pa.array([texts[n] for n in self.names], pa.string()))
        self.shingles: list[dict[bytes, int]] = []
        classes: dict[int, list[int]] = {}
        hashes = words.window_hashes(SHINGLE)
        members = []
        for t, name in enumerate(self.names):
            a, b = int(words.first[t]), int(words.first[t + 1]) - SHINGLE + 1
            if b <= a:
                raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
            self.shingles.append({words.key(i, SHINGLE): int(hashes[i]) for i in range(a, b)})
            members.append(np.unique(hashes[a:b]))
            classes.setdefault(len(self.shingles[t]).bit_length() - 1, []).append(t)
        self.seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B9))
        self.hashes = members
        self.classes = {c: np.array(ts) for c, ts in sorted(classes.items())}
        least = {c: np.array([[members[t][self.permuted(members[t], k).argmin()] for t in ts] for k in range(BANDS)]) for c, ts in self.classes.items()}
        self.signatures = {c: np.array([self.permuted(some[k], k) for k in range(BANDS)]) for c, some in least.items()}
        self.least = HashIndex()  # the shingles on which bands may agree, and which of them are of a class
        distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *(some.ravel() for some in least.values())]))
        self.least.add(distinct)
        self.least_of = {c: np.isin(distinct, some) for c, some in least.items()}
        for c in self.classes:
            need = -(-CONTAINMENT * (1 << c) // 1)
            j = need / (grid(c)[1] + (1 << c) - need)
            if (1 - j) ** BANDS > MISSED:
                raise ValueError("too few bands")

    def permuted(self, h: np.ndarray, k: int) -> np.ndarray:
        """A bijection of the hashes, another one for every band."""
        with np.errstate(over="ignore"):
            v = (h ^ self.seeds[k]) * np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(32)
            return v * np.uint64(0xD6E8FEB86659FD93)


def _united(lo: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The numbers in any of the ranges, ascending, each once; both ends ascend."""
    begin = np.maximum(lo, np.concatenate([lo[:1], past[:-1]]))
    count = past - begin
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


class Scanner:
    def __init__(self, texts: dict[str, str], bands: bool = True):
        """bands=False takes every window of every template, which tests compare with."""
        self.own = Templates(texts)
        self.bands = bands

    def scan(self, column: pa.Array) -> list[list[tuple[str, int, int, float]]]:
        """Per document: (template, first word, word after the last, containment), by template and place."""
        words = Words(column)
        hashes = words.window_hashes(SHINGLE)
        first = words.first[:-1]
        size = np.maximum(np.diff(words.first) - SHINGLE + 1, 0)  # shingles of each document
        places = self.own.least.find(hashes)
        at = np.flatnonzero(places >= 0)
        places = places[at]
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for c, ts in self.own.classes.items():
            doc, start, end = self._near(first, size, c, at[self.own.least_of[c][places]]) if self.bands else self._windows(first, size, c)
            for w, t in self._retrieved(c, hashes, start, end) if self.bands else ((w, t) for w in range(len(doc)) for t in ts.tolist()):
                found.setdefault((int(doc[w]), t), []).append((int(start[w]), int(end[w])))
        out: list[list[tuple]] = [[] for _ in range(len(column))]
        for (d, t), spans in sorted(found.items()):
            out[d] += [(self.own.names[t], a, b, share) for a, b, share in self._occurrences(words, hashes, t, sorted(spans), int(first[d]))]
        return out

    @staticmethod
    def _windows(first: np.ndarray, size: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first shingle and shingle after the last of the windows of a class."""
        step, long = grid(c)
        count = np.where(size > 0, np.maximum(-(-(size - long) // step), 0) + 1, 0)
        doc = np.repeat(np.arange(len(size)), count)
        start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
        return doc, first[doc] + start, first[doc] + np.minimum(start + long, size[doc])

    @staticmethod
    def _near(first: np.ndarray, size: np.ndarray, c: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those windows of a class that hold one of the shingles ``at`` (ascending), in the same order."""
        step, long = grid(c)
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at - first[doc] < size[doc]  # others reach into the next document
        at, doc = at[inside], doc[inside]
        place = at - first[doc]
        count = np.where(size > 0, np.maximum(-(-(size - long) // step), 0) + 1, 0)
        base = (np.cumsum(count) - count)[doc]
        lo = base + np.maximum((place - long) // step + 1, 0)
        past = base + np.minimum(place // step, count[doc] - 1) + 1
        own = _united(lo, past)
        doc = np.repeat(doc, np.diff(np.searchsorted(own, past), prepend=0))
        start = (own - (np.cumsum(count) - count)[doc]) * step
        return doc, first[doc] + start, first[doc] + np.minimum(start + long, size[doc])

    def _retrieved(self, c: int, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
        """(window, template) pairs that agree on some band."""
        pairs = set()
        if not len(start):
            return []
        held = _united(start, end)  # bands look at the shingles of these windows only
        hashes, length = hashes[held], end - start
        start = np.searchsorted(held, start)
        end = start + length
        level_of = np.frexp(length.astype(np.float64))[1] - 1  # least of a window: of two overlapping runs of 2^level
        by_level = [(j, np.flatnonzero(level_of == j)) for j in np.unique(level_of).tolist()]
        ts = self.own.classes[c]
        for k in range(BANDS):
            level, j = self.own.permuted(hashes, k), 0
            signature = self.own.signatures[c][k]
            order = np.argsort(signature)
            ranked = signature[order]
            for wanted, some in by_level:
                while j < wanted:
                    level = np.minimum(level[: -(1 << j)], level[1 << j :])
                    j += 1
                least = np.minimum(level[start[some]], level[end[some] - (1 << j)])
                at = np.searchsorted(ranked, least)
                hit = np.flatnonzero(ranked[np.minimum(at, len(ranked) - 1)] == least)
                for w, value in zip(some[hit].tolist(), least[hit].tolist(), strict=True):
                    pairs.update((w, int(ts[i])) for i in order[np.searchsorted(ranked, np.uint64(value)) : np.searchsorted(ranked, np.uint64(value), side="right")])
        return sorted(pairs)

    def _occurrences(self, words: Words, hashes: np.ndarray, t: int, spans: list[tuple[int, int]], base: int):
        """Of a template in a document, within the retrieved windows that contain it."""
        own, need = self.own.shingles[t], CONTAINMENT * len(self.own.shingles[t])
        held: dict[int, bytes] = {}
        joined: list[list[int]] = []
        done = spans[0][0]
        for a, b in spans:
            begin = max(a, done)
            for i in np.flatnonzero(np.isin(hashes[begin:b], self.own.hashes[t])).tolist():
                if (key := words.key(begin + i, SHINGLE)) in own:
                    held[begin + i] = key
            done = max(done, b)
        places = np.array(sorted(held), np.int64)
        for a, b in spans:
            inside = places[np.searchsorted(places, a) : np.searchsorted(places, b)].tolist()
            if len({held[i] for i in inside}) >= need:
                if joined and a < joined[-1][1]:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
        for a, b in joined:
            run: list[int] = []
            seen: set[bytes] = set()
            for i in places[np.searchsorted(places, a) : np.searchsorted(places, b)].tolist():
                if held[i] in seen and len(seen) >= need:
                    yield run[0] - base, run[-1] - base + SHINGLE, len(seen) / len(own)
                    run, seen = [], set()
                run.append(i)
                seen.add(held[i])
            if len(seen) >= need:
                yield run[0] - base, run[-1] - base + SHINGLE, len(seen) / len(own)


_KIND = "array<struct<license:string,first:bigint,last:bigint,containment:double>>"


def _scan(docs: DataFrame, key: str, texts: dict[str, str]) -> DataFrame:
    Templates(texts)  # what is wrong with a template shows on the driver
    held = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches):
        scanner = Scanner(held.value)
        struct = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            for some in slices(batch, "text"):
                rows = [[dict(zip(("license", "first", "last", "containment"), x, strict=True)) for x in doc] for doc in scanner.scan(some.column("text"))]
                yield pa.RecordBatch.from_arrays([some.column(key), pa.array(rows, struct)], [key, "licenses"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, licenses {_KIND}")


def parts(texts: dict[str, str], limit: int = TEMPLATE_BYTES) -> list[dict[str, str]]:
    """The templates in parts of at most ``limit`` bytes."""
    out: list[dict[str, str]] = []
    room = 0
    for name in sorted(texts):
        size = len(texts[name].encode())
        if not out or size > room:
            out.append({})
            room = limit
        out[-1][name] = texts[name]
        room -= size
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, limit: int = TEMPLATE_BYTES) -> DataFrame:
    """Rows (doc_id, licenses): array of (license, first, last, containment) in words, by license and place."""
    dealt = parts(TEMPLATES if templates is None else templates, limit)
    if len(dealt) == 1:
        return _scan(docs, "doc_id", dealt[0])
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for part in dealt:
        one = _scan(rows, "_row", part).where(F.size("licenses") > 0)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("doc_id", F.array().cast(_KIND).alias("licenses"))
    united = found.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("licenses"))).alias("licenses"))
    return rows.select("_row", "doc_id").join(united, "_row", "left").select("doc_id", F.coalesce("licenses", F.array().cast(_KIND)).alias("licenses"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    found = licenses(documents(spark, sf_dir))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["last"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
