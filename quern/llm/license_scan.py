"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Windows of 1, 2, 4 ... shingles start at every shingle of a text; their minima come from doubling, so all sizes together
cost about as much as one. A template is cut into windows of the largest such size that fits it, every half window. Text
and template windows meet if they agree in a band of ROWS of their HASHES minima. A copy with containment 0.8 has an aligned
window of Jaccard 2/3 or more on average, which BANDS bands of 2 find with probability 1 - (1 - (2/3)^2)^BANDS = 0.9999
for each of its windows; windows of one shingle are found always. Candidates are verified by exact shingle sets.

Templates of fewer words than a shingle are looked up exactly, at every word of a text, by shingles of their own length.

The work is a pass over whole texts in bounded blocks without a shuffle. Templates go to the tasks in slices of SLICE_BYTES
at most; more of them take more passes, which hand on what they found, and the last one chooses among all.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import text as T

SHINGLE, ROWS, BANDS, CONTAINMENT, LARGEST, TABLE_BITS, SLICE_BYTES = 5, 2, 16, 0.8, 64, 18, 8 << 20
HASHES = ROWS * BANDS

# Public license notices and paragraphs.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-full": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced or distributed in any form.",
}

# Headers of each version, closing clauses, main grants and the usual verbs, which share too little with the templates above.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
VARIANTS = {
    "GPL-2.0-header": "This program is free software; " + _GNU.format("General Public License", ";", "2"),
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1-header": "This library is free software; " + _GNU.format("Lesser General Public License", ";", "2.1"),
    "LGPL-2.0-header": "This library is free software; " + _GNU.format("Library General Public License", ";", "2"),
    "LGPL-3.0-header": "This program is free software: " + _GNU.format("Lesser General Public License", ",", "3"),
    "AGPL-3.0-header": "This program is free software: " + _GNU.format("Affero General Public License", ",", "3"),
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "BSD-source-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "BSD-liability": "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "ISC-warranty": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-copyright-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "Apache-2.0-patent-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    "MIT-terms": "under the terms of the MIT License",
    **{f"MIT-{v.lower()}": f"{v} under the MIT License." for v in ("Licensed", "Distributed", "Available")},
    **{f"Apache-2.0-{v.lower()}": f"{v} under the Apache License, Version 2.0." for v in ("Released", "Distributed", "Available")},
    **{f"BSD-{n}-Clause-{v.lower()}": f"{v} under the BSD {n}-Clause License." for n in (2, 3) for v in ("Released", "Distributed", "Available")},
    **{f"MPL-2.0-{v.lower()}": f"{v} under the Mozilla Public License, Version 2.0." for v in ("Released", "Distributed", "Available")},
    **{f"GPL-{n}.0-{v.lower()}": f"{v} under the GNU General Public License, version {n}." for n in (2, 3) for v in ("Released", "Distributed", "Available")},
}

# Notices shorter than a shingle.
SHORT = {"all-rights-reserved-line": "All rights reserved."}

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True
_rng = np.random.default_rng(71)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _words(data: np.ndarray, off: np.ndarray) -> T.Words:
    return T.Words(data, off, letters=_LETTERS)


def _text_words(text: str) -> T.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))


def window_keys(shingles: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, band, key of the window of that size at each start); windows beyond the end are left out."""
    for band in range(BANDS):
        minima = [((shingles * _MULTIPLY[band * ROWS + r]) >> np.uint64(32)).astype(np.uint32) for r in range(ROWS)]
        size = 1
        while True:
            if size in sizes and len(minima[0]):
                key = np.zeros(len(minima[0]), np.uint32)
                for r, m in enumerate(minima):
                    key = (key ^ m) * _BAND[band * ROWS + r]
                    key ^= key >> np.uint32(15)
                yield size, band, key
            if size * 2 > max(sizes) or len(minima[0]) <= size:
                break
            minima = [np.minimum(m[:-size], m[size:]) for m in minima]
            size *= 2


class Library:
    """Templates with their shingle sets, and the band keys of their windows; they are numbered from first on."""

    def __init__(self, templates: Mapping[str, str], first: int = 0):
        self.first = first
        self.names, self.sets, self.length, self.long = [], [], [], []
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for name, text in sorted(templates.items()):
            words = _text_words(text)
            sh = T.shingles(words, SHINGLE)[0]
            if not len(sh):
                continue
            if (m := len(words.hash)) < SHINGLE:
                self.short.setdefault(m, []).append((int(sh[0]), len(self.names)))
                self.names.append(name)
                self.sets.append(sh)
                self.length.append(1)
                self.long.append(False)
                continue
            t, size = len(self.names), min(LARGEST, 1 << (len(sh).bit_length() - 1))
            self.names.append(name)
            self.sets.append(np.unique(sh))
            self.length.append(len(sh))
            self.long.append(True)
            starts = sorted({*range(0, len(sh) - size + 1, max(1, size // 2)), len(sh) - size})
            for s, band, key in window_keys(sh, [size]):
                found.setdefault((s, band), []).extend((int(key[i]), t) for i in starts)
        self.sizes = sorted({s for s, _ in found})
        long = [x for x, m in zip(self.sets, self.long) if m]
        self.every = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        self.keys, self.owner, self.table = {}, {}, {}
        for sb, rows in found.items():
            rows = sorted(set(rows))
            self.keys[sb] = np.array([k for k, _ in rows], np.uint32)
            self.owner[sb] = np.array([t for _, t in rows], np.int64)
            self.table[sb] = np.zeros(1 << TABLE_BITS, bool)
            self.table[sb][self.keys[sb] >> np.uint32(32 - TABLE_BITS)] = True

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Distinct (start shingle, template) that agree in a band."""
        out = []
        for size, band, key in window_keys(shingles, self.sizes) if self.sizes else ():
            at = np.flatnonzero(self.table[size, band][key >> np.uint32(32 - TABLE_BITS)])
            if len(at):
                lo = np.searchsorted(self.keys[size, band], key[at])
                hi = np.searchsorted(self.keys[size, band], key[at], side="right")
                for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                    out += [(p, t) for t in self.owner[size, band][a:b]]
        return np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)

    def short_passages(self, words: T.Words) -> dict[int, list[tuple[float, int, int]]]:
        """(1.0, start word, template) of each place that holds a short template, by text."""
        out: dict[int, list[tuple[float, int, int]]] = {}
        for m, own in sorted(self.short.items()):
            sh, begin = T.shingles(words, m)
            for h, t in own:
                at = np.flatnonzero(sh == np.uint64(h))
                for p, d in zip(at, np.searchsorted(begin, at, side="right") - 1):
                    out.setdefault(int(d), []).append((1.0, int(p - begin[d]), t))
        return out

    def verify(self, at: np.ndarray, shingles: np.ndarray, t: int) -> list[tuple[float, int]]:
        """(containment, first shingle) of each passage of one text that holds enough of template t.

        The text is given by its shingles that any template has, and their places.
        """
        m, own = self.length[t], self.sets[t]
        reach = m + m // 4 + 1
        mine = np.isin(shingles, own)
        hits, shingles = at[mine], shingles[mine]
        out: list[tuple[float, int]] = []
        i = 0
        while i < len(hits):
            stop = int(np.searchsorted(hits, hits[i] + reach))
            kinds, firsts = np.unique(shingles[i:stop], return_index=True)
            share = len(kinds) / len(own)
            if share >= CONTAINMENT:
                out.append((share, int(hits[i])))
                i += int(firsts.max()) + 1  # what comes after its last new shingle may begin another passage
            else:
                i += 1
        return out

    def passages(self, words: T.Words) -> dict[int, list[tuple[float, int, int]]]:
        """(containment, start, template) of the passages that each text of a block holds."""
        sh, begin = T.shingles(words, SHINGLE)
        out = self.short_passages(words) if len(sh) else {}
        if not len(sh) or not len(self.every):
            return out
        found = self.candidates(sh)
        at = np.flatnonzero(self.every[np.minimum(np.searchsorted(self.every, sh), len(self.every) - 1)] == sh) if len(found) else found[:, 0]
        doc = np.searchsorted(begin, found[:, 0], side="right") - 1
        for d, t in np.unique(np.stack([doc, found[:, 1]], 1), axis=0):
            own = at[np.searchsorted(at, begin[d]) : np.searchsorted(at, begin[d + 1])]
            out.setdefault(int(d), []).extend((share, p, int(t)) for share, p in self.verify(own - begin[d], sh[own], t))
        return {d: [(share, p, t + self.first) for share, p, t in x] for d, x in out.items()}


def _best(found: list[tuple[float, int, int]], length: list[int]) -> list[tuple[float, int, int]]:
    """Passages (containment, start, template) without those that lie half or more in one that fits another template better."""
    kept: list[tuple[float, int, int]] = []
    for share, start, t in sorted(found, key=lambda p: (-p[0], -length[p[2]], p[1], p[2])):
        stop = start + length[t]
        if not any(s > share and 2 * (min(stop, a + length[u]) - max(start, a)) >= length[t] for s, a, u in kept):
            kept.append((share, start, t))
    return kept


_PASSAGE = np.dtype([("share", "f8"), ("start", "i8"), ("template", "i8")])


def _scan(batches: Iterator[pa.RecordBatch], library: Library, names: list[str], length: list[int], last: bool) -> Iterator[pa.RecordBatch]:
    """One pass: rows with what this and earlier passes found (found), or from the last pass the results."""
    for b in T.slices(batches, 1):
        found = [np.frombuffer(x, _PASSAGE).tolist() if x else [] for x in b.column(2).to_pylist()]
        for i, j, data, off in T.blocks(b.column(1)):
            for d, passages in library.passages(_words(data, off)).items():
                found[i + d] += passages
        if not last:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, _PASSAGE).tobytes() if x else None for x in found], pa.binary())], names=["doc_id", "text", "found"])
            continue
        rows: list[list] = [[], [], [], [], []]
        for i, passages in enumerate(found):
            passages = _best(passages, length)
            for t in sorted({p[2] for p in passages}):
                mine = [p for p in passages if p[2] == t]
                best = max(mine, key=lambda p: (p[0], -p[1]))
                for c, v in zip(rows, (i, names[t], round(best[0], 6), best[1], len(mine))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=["doc_id", "license", "containment", "start_word", "n_passages"])


def libraries(templates: Mapping[str, str], most: int = SLICE_BYTES) -> list[Library]:
    """Templates in sorted order, in slices of at most so many bytes (one template, where that is longer); one slice at least."""
    parts: list[dict[str, str]] = [{}]
    size = 0
    for name, text in sorted(templates.items()):
        n = len(text.encode())
        if size + n > most and parts[-1]:
            parts.append({})
            size = 0
        parts[-1][name] = text
        size += n
    out: list[Library] = []
    for part in parts:
        out.append(Library(part, out[-1].first + len(out[-1].names) if out else 0))
    return out


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Each file of a folder as a template named like the file, as for full license texts; any store that Spark reads."""
    return {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]).decode(errors="replace") for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, start_word, n_passages): a row for each template that a row of docs holds.

    A word is a run of letters and digits (and of bytes beyond ASCII), lower-cased. start_word is the first word of the best
    passage. A passage that fits two templates, as versions of one license do, counts for the one that it holds more of.
    Null and empty texts hold nothing; rows that repeat are reported each; an empty table or no templates give an
    empty result; further columns are not read. A template of fewer words than a shingle is found wherever
    a text holds exactly these words. templates_in reads further templates, such as whole license texts, from files.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = libraries(TEMPLATES | VARIANTS | SHORT if templates is None else templates)
    names, length = [x for p in held for x in p.names], [x for p in held for x in p.length]
    rows = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("found"))
    for part in held[:-1]:
        rows = rows.mapInArrow(lambda it, part=part: _scan(it, part, names, length, False), f"doc_id {kind}, text string, found binary")
    return rows.mapInArrow(lambda it: _scan(it, held[-1], names, length, True), f"doc_id {kind}, license string, containment double, start_word long, n_passages long")
