"""License scans by conditional compression.

Templates are classed by length, since a short one saves little in a long block.  For each class, every
occurrence of a hint (a word of licences) opens a window of the class's length on both sides; windows
that touch are one, and they are cut into blocks that overlap by that length, so each notice lies
whole in a block, whatever its line breaks or comment signs.  A block's words, those of no template as a
dot, are compressed alone and with each template of the class as zstandard raw dictionary.  Templates are ranked by the share of their own compressed size that this saves, and every one above
a floor is aligned word by word with the whole block: all its occurrences whose wording differs in
few words are findings.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import slices

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
#: Public notices and licence texts by which licences are known.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0 terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT full text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL terms": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD": _BSD_BEGIN,
    "BSD-2-Clause text": _BSD_BEGIN + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC full text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_HINT = r"licen[cs]e|copyright|spdx|warrant|redistribut|permission (?:is|to)|public domain|as[ -]is\b"
_TABLES = 8
_WORD = re.compile(r"\w+(?:[.-]\w+)*")


class Scanner:
    """Finds templates in texts; one serves a whole task."""

    def __init__(self, templates: dict[str, str], most_different: float = 0.15, least_saving: float = 0.15):
        self.words = {k: _WORD.findall(v.lower()) for k, v in templates.items()}
        if not all(self.words.values()):
            raise ValueError("a template without words")
        hints = [_HINT, *[re.escape(max(self.words[k], key=len)) for k, v in templates.items() if not re.search(_HINT, v, re.I)]]
        self.hint = re.compile("|".join(hints), re.I)
        self.allowed = {k: int(most_different * len(w)) for k, w in self.words.items()}
        self.classes: dict[int, list[str]] = {}  # how many words a close alignment has at most, as a power of two: its templates
        for k, w in self.words.items():
            self.classes.setdefault(max(8, 1 << (len(w) + self.allowed[k] - 1).bit_length()), []).append(k)
        self.known = {w for own in self.words.values() for w in own}
        plain = {k: " ".join(w).encode() for k, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=6, write_content_size=False)
        given = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in plain.items()}
        self.given = {k: zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False) for k, d in given.items()}
        empty = len(self.alone.compress(b""))
        self.sizes = {k: len(self.alone.compress(v)) - empty for k, v in plain.items()}
        self.least_saving = least_saving
        self.scan = lru_cache(2_000)(self._scan)  # equal blocks are scanned once

    def ranked(self, block: str, names: list[str]) -> list[tuple[float, str]]:
        """(saving, template) from the floor on, the best first.

        The saving is the share of the template's compressed size that it takes off the block's as
        dictionary; the floor is `least_saving` of it, less the bytes that a frame's tables may cost.
        """
        data = block.encode("utf-8", "replace")
        own = len(self.alone.compress(data))
        savings = [((own - len(self.given[k].compress(data))) / self.sizes[k], k) for k in names]
        return sorted([x for x in savings if x[0] >= self.least_saving - _TABLES / self.sizes[x[1]]], key=lambda x: (-x[0], x[1]))

    def _scan(self, block: str, reach: int) -> list[tuple[str, float, int, int, int]]:
        """(template, saving, first word, word after the last, differing words) of all close alignments in the block of words."""
        found, words = [], block.split(" ")
        have = Counter(words)
        for saving, name in self.ranked(block, self.classes[reach]):
            want, most = self.words[name], self.allowed[name]
            # at least all but `most` of its words must be there, in whatever order
            if sum((Counter(want) & have).values()) >= len(want) - most:
                found += [(name, round(saving, 6), a, b, n) for a, b, n in alignments(words, want, most)]
        return found

    def find(self, text: str) -> list[tuple[int, int, str, float, int, bool]]:
        """(start, length, template, saving, differing words, exact) of each finding in the whole text, by place.

        Of overlapping findings of a template the closest counts, then the first; a finding inside one
        of another template that differs in fewer words, or in as many and is longer, is part of that.
        """
        hits = [m.start() for m in self.hint.finditer(text)]
        if not hits:
            return []
        spans, words = [], []
        for m in _WORD.finditer(text):
            word = m.group().lower()
            spans.append(m.span())
            words.append(word if word in self.known else ".")
        starts = [a for a, _ in spans]
        places = sorted({max(0, bisect_right(starts, h) - 1) for h in hits})
        close: dict[str, dict[tuple[int, int], tuple[int, float]]] = {}
        for reach in self.classes:
            windows: list[list[int]] = []
            for t in places:
                a, b = max(0, t - reach), min(len(words), t + reach + 1)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                for x in range(a, max(a + 1, b - reach), reach):
                    for name, saving, i, j, n in self.scan(" ".join(words[x : min(b, x + 2 * reach)]), reach):
                        own = close.setdefault(name, {})
                        old = own.get((x + i, x + j), (n, 0.0))
                        own[x + i, x + j] = n, max(old[1], saving)
        every: list[tuple[int, int, str, float, int]] = []
        for name in close:
            taken: list[tuple[int, int, str, float, int]] = []
            for (i, j), (n, saving) in sorted(close[name].items(), key=lambda x: (x[1][0], x[0])):
                if all(j <= t[0] or i >= t[1] for t in taken):
                    taken.append((i, j, name, saving, n))
            every += taken
        rank = lambda t: (t[4], -len(self.words[t[2]]), t[2])
        chosen = [t for t in every if not any(c[0] <= t[0] and t[1] <= c[1] and rank(c) < rank(t) for c in every)]
        return [(spans[i][0], spans[j - 1][1] - spans[i][0], name, saving, n, n == 0) for i, j, name, saving, n in sorted(chosen)]


def alignments(words: list[str], want: list[str], most: int) -> list[tuple[int, int, int]]:
    """(first, after the last, differing words) for each end in words of a stretch that differs from want by `most` words at most.

    Words left out, put in or put for another count one each; for an end the closest stretch counts,
    then the shortest.
    """
    at = {w: i for i, w in enumerate(dict.fromkeys(want))}
    pattern = np.array([at[w] for w in want])
    unit = np.int64(len(words) + 1)
    ramp = np.arange(len(want) + 1, dtype=np.int64) * unit
    # costs and how many words the stretch has lie in one number, cost first
    row, found = ramp.copy(), []
    for i, w in enumerate(words):
        put = row[:-1] + np.where(pattern == at.get(w, -1), 0, unit) + 1
        row = np.concatenate([[0], np.minimum(put, row[1:] + unit + 1)])
        row = np.minimum.accumulate(row - ramp) + ramp
        cost, size = divmod(int(row[-1]), int(unit))
        if cost <= most and size:
            found.append((i + 1 - size, i + 1, cost))
    return found


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, *, most_different: float = 0.15, least_saving: float = 0.15) -> DataFrame:
    """doc_id, start, length, license, saving, differing_words, exact for each finding in docs (doc_id, text).

    start and length are the finding's own, in code points.  A template is found wherever at most
    `most_different` of its words differ and it saves `least_saving` of its compressed size, less 8 bytes; ties of
    saving go by name.  A document without a finding gives no row, as do null and empty texts and empty tables.
    Equal rows give equal findings, each for itself; a null doc_id stays null.  Other columns are ignored, whatever their names.
    """
    templates = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, most_different, least_saving)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
        for batch in slices(batches, "text", 8 << 20):
            out = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scanner.find(text or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "length", "license", "saving", "differing_words", "exact"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, license string, saving double, differing_words int, exact boolean")
