"""License notices by MinHash bands over text windows (operator 8).

Texts become words (runs of ASCII letters and digits and of longer code
points, A-Z lower-cased) and shingles of five words.  A template of n shingles
is looked for in overlapping windows of n + n // 4 shingles.  Band hashes of a
window retrieve templates of that window size; the match is then verified by
exact containment: at least ``SIMILAR`` of 100 of the template's shingles must
lie in the window.

Band settings: a window that holds the share c of a template has a Jaccard
similarity of at least c / (2.25 - c), 0.55 at c = 0.8, and shares one of 24
bands of 2 with a probability of 0.9998; a whole copy is missed with 2e-11.

A band collides only where its minima are shingles of a template, so windows
need to start only at positions whose shingle a template of that size has: any window
with matches can be moved to start at its first match without losing one.  One
scan finds these positions, vectorised; only they are hashed into bands.

One pass over the documents, no shuffle.  The template library is sent to the
workers in blocks of at most ``BLOCK_WORDS`` words (a longer template is a
block of its own).  A worker keeps one block ready; with several, it takes an
Arrow batch of texts through one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import Powers, _mix, byte_classes, chain, chunks, lower_values, string_buffers, word_hashes, word_spans

SHINGLE = 5
SIMILAR = 80  # of 100
BANDS = 24
ROWS = 2
BLOCK_WORDS = 1_000_000
_CELLS = 1 << 20  # hashes made at a time

#: Names and wordings of common license notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


#: Whole texts of short licenses, without their copyright lines.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
WHOLE = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")),
)
TEMPLATES = NOTICES + WHOLE


def notices(spark: SparkSession) -> DataFrame:
    """(template, license, text) of the built-in notices and whole licenses."""
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of fewer, the whole as one."""
    size = min(size, len(h)) or 1
    s = h
    for k in range(1, size):
        s = chain(s[:-1], h[k:])
    return s + np.uint64(size)


class Library:
    """Templates by window size, with their bands."""

    def __init__(self, words: list[np.ndarray], similar: int = SIMILAR, size: int = SHINGLE) -> None:
        self.size, self.salts = size, _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
        #: (shingle size, window) -> its templates; shorter templates than a shingle have a size of their own
        self.sets, self.least = [np.unique(shingles(w, size)) for w in words], []
        self.windows: dict[tuple[int, int], dict[int, list[int]]] = {}
        for t, (w, s) in enumerate(zip(words, self.sets, strict=True)):
            self.least.append(-(-similar * len(s) // 100))
            if len(w):
                n = len(shingles(w, size))
                found = self.windows.setdefault((min(size, len(w)), n + n // 4), {})
                for band in self.bands(s[None, :], np.ones((1, len(s)), bool))[0].tolist():
                    found.setdefault(band, []).append(t)
        self.tables = {k: np.array(sorted(found), np.uint64) for k, found in self.windows.items()}
        #: shingles of the templates of a window size: where its windows can start
        self.firsts = {k: np.unique(np.concatenate([self.sets[t] for t in {t for ts in found.values() for t in ts}])) for k, found in self.windows.items()}
        self.known = {z: np.unique(np.concatenate([s for s, w in zip(self.sets, words, strict=True) if min(size, len(w)) == z and len(w)])) for z, _ in self.windows}

    def bands(self, s: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Band hashes of rows of shingles."""
        mixed = _mix(s[:, :, None] ^ self.salts)
        low = np.where(valid[:, :, None], mixed, np.uint64(0xFFFFFFFFFFFFFFFF)).min(1).reshape(len(s), BANDS, ROWS)
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), BANDS))
        for r in range(ROWS):
            out = chain(out, low[:, :, r])
        return out

    def rows(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which of consecutive texts (by their first words) may have a match."""
        may = np.diff(first) > 0
        if all(z == self.size for z in self.known):  # whole shingles only: one look-up for all texts
            found = np.zeros(len(h) + 1, np.int64)
            for z, known in self.known.items():
                if len(h) >= z:
                    s = shingles(h, z)
                    hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                    found[1 : len(s) + 1] += hit
            upto = np.cumsum(found)
            may &= upto[first[1:]] > upto[first[:-1]]
        return may

    def search(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, shingles found) in the words of one text: of windows that
        match a template and overlap, the best (the first of equals), cut to its matches."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # shingle size -> shingles, places of known ones
        for (z, width), templates in self.windows.items():
            if len(h) < z:
                continue
            if z not in cache:
                s = shingles(h, z) if z < self.size else shingles(h, self.size)
                at = np.minimum(np.searchsorted(self.known[z], s), len(self.known[z]) - 1)
                cache[z] = s, np.flatnonzero(self.known[z][at] == s)
            s, known = cache[z]
            starts = known[np.isin(s[known], self.firsts[z, width])]
            if not len(starts):
                continue
            table = self.tables[z, width]
            step = max(1, _CELLS // (width * BANDS * ROWS))
            for i in range(0, len(starts), step):
                some = starts[i : i + step]
                where = some[:, None] + np.arange(width)
                rows = s[np.minimum(where, len(s) - 1)]
                bands = self.bands(rows, where < len(s))
                place = np.minimum(np.searchsorted(table, bands), len(table) - 1)
                hit = table[place] == bands
                for k in np.flatnonzero(hit.any(1)).tolist():
                    window = s[some[k] : some[k] + width]
                    for t in sorted({t for b in bands[k][hit[k]].tolist() for t in templates[b]}):
                        matched = np.flatnonzero(np.isin(window, self.sets[t]))
                        n = len(np.unique(window[matched]))
                        if n >= self.least[t]:
                            hits.setdefault(t, []).append((int(some[k]), int(some[k] + matched[-1] + z), n))
        out = []
        for t, spans in hits.items():
            best = None
            for a, b, n in spans:
                if best is not None and a < best[1]:
                    best = (a, b, n) if n > best[2] else best
                else:
                    out += [(t, *best)] if best else []
                    best = (a, b, n)
            out.append((t, *best))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _hashes(text: str, powers: Powers, values: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), is_word)
    return word_hashes(data, starts, ends, powers, values)


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, matches) for every row of ``docs``: an array of structs of template,
    license, first_word and end_word (places among the text's words, the end
    exclusive), found and shingles (how many of the template's were found), by
    place.

    ``templates`` has template, license and text; without, the built-in
    notices.  Templates without words match nothing; those of fewer words than
    a shingle count as one.  Null and empty texts have no matches.  Whole texts
    are searched; identifiers may be null or repeat: rows are independent.
    Other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    powers, values, is_word = Powers(), lower_values(), byte_classes("alnum")
    sent, names, words, held = [], [], [], 0
    for t, name, text in (notices(spark) if templates is None else templates).select(F.col("template").cast("string"), "license", "text").toLocalIterator():
        h = _hashes(text or "", powers, values, is_word)
        if held and held + len(h) > block_words:
            sent.append(spark.sparkContext.broadcast((names, words)))
            names, words, held = [], [], 0
        names.append((t, name))
        words.append(h)
        held += len(h)
    sent.append(spark.sparkContext.broadcast((names, words)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = Library

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, values, is_word = Powers(), lower_values(), byte_classes("alnum")
        item = pa.struct([("template", pa.string()), ("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("found", pa.int64()), ("shingles", pa.int64())])
        ready: tuple = (None, None)
        for batch in batches:
            offsets, data = string_buffers(batch.column(1))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for number, block in enumerate(sent):
                names, words = block.value
                ready = ready if ready[0] == number else (number, kind(words, similar))
                library = ready[1]
                for a, b in chunks(offsets):
                    part, rel = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    starts, ends, first = word_spans(part, rel, is_word)
                    h = word_hashes(part, starts, ends, powers, values)
                    for r in np.flatnonzero(library.rows(h, first)).tolist():
                        hits = library.search(h[first[r] : first[r + 1]])
                        found[a + r] += [{"template": names[t][0], "license": names[t][1], "first_word": p, "end_word": q, "found": n, "shingles": len(library.sets[t])} for t, p, q, n in hits]
            if len(sent) > 1:
                found = [sorted(hits, key=lambda m: (m["first_word"], m["end_word"])) for hits in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["_id", "matches"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, matches array<struct<template:string,license:string,first_word:bigint,end_word:bigint,found:bigint,shingles:bigint>>"
    return map_arrow(rows, work, schema).withColumnRenamed("_id", id_col)
