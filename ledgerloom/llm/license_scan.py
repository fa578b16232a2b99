"""License texts in documents: winnowed fingerprints find candidates, banded alignment confirms.

Templates are cut into runs of ``GRAM`` words; of every ``WINDOW`` neighbouring runs the one
with the smallest hash is a fingerprint, so two texts that share ``GRAM + WINDOW - 1`` words
in a row share one. A match may leave out only so many of a template's words, which fixes how
long a run of shared words there must be; where that is too short for the window, every run
of that length is a fingerprint of the template (window of one). An inverted index leads from
fingerprints to places in templates; it is as small as the list of templates, which is a
parameter. A document's winnowed fingerprints in the index name candidates (templates that
share as many of them, and as many words, as a match needs); from each shared fingerprint, those of the
diagonals that hold most first, an alignment within a band extends both ways until its score
falls too far, and pieces in order, with few words added between them, are chained. Words at
the end of a match that more than twice as many edits cut off do not count, as in any local
alignment. A match reports the share of template words it covers and where it lies.

Defined results: words are compared in lower case without punctuation at their
edges; a null or empty text has no match; a text may match several templates and a
template several times; of overlapping matches the one that matches more words
stays (ties: larger coverage, earlier start, then template name); rows with null or repeated ids are
rows like others; an empty table gives an empty result. Only the id and text columns
are read. Spans are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import arrow_rows

GRAM, WINDOW, BAND, DROP, LEAST_COVERAGE = 3, 2, 9, 24, 0.8

# Public notices, one name for each wording.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"),
    "MIT notice": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted"),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache notice": "Released under the Apache License.",
    "BSD notice": "Released under the BSD License.",
    "Apache-2.0 warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."),
    "MIT warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."),
    "LGPL notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"),
    "AGPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation"),
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work."),
    "ISC warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "BSD endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
}
# Whole licenses, from their paragraphs.
TEMPLATES["MIT license"] = " ".join((
    TEMPLATES["MIT grant"] + ", and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:", TEMPLATES["MIT condition"], TEMPLATES["MIT warranty"]))
TEMPLATES["ISC license"] = " ".join((
    TEMPLATES["ISC grant"] + ", provided that the above copyright notice and this permission notice appear in all "
    "copies.", TEMPLATES["ISC warranty"]))
TEMPLATES["BSD-2-Clause license"] = " ".join((
    TEMPLATES["BSD clauses"] + ":", TEMPLATES["BSD conditions"], TEMPLATES["BSD warranty"]))
TEMPLATES["BSD-3-Clause license"] = " ".join((
    TEMPLATES["BSD clauses"] + ":", TEMPLATES["BSD conditions"], TEMPLATES["BSD endorsement"],
    TEMPLATES["BSD warranty"]))

_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>*#/%&$|"


def read_templates(folder: str) -> dict[str, str]:
    """Whole license texts from the files of a folder, by file name, for ``templates``."""
    return {p.name: p.read_text(encoding="utf-8") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Compared form, start and end of every word that has one."""
    return [(w, m.start(), m.end()) for m in _WORD.finditer(text) if (w := m.group().lower().strip(_EDGE))]


def edits(n_words: int, least: float) -> int:
    """Replaced, missing and added words, all together, up to which a template of ``n_words``
    is always found: as many as a match may leave out, and one at least."""
    return max(1, n_words - math.ceil(least * n_words - 1e-9))


def shared_run(n_words: int, least: float) -> int:
    """Words in a row that such a match shares with the template."""
    spare = edits(n_words, least)
    return max(1, math.ceil((n_words - spare) / (spare + 1)))


def grams(numbers: list[int], size: int, base: int) -> list[tuple[int, int]]:
    """(place, code) of every run of ``size`` numbers below ``base`` that holds no zero.
    Different runs have different codes."""
    found, code, length, top = [], 0, 0, base ** (size - 1)
    for place, number in enumerate(numbers):
        if not number:
            code = length = 0
            continue
        code, length = code % top * base + number, length + 1
        if length >= size:
            found.append((place - size + 1, code))
    return found


def winnowed(found: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Of every ``window`` neighbouring runs the one with the smallest hash; the last, if equal."""
    hashed = [(code * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, -place, code) for place, code in found]
    picked = set()
    for i in range(len(hashed) - window + 1):
        some = hashed[i:i + window]
        if some[0][1] - some[-1][1] == window - 1:
            picked.add(min(some)[1:])
    return sorted((-place, code) for place, code in picked)


def extend(template: list[str], text: list[str], i: int, j: int, step: int) -> tuple[int, int, int]:
    """Best alignment that starts at template place ``i`` and text place ``j`` and goes on by
    ``step`` (1 or -1) within the band: matched words, template words and text words used.
    A match adds two, a replaced, missing or added word takes one off; it ends where the
    score is ``DROP`` below its best."""
    rows = len(template) - i if step > 0 else i + 1
    columns = len(text) - j if step > 0 else j + 1
    equal = 0
    while equal < min(rows, columns) and template[i + step * equal] == text[j + step * equal]:
        equal += 1
    i, j, rows, columns = i + step * equal, j + step * equal, rows - equal, columns - equal
    best, before = (0, 0, 0, 0), {c: (-c, 0) for c in range(min(BAND, columns) + 1)}
    for r in range(1, rows + 1):
        word, row, top = template[i + step * (r - 1)], {}, None
        for c in range(max(0, r - BAND), min(columns, r + BAND) + 1):
            options = []
            if c and c - 1 in before:
                score, hits = before[c - 1]
                same = word == text[j + step * (c - 1)]
                options.append((score + 2, hits + 1) if same else (score - 1, hits))
            for other in (before.get(c), row.get(c - 1)):
                if other:
                    options.append((other[0] - 1, other[1]))
            if not options:
                continue
            row[c] = cell = max(options)
            top = cell if top is None else max(top, cell)
            if cell > best[:2]:
                best = (*cell, r, c)
        if top is None or top[0] < best[0] - DROP:
            break
        before = row
    return best[1] + equal, best[2] + equal, best[3] + equal


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = {name: [w for w, _, _ in words_of(t)] for name, t in templates.items()}
        self.templates = {name: words for name, words in self.templates.items() if words}
        self.number = {w: n for n, w in enumerate(sorted({w for t in self.templates.values() for w in t}), 1)}
        self.needed: dict[str, int] = {}  # fingerprints that a match shares at least
        # (run length, window) -> code of a fingerprint -> places in templates
        self.index: dict[tuple[int, int], dict[int, list[tuple[str, int]]]] = {}
        for name, words in self.templates.items():
            run = shared_run(len(words), least)
            kind = (GRAM, WINDOW) if run >= GRAM + WINDOW - 1 else (min(run, GRAM), 1)
            # A run of r shared words holds r - size - window + 2 whole windows, and a
            # fingerprint stands for ``window`` of them at most.
            spare = edits(len(words), least)
            windows = len(words) - spare - (sum(kind) - 2) * (spare + 1)
            self.needed[name] = max(1, math.ceil(windows / kind[1]))
            places = self.index.setdefault(kind, {})
            for place, code in self.fingerprints([self.number[w] for w in words], *kind):
                places.setdefault(code, []).append((name, place))

    def fingerprints(self, numbers: list[int], size: int, window: int) -> list[tuple[int, int]]:
        """(place, code). Runs with words that no template has (number 0) are left out:
        windows that hold one cannot be shared."""
        found = grams(numbers, size, len(self.number) + 1)
        return winnowed(found, window) if window > 1 else found

    def pieces(self, name: str, anchors: list[tuple[int, int, int]], plain: list[str]) -> list[tuple]:
        """Alignments around shared fingerprints (text place, template place, length):
        text end, text start, template start, template end, matched words."""
        template, found = self.templates[name], []
        enough = self.least * len(template) - 1e-9
        diagonals: dict[int, list[tuple[int, int, int]]] = {}
        for anchor in sorted(anchors):
            diagonals.setdefault(anchor[0] - anchor[1], []).append(anchor)
        passed: dict[int, list[tuple[int, int]]] = {}
        whole = bytearray(len(plain))  # words inside a match that is one already
        for shift in sorted(diagonals, key=lambda d: (-len(diagonals[d]), d)):
            for place, at, size in diagonals[shift]:
                if whole[place] or any(first <= place < end for d in range(shift - BAND, shift + BAND + 1)
                                       for first, end in passed.get(d, ())[-1:]):
                    continue
                back = extend(template, plain, at - 1, place - 1, -1)
                ahead = extend(template, plain, at + size, place + size, 1)
                start, end, hits = place - back[2], place + size + ahead[2], back[0] + size + ahead[0]
                found.append((end, start, at - back[1], at + size + ahead[1], hits))
                passed.setdefault(shift, []).append((start, end))
                if hits >= enough:
                    whole[start:end] = b"\1" * (end - start)
        return sorted(found)

    def chains(self, name: str, found: list[tuple]) -> list[tuple[int, int, int]]:
        """Matched words, first and end place in the text of the best chain to every piece.
        Pieces follow each other in text and template, with few added words between; words
        at which the ends of two pieces overlap count once at most."""
        reach, out = len(self.templates[name]), []
        spare, ends = reach // 4, [p[0] for p in found]
        for n, (end, start, low, high, hits) in enumerate(found):
            best = (hits, start)
            for k in range(bisect_left(ends, start - spare - reach, hi=n), n):
                shared = max(0, found[k][3] - low, ends[k] - start)
                added = start - ends[k] - (low - found[k][3])
                if shared < min(hits, found[k][4]) and added <= spare and found[k][1] < start and found[k][2] < low:
                    best = max(best, (out[k][0] + hits - shared, out[k][1]))
            out.append((*best, end))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """template, coverage, matched words, start, end."""
        words = words_of(text)
        plain = [w for w, _, _ in words]
        numbers = [self.number.get(w, 0) for w in plain]
        anchors: dict[str, list[tuple[int, int, int]]] = {}
        for (size, window), places in self.index.items():
            for place, code in self.fingerprints(numbers, size, window):
                for name, at in places.get(code, ()):
                    anchors.setdefault(name, []).append((place, at, size))
        held, found = set(plain) if anchors else (), []
        for name, shared in anchors.items():
            template = self.templates[name]
            enough = self.least * len(template) - 1e-9
            if len({at for _, at, _ in shared}) < self.needed[name] or sum(w in held for w in template) < enough:
                continue
            for hits, first, end in self.chains(name, self.pieces(name, shared, plain)):
                if hits >= enough:
                    found.append((-hits, -hits / len(template), words[first][1], name, words[end - 1][2]))
        kept = []
        for hits, coverage, start, name, end in sorted(found):
            if not any(start < e and s < end for _, _, _, s, e in kept):
                kept.append((name, -coverage, -hits, start, end))
        return sorted(kept, key=lambda k: k[3:])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per match: id, ``license``, ``coverage``, ``matched_words``, ``start``, ``end``."""
    templates = TEMPLATES if templates is None else templates
    scanner = Scanner(templates, least)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = [id_col, "license", "coverage", "matched_words", "start", "end"]
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)] + [
        T.StructField(n, t) for n, t in zip(names[1:], (T.StringType(), T.DoubleType(), T.LongType(),
                                                        T.LongType(), T.LongType()))])

    def run(batches):
        for batch in batches:
            which, out = [], []
            for i, text in enumerate(batch.column(1)):
                for match in scanner.scan(text.as_py() or ""):
                    which.append(i)
                    out.append(match)
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64()))]
                + [pa.array(c, t) for c, t in zip(columns, types)], names)

    return arrow_rows(rows, run, schema)
