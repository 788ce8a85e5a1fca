"""License scans by patience alignment.

A text and a template are sequences of lower-cased words of letters and digits.
Words that occur once in both a window of the text and the template are
anchors, the longest increasing run of them is kept, equal words next to them
join, and the gaps between are aligned the same way. Coverage is the share of
the template's words that are aligned. A find is a region that reaches
`coverage` and in which the template's telling words (`must`: a name, a version,
a clause) are all aligned; of finds that overlap, the one with most aligned
words stays, so a header isn't reported as the shorter notice within it.

Candidates are exact: a find leaves at most n - need of the template's n words
unaligned, so it holds one of any n - need + 1 of them, or each telling word.
Windows of the template's length on either side of such a word are aligned, if
the words they share with the template can reach `need` at all. That is counted
for stretches of the text first, so that a text's cost grows with its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text, slices

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
COVERAGE = 0.8


@dataclass(frozen=True)
class Template:
    """A notice or license text, and the words of it that a find must have."""

    text: str
    must: tuple[str, ...] = ()

    @cached_property
    def words(self) -> list[str]:
        return words(self.text)

    def need(self, coverage: float) -> int:
        return max(1, ceil(coverage * len(self.words) - 1e-9))

    def keys(self, coverage: float) -> set[str]:
        """Words of which every find holds one."""
        if self.must:
            return {max(self.must, key=rarity)}
        return set(sorted(self.words, key=rarity, reverse=True)[: len(self.words) - self.need(coverage) + 1])


def rarity(word: str) -> tuple[bool, int, str]:
    """Long words are rarer than short ones, function words most common."""
    return word not in FUNCTION_WORDS, len(word), word


FUNCTION_WORDS = frozenset("a all and any are as at be by each either for from have if in is it may must no not of on or other shall such that the their there these this those to under was which will with without you your".split())
#: Public license notices and texts; a parameter.
TEMPLATES = {
    "Apache-1.1": Template("Licensed under the Apache Software License, Version 1.1.", ("apache", "1.1")),
    "Apache-2.0": Template("Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    "Apache-2.0-header": Template(
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        ("apache", "2.0"),
    ),
    "MIT": Template("Released under the MIT License.", ("mit",)),
    "MIT-text": Template(
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ),
    "MIT-full": Template(
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "BSD-text": Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "BSD-2-Clause-full": Template(
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    ),
    "BSD-3-Clause-full": Template(
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        ("neither", "endorse"),
    ),
    "ISC-text": Template("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Zlib-text": Template(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "Unlicense-text": Template(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0-header": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla", "2.0")),
    "MPL-2.0": Template("Licensed under the Mozilla Public License, version 2.0.", ("mozilla", "2.0")),
    "EPL-2.0": Template("Licensed under the Eclipse Public License, version 2.0.", ("eclipse", "2.0")),
    "CC0-1.0": Template("Licensed under CC0 1.0 Universal.", ("cc0", "1.0")),
    "CC0-1.0-text": Template("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived",)),
}
#: The GNU family by name, version and the words that tell it from the others.
GNU = {"GPL": ("General Public License", ("gnu",)), "LGPL": ("Lesser General Public License", ("gnu", "lesser")), "AGPL": ("Affero General Public License", ("gnu", "affero"))}
for _name, _versions in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}.items():
    for _v in _versions:
        _title, _must = GNU[_name]
        _id = f"{_name}-{_v}" if "." in _v else f"{_name}-{_v}.0"
        TEMPLATES[_id] = Template(f"This work is licensed under the GNU {_title}, version {_v}.", (*_must, _v))
        TEMPLATES[f"{_id}-header"] = Template(f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_title} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version.", (*_must, _v))
#: Creative Commons by clauses and version, in short and in full.
CLAUSES = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _clauses in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("3.0", "4.0"):
        _parts = _clauses.split("-")
        TEMPLATES[f"CC-{_clauses}-{_v}"] = Template(f"Licensed under CC {_clauses} {_v}.", ("cc", *(x.lower() for x in _parts), _v))
        _titles = [CLAUSES[x] for x in _parts]
        TEMPLATES[f"CC-{_clauses}-{_v}-title"] = Template(f"This work is licensed under a Creative Commons {'-'.join(_titles)} {_v} International License.", ("commons", *(x.lower() for x in _titles), _v))
#: Identifiers in file headers.
for _name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0"):
    TEMPLATES[f"{_name}-identifier"] = Template(f"SPDX-License-Identifier: {_name}", ("spdx", *(x.lower() for x in _name.split("-"))))

FOUND = "doc_id long, license string, start_word long, end_word long, matched long, template_words long, coverage double"
Find = tuple[int, int, int]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, ie, j, je = work.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        left, right = Counter(a[i:ie]), Counter(b[j:je])
        at = {w: k for k, w in enumerate(b[j:je], j) if right[w] == 1 and left[w] == 1}
        anchors = increasing([(k, at[w]) for k, w in enumerate(a[i:ie], i) if w in at])
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (ie, je)], strict=True):
            work.append((p + 1, r, q + 1, s))
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of their first number, whose second numbers increase."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int | None] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else None)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [n]
    out: list[tuple[int, int]] = []
    n = ends[-1] if ends else None
    while n is not None:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def scan(text: list[str], template: Template, coverage: float = COVERAGE) -> list[Find]:
    """(start, end, matched words) of the template's finds in a text, from left to right."""
    own, need, keys = template.words, template.need(coverage), template.keys(coverage)
    n, free, out = len(own), 0, []
    there, must = Counter(own), set(template.must)
    for first in range(0, len(text), n):
        hits = [k for k in range(first, min(first + n, len(text))) if text[k] in keys]
        if not hits or sum((Counter(text[max(0, first - n) : first + 2 * n + 1]) & there).values()) < need:
            continue
        for hit in hits:
            if hit < free:
                continue
            low, high = max(free, hit - n), min(len(text), hit + n + 1)
            # the window is cut where a second notice would hide anchors by repeating their words
            best: Find | None = None
            for a, b in {(low, high), (max(low, hit - n + 1), min(high, hit + n)), *((max(low, hit - k), min(high, hit - k + n)) for k, w in enumerate(own) if w == text[hit])}:
                pairs = patience(text[a:b], own)
                if len(pairs) >= need and must <= {own[j] for _, j in pairs}:
                    found = (a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs))
                    if best is None or (-found[2], found[1] - found[0], found[0]) < (-best[2], best[1] - best[0], best[0]):
                        best = found
            if best:
                out.append(best)
                free = best[1]
    return out


def best_finds(text: list[str], templates: dict[str, Template], coverage: float = COVERAGE) -> list[tuple[str, Find]]:
    """Finds of all templates that no better one overlaps: more aligned words, then a larger share, then by name."""
    there = set(text)
    found = [(name, x) for name, t in templates.items() if set(t.must) <= there and t.keys(coverage) & there for x in scan(text, t, coverage)]
    found.sort(key=lambda f: (-f[1][2], -f[1][2] / len(templates[f[0]].words), f[0], f[1]))
    out: list[tuple[str, Find]] = []
    for name, (a, b, m) in found:
        if all(b <= c or d <= a for _, (c, d, _) in out):
            out.append((name, (a, b, m)))
    return sorted(out, key=lambda f: f[1])


def scan_licenses(docs: DataFrame, templates: dict[str, Template] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per find: FOUND, words counted from 0, ends exclusive.

    Null and empty texts have no finds; long texts are scanned whole. Repeated
    rows have theirs each, null ids stay null, no rows give none, other columns
    are left out.
    """
    templates = templates or TEMPLATES
    keys = {k for t in templates.values() for k in t.keys(coverage)}
    # a text without any of these words has no find
    any_key = r"(?:^|[^\pL\pN])(?:" + "|".join(sorted(re.escape(k) for k in keys)) + r")(?:[^\pL\pN]|$)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = pc.match_substring_regex(pc.utf8_lower(batch.column(1)), any_key)
            batch, out = batch.filter(held), []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, (a, b, m) in best_finds(words(text), templates, coverage):
                    n = len(templates[name].words)
                    out.append((doc, name, a, b, m, n, m / n))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in out], schema=SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(run, FOUND)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("matched", pa.int64()), ("template_words", pa.int64()), ("coverage", pa.float64())])
