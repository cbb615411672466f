"""License texts and notices found by patience alignment.

Where a text has one of a template's telling words, the words around it are aligned with the template: words that are
unique in both are anchors, their longest increasing subsequence stays, and each gap between anchors is aligned the same
way; words equal at a gap's ends match too. The share of the template's words that match is the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import apart, find_in_texts

COVERAGE = 0.8

TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "BSD-3-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "all-rights-reserved": "Copyright. All rights reserved",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}
_COMMON = frozenset("a all and any are as at be but by can do for found free from in is it may must not of on or other that the this to use used using version with without you your work 1 2 3 4".split())
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end): letters and digits, joined by single dots and hyphens."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        na, nb = Counter(a[i:j]), Counter(b[k:m])
        at = {b[y]: y for y in range(k, m) if nb[b[y]] == 1}
        pairs = [(x, at[a[x]]) for x in range(i, j) if na[a[x]] == 1 and a[x] in at]
        tails: list[int] = []
        ends: list[int] = []
        before = [-1] * len(pairs)
        for n, (_, y) in enumerate(pairs):
            p = bisect_left(tails, y)
            before[n] = ends[p - 1] if p else -1
            tails[p:], ends[p:] = [y, *tails[p + 1 :]], [n, *ends[p + 1 :]]
        anchors, n = [], ends[-1] if ends else -1
        while n >= 0:
            anchors.append(pairs[n])
            n = before[n]
        x0, y0 = i, k
        for x, y in anchors[::-1]:
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        if anchors:
            todo.append((x0, j, y0, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, [w for w, _, _ in words(text)]
        count, n = Counter(self.words), len(self.words)
        # enough words that no alignment with the coverage can do without all of them, telling ones first
        self.telling: set[str] = set()
        missed = 0
        for w in sorted(count, key=lambda w: (w in _COMMON, -len(w), w)):
            if missed > (1 - coverage) * n + 1e-9:
                break
            self.telling.add(w)
            missed += count[w]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [Template(k, v, coverage) for k, v in (templates or TEMPLATES).items()]
        self.telling = sorted(set().union(*(t.telling for t in self.templates)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of each place; of templates that overlap, the one with most matched words stays."""
        if not text:
            return []
        low = text.lower()
        if not any(w in low for w in self.telling):
            return []
        own = words(text)
        plain = [w for w, _, _ in own]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(plain):
            at.setdefault(w, []).append(i)
        found = []
        for t in self.templates:
            n = len(t.words)
            places = sorted(i for w in t.telling for i in at.get(w, ()))
            lo = 0
            while lo < len(places):
                hi = lo
                while hi + 1 < len(places) and places[hi + 1] - places[hi] <= n:
                    hi += 1
                start, end = max(0, places[lo] - n), min(len(plain), places[hi] + n + 1)
                found += self._within(t, plain, start, end)
                lo = hi + 1
        found.sort(key=lambda f: (-f[4], -f[3], f[0]))
        return [(name, own[i][1], own[j - 1][2], round(c, 6)) for name, i, j, c, _ in apart(found, 1, 2)]

    def _within(self, t: Template, plain: list[str], start: int, end: int) -> list[tuple[str, int, int, float, int]]:
        """Alignments of the template in plain[start:end], from left to right, in windows of twice its length that overlap by half."""
        n, out, i = len(t.words), [], start
        need = self.coverage * n - 1e-9
        while i < end:
            j = min(end, i + 2 * n)
            pairs = self._compact(patience(plain[i:j], t.words), n)
            if len(pairs) >= need:
                out.append((t.name, i + pairs[0][0], i + pairs[-1][0] + 1, len(pairs) / n, len(pairs)))
                i += pairs[-1][0] + 1
            else:
                i += max(1, n // 2)
            if j == end and i >= end - need:
                break
        return out

    @staticmethod
    def _compact(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The longest run of matches that spans at most 1.5 of the template's length in the text."""
        best, lo = (0, 0), 0
        for hi in range(len(pairs)):
            while pairs[hi][0] - pairs[lo][0] >= 1.5 * n:
                lo += 1
            if hi + 1 - lo > best[1] - best[0]:
                best = lo, hi + 1
        return pairs[best[0] : best[1]]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, coverage) of each license found; start and end count characters of the whole text.

    Null and empty texts have none. Repeated rows are reported each, rows with a null id with a null id; ids keep their type. Texts of any
    length are read whole. A license spread over more than 1.5 times its template's words is none. Of spans that overlap the one with the
    most matching words counts, then the best covered, then the template's name. An empty table gives an empty result. Extra columns are not read, whatever their names.
    """
    fields = [("license", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint"), ("coverage", pa.float64(), "double")]
    return find_in_texts(docs, id_col, text, lambda: Scanner(templates, coverage).scan, fields)
