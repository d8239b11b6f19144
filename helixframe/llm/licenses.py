"""License scans by patience alignment.

Text and template are compared as words.  Words that occur once on both sides
are anchors; the longest increasing subsequence of their places, found by
patience sorting, is kept; the gaps between neighbouring anchors are aligned in
the same way.  Only a gap without anchors is aligned by its longest common
subsequence, at the edges of the template the one nearest to the anchors.
Coverage is the share of the template's words that found a partner, and the
partners are the passage.

Where to align: every hit holds one of the template's telling words, without which
too many words are missing.  From each place of such a word a region around the
template's extent is aligned; it grows on the side where the template's words are
still missing, as long as that finds more of them.  Matched neighbours more than a
template's length apart end a passage.  So the inserted words of a notice have no
common limit, and what is found does not depend on its place in the text.

Results: one row for each hit of at least ``percent`` hundredths coverage; of
overlapping hits of one template the best covered counts, then the shorter, then
the earlier one.  Several templates may hit one place.  Null and empty texts have
no hits; empty templates and empty tables give none.  Repeated rows are scanned
one by one.  Of the other columns only ``doc_id`` passes through.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from helixframe.llm.common import query, slices, table, texts_of

PERCENT = 80

# Public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}

_word = regex.compile(r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their character spans."""
    found = [(m.group().lower(), m.span()) for m in _word.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(places)
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            piles.append(i)
        else:
            tops[pile], piles[pile] = place, i
        below[i] = piles[pile - 1] if pile else -1
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = below[at]
    return out[::-1]


def _common(a: list[str], b: list[str], i0: int, i1: int, j0: int, j1: int, late: bool = False) -> list[tuple[int, int]]:
    """Longest common subsequence of two short pieces, the earliest one or the latest one in ``b``."""
    if late:
        turned = _common(a[i0:i1][::-1], b[j0:j1][::-1], 0, i1 - i0, 0, j1 - j0)
        return [(i1 - 1 - i, j1 - 1 - j) for i, j in reversed(turned)]
    n, m = i1 - i0, j1 - j0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i0 + i] == b[j0 + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i0 + i] == b[j0 + j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing on both sides."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i0, i1, j0, j1 = gaps.pop()
        if i0 == i1 or j0 == j1:
            continue
        left, right = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j, w in enumerate(b[j0:j1], j0) if right[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[i0:i1], i0) if left[w] == 1 and w in place]
        if not anchors:
            out += _common(a, b, i0, i1, j0, j1, late=not i0)
            continue
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += kept
        edges = [(i0 - 1, j0 - 1), *kept, (i1, j1)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, percent: int):
        self.name = name
        self.words, _ = words_of(text)
        self.counts = Counter(self.words)
        self.need = max(1, math.ceil(percent * len(self.words) / 100))
        # A text without any of these lacks too many words: together they occur more often than may be missing.
        self.telling, missing = [], len(self.words) - self.need
        for word in sorted(self.counts, key=lambda w: (-len(w), w)):
            if missing < 0:
                break
            self.telling.append(word)
            missing -= self.counts[word]
        self.seeds = {w: [i for i, own in enumerate(self.words) if own == w] for w in self.telling}

    def may_hit(self, lower: str) -> bool:
        return any(w in lower for w in self.telling)

    def shared(self, words) -> int:
        counts = Counter(w for w in words if w in self.counts)
        return sum(min(n, counts[w]) for w, n in self.counts.items())

    def passage(self, words: list[str], at: int, row: int) -> list[tuple[int, int]]:
        """Aligned places of template and text around the word ``at``, taken for the template's word ``row``."""
        size = len(self.words)
        begin, end = at - row - size // 4 - 1, at - row + size + size // 4 + 1
        best = self.part(words, max(0, begin), min(len(words), end))
        while len(best) < size:
            # Where words of the template are missing at an end, the region goes on there.
            sides = [(begin - size, end)] if not best or best[0][0] > 0 else []
            sides += [(begin, end + size)] if not best or best[-1][0] < size - 1 else []
            tried = [(self.part(words, max(0, b), min(len(words), e)), b, e) for b, e in sides]
            grown = max(tried, key=lambda t: len(t[0]), default=([], 0, 0))
            if len(grown[0]) <= len(best):
                break
            best, begin, end = grown
        return best

    def part(self, words: list[str], begin: int, end: int) -> list[tuple[int, int]]:
        """The alignment with ``words[begin:end]``; of pieces too far apart the one with most words."""
        pairs = [(i, begin + j) for i, j in align(self.words, words[begin:end])]
        pieces, size = [[]], len(self.words)
        for pair in pairs:
            if pieces[-1] and pair[1] - pieces[-1][-1][1] > size + 1:
                pieces.append([])
            pieces[-1].append(pair)
        return max(pieces, key=len)

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(matched, first word, last word)`` of every hit."""
        if not self.words or self.shared(words) < self.need:
            return []
        found: set[tuple[int, int, int]] = set()
        done: set[tuple[int, int]] = set()
        for at, word in enumerate(words):
            for row in self.seeds.get(word, ()):
                if (row, at) not in done:
                    pairs = self.passage(words, at, row)
                    if len(pairs) >= self.need:
                        done.update(pairs)  # its other words lead to the same passage
                        found.add((len(pairs), pairs[0][1], pairs[-1][1]))
        kept: list[tuple[int, int, int]] = []
        for matched, first, last in sorted(found, key=lambda h: (-h[0], h[2] - h[1], h[1])):
            place = bisect_left(kept, first, key=lambda k: k[1])
            if (place == len(kept) or last < kept[place][1]) and (not place or kept[place - 1][2] < first):
                kept.insert(place, (matched, first, last))
        return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """``doc_id, license, coverage, matched, template_words, begin, end`` (characters) of every hit."""
    known = dict(templates if templates is not None else TEMPLATES)
    key = docs.schema["doc_id"]
    schema = T.StructType([key, *T.StructType.fromDDL("license string, coverage double, matched int, template_words int, begin long, end long").fields])

    def run(batches):
        wanted = [Template(n, t, percent) for n, t in known.items()]
        for part in slices(batches, text):
            rows, out = [], []
            for row, value in enumerate(texts_of(part, text)):
                lower = value.lower()
                asked = [t for t in wanted if t.may_hit(lower)]
                if not asked:
                    continue
                words, spans = words_of(value)
                for t in asked:
                    for matched, first, last in t.hits(words):
                        rows.append(row)
                        out.append((t.name, matched / len(t.words), matched, len(t.words), spans[first][0], spans[last][1]))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(np.array(rows, np.int64))), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                [f.name for f in schema],
            )

    return docs.select("doc_id", text).mapInArrow(run, schema)


@query("op2_license_scan")
def op2(spark, sf_dir):
    """License notices in every document."""
    return scan(table(spark, sf_dir, "documents"))
