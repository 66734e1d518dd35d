"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from veridoc.llm.common import col

#: Notices and short license texts as published (fixed values).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
}
COVERAGE = 0.8
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two token lists: pairs of positions of equal tokens, rising in both.

    A gap first gives its equal ends, then is cut at tokens that occur once on both sides, as many as rise together;
    what lies between them is a gap of its own. Gaps without such tokens stay unaligned.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        once_a, once_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: y for y, w in enumerate(b[j:j_end], j) if once_b[w] == 1}
        anchors = [(x, where[w]) for x, w in enumerate(a[i:i_end], i) if once_a[w] == 1 and w in where]
        anchors = [anchors[k] for k in rising([y for _, y in anchors])]
        x0, y0 = i, j
        if not anchors:
            continue
        for x, y in anchors:
            todo.append((x0, x, y0, y))
            pairs.append((x, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, i_end, y0, j_end))
    return sorted(pairs)


class Scanner:
    """Finds templates in texts: regions dense in a template's words are aligned with it."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.templates = {name: tokens(t) for name, t in sorted(templates.items()) if tokens(t)}
        self.vocabulary = {w for t in self.templates.values() for w in t}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first and last token position) of every place that covers enough of a template.

        At least `coverage` of a template's tokens must be aligned, in order, within a region of the text at most
        twice as long; places of one template don't overlap.
        """
        words = tokens(text)
        seen = self.vocabulary.intersection(words)
        found = []
        for name, template in self.templates.items():
            need = Counter(template)
            if sum(n for w, n in need.items() if w in seen) < self.coverage * len(template):
                continue
            at = [i for i, w in enumerate(words) if w in need]
            for pairs in self._places(words, at, need, template):
                found.append((name, round(len(pairs) / len(template), 6), pairs[0][0], pairs[-1][0]))
        return found

    def _places(self, words: list[str], at: list[int], need: Counter, template: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Best alignments of disjoint regions, from the left, that cover enough of the template.

        A region is aligned whenever its bag of words could cover more than the best alignment so far; that one is
        done with when it is whole, or the region has left its first half, or most of a better one lies behind it, or no
        template word follows soon. Where words suffice and nothing aligned, every beginning is tried.
        """
        size = len(template)
        goal, have, covered, left, right = self.coverage * size, Counter(), 0, 0, 0
        best: list[tuple[int, int]] = []
        failed: list[int] = []
        while right < len(at):
            i = at[right]
            have[words[i]] += 1
            covered += have[words[i]] <= need[words[i]]
            while at[left] <= i - 2 * size or have[words[at[left]]] > need[words[at[left]]]:
                w = words[at[left]]
                covered -= have[w] <= need[w]
                have[w] -= 1
                left += 1
            lo = at[left]
            passed = bool(best) and 2 * lo > best[0][0] + best[-1][0]
            if not passed and covered >= goal and covered > len(best):
                pairs = align(words[lo : i + 1], template)
                if len(pairs) >= goal and len(pairs) > len(best):
                    if best and lo + pairs[len(pairs) // 2][0] > best[-1][0]:
                        passed = True
                    else:
                        best = [(lo + x, y) for x, y in pairs]
                elif not best:
                    failed += [i - 2 * size + 1, i - int(goal) + 1]
            right += 1
            last = right == len(at) or at[right] - i > size
            if not best and failed and (covered < goal or last):
                best = self._anywhere(words, at, template, failed[0], failed[-1])
                passed, failed = bool(best), []
            if best and (passed or last or len(best) == size):
                yield best
                left = right = bisect.bisect_right(at, best[-1][0])
                have, covered, best, failed = Counter(), 0, [], []

    def _anywhere(self, words: list[str], at: list[int], template: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """The best alignment of a region that begins with any template word from lo to hi; none if none covers enough.

        For regions that hold the words but, cut at surplus ones, don't align.
        """
        best: list[tuple[int, int]] = []
        for p in at[bisect.bisect_left(at, lo) : bisect.bisect_right(at, hi)]:
            pairs = align(words[p : p + 2 * len(template)], template)
            if len(pairs) >= self.coverage * len(template) and len(pairs) > len(best):
                best = [(p + x, y) for x, y in pairs]
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per place of a license in a text: doc_id, license, coverage, first_token and last_token (long).

    Whole texts are scanned one at a time, without a shuffle, against templates held by every task; give only as many
    as fit a task. Null and empty texts have no places; repeated rows give repeated places; other columns, whatever
    their names, are ignored. Empty templates match nothing, and an empty table gives an empty result.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(chosen, coverage)
        for batch in batches:
            out = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scanner.scan(t.as_py())]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "first_token", "last_token"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_token long, last_token long")
