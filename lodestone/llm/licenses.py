"""License scans by Patience alignment of texts against license templates.

A window of the text is aligned with a template: words unique to both are anchors, the longest increasing subsequence of anchors
is kept, and the gaps between them are aligned in the same way, where other words have become unique. Coverage is the share
of the template's words that are aligned.

Windows come from probes. An alignment that covers a share t of a template of n words misses at most (1 - t) n of them, so
of any floor((1 - t) n) + 1 words of it one at least stands in the text. The longest words are taken, as the rarest; a
text without a probe has no match, and each probe hit places one window. A second pass widens the windows of the hits that no match
covers, so up to INSERTED template lengths of other words may stand inside a match. Other words can hide an anchor by repeating it:
where a wide window falls short though its longest common subsequence with the template, which bounds every alignment in it, does
not, all windows inside it are tried that begin and end with a word of the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

#: Widely used notices and grants, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}
THRESHOLD = 0.8
#: Words that may be inserted into a match, in lengths of the template: a notice that is broken up by more than its own length is
#: another text that shares its words.
INSERTED = 1
_EDGE = re.compile(r"^\W+|\W+$")


def words_of(text: str) -> list[str]:
    """Words by white space, lower-cased, without punctuation at their ends; words of punctuation only are dropped."""
    return [w for w in (_EDGE.sub("", x) for x in text.lower().split()) if w]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs``, ascending by the first, whose second ascends."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        before.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[i], at[i] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) word positions, both ascending."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # equal ends need no anchor
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        once, single = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if single[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if once[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def common_length(text: list[str], template: list[str]) -> int:
    """Length of the longest common subsequence, by whole rows of bits."""
    places: dict[str, int] = {}
    for k, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(template)) - 1
    row = full
    for w in text:
        if hit := places.get(w):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(template) - row.bit_count()


class Scanner:
    """Templates by their probes."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        #: Words of a template that a match aligns.
        self.least = [max(1, ceil(threshold * len(w) - 1e-9)) for w in self.words]
        self.probes: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            distinct = sorted(set(words), key=lambda w: (-len(w), w))
            # dropping j distinct words drops at least j positions
            for w in distinct[: int((1 - threshold) * len(words) + 1e-9) + 1]:
                self.probes.setdefault(w, []).extend((k, i) for i, x in enumerate(words) if x == w)
        stems = [re.escape(w) for w in sorted(self.probes)]
        self.some = re.compile("|".join(stems)) if stems else None

    def _inside(self, words: list[str], lo: int, hi: int, at: int, template: list[str]) -> tuple[int, list[tuple[int, int]]]:
        """Start and alignment of the window around ``at`` that aligns most of the template; of equals the first and shortest."""
        own = set(template)
        edges = [k for k in range(lo, hi) if words[k] in own]
        best: tuple[int, list[tuple[int, int]]] = lo, []
        most = len(template) * (1 + INSERTED)
        for a in (k for k in edges if k <= at):
            for b in (k for k in edges if at <= k < a + most):
                # no window holds more than its own length
                if b - a >= len(best[1]) and len(pairs := patience(words[a : b + 1], template)) > len(best[1]):
                    best = a, pairs
        return best

    def scan(self, text: str) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, last word) of every match, by template and place."""
        low = text.lower()
        if self.some is None or not self.some.search(low):
            return []
        words = words_of(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        out = []
        # every close match comes before the wide ones, which fill the room between them
        for lengths in (0, INSERTED):
            for i, w in enumerate(words):
                for k, offset in self.probes.get(w, ()):
                    template, taken = self.words[k], spans.setdefault(k, [])
                    # what an accepted match covers holds no second one
                    at = bisect_right(taken, (i, len(words)))
                    if at and i <= taken[at - 1][1]:
                        continue
                    slack = max(2, len(template) // 4, lengths * len(template))
                    lo = max(taken[at - 1][1] + 1 if at else 0, i - offset - slack)
                    hi = min(taken[at][0] if at < len(taken) else len(words), i - offset + len(template) + slack)
                    pairs = patience(words[lo:hi], template)
                    if lengths and len(pairs) < self.least[k] <= common_length(words[lo:hi], template):
                        lo, pairs = self._inside(words, lo, hi, i, template)
                    coverage = len(pairs) / len(template)
                    if len(pairs) >= self.least[k]:
                        first, last = lo + pairs[0][0], lo + pairs[-1][0]
                        out.append((k, coverage, first, last))
                        insort(taken, (first, last))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, license, coverage, first_word, last_word): every place of ``docs`` that aligns with at least ``threshold`` of a template.

    Words are those of the whole text (``words_of``), numbered from 0. Matches of one template do not overlap; those of different
    templates may. Null and empty texts match nothing. Repeated rows are returned as often, null ids too. Other columns are
    ignored, whatever their names. No rows or no templates: no rows.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in tb.blocks(tb.rows_of(texts)):
                found = [(lo + r, *x) for r, t in enumerate(texts.slice(lo, hi - lo).to_pylist()) if t for x in scanner.scan(t)]
                if found:
                    row, k, coverage, first, last = map(np.array, zip(*found, strict=True))
                    columns = [pa.array([scanner.names[i] for i in k]), pa.array(np.round(coverage, 6)), pa.array(first), pa.array(last)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], ["id", "license", "coverage", "first_word", "last_word"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, license string, coverage double, first_word long, last_word long").withColumnRenamed("id", id_col)
