"""Licence scan: Dice coefficient over word bigrams between units of a text and licence templates.

Units are the lines, the sentences of a line or of a paragraph, the paragraphs, the whole text, and windows of
each template's size anywhere in the text, of which those of largest coefficient count that overlap no unit as good. Both sides are normalised: case
and ASCII punctuation go, words and numbers stay. A template is compared only if its size allows the threshold at
all: with a and b bigrams the coefficient is at most 2 min(a, b) / (a + b). Templates are kept in order of size, so
the allowed ones are one slice; a unit of a size that fits no template is never cut into bigrams. Windows are tried
only for templates that share enough bigrams with the text.

Templates are short notices and the whole bodies in licence_texts: Apache 2.0, BSD 3-clause, CC0, GPL 2 and 3, LGPL 2.1
and 3, MIT, MPL 2.0. The Creative Commons licences BY, BY-NC and BY-SA have notices only; others none.

Each text is scanned by itself, in one pass without a shuffle.

Defined results: null and empty texts match nothing. Of equal coefficients the earlier unit wins, then the template of the
smaller name. Repeated rows are scanned alike, null ids kept, long texts scanned whole. An empty table: no rows.
Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices by which texts state a licence, the grant of the MIT licence, and whole bodies.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Released under the 3-clause BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
for _file in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(" ".join(_file.read_text().split()))

_NOISE = str.maketrans({c: " " for c in "\x0b\x0c\r\t!\"#$%&'()*+,-/:;<=>?@[\\]^_`{|}~"})
_END = re.compile(r"\.(?= |$)", re.M)


def normalise(text: str) -> str:
    """Lower case, without punctuation; full stops stay within words as in 2.0, and line feeds stay."""
    return text.translate(_NOISE).lower()


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        made = [(bigrams(_END.sub("", normalise(t)).split()), name) for name, texts in templates.items() for t in texts]
        made = sorted(((g.total(), name, g) for g, name in made if g), key=lambda x: x[:2])
        self.sizes, self.names, self.grams, self.threshold = [m[0] for m in made], [m[1] for m in made], [m[2] for m in made], threshold
        self.least = threshold / (2 - threshold)
        self.known = set().union(*self.grams) if made else set()
        self.holding = defaultdict(list)
        for k, g in enumerate(self.grams):
            for pair in g:
                self.holding[pair].append(k)

    def slice_for(self, size: int) -> tuple[int, int]:
        """Where the templates begin and end that a unit of so many bigrams can match."""
        slack = 1e-9
        return bisect_left(self.sizes, size * self.least - slack), bisect_right(self.sizes, size / self.least + slack)

    def best(self, words: list[str], kept: dict) -> tuple[float, str] | None:
        lo, hi = kept.get(len(words)) or kept.setdefault(len(words), self.slice_for(len(words) - 1))
        if lo >= hi or len(words) < 2:
            return None
        pairs = list(zip(words, words[1:]))
        if self.known.isdisjoint(pairs):
            return None
        own, found = Counter(pairs), None
        for k in range(lo, hi):
            d = dice(own, self.grams[k])
            if d >= self.threshold and (found is None or d > found[0] or d == found[0] and self.names[k] < found[1]):
                found = (d, self.names[k])
        return found

    def windows(self, words: list[str]) -> list[tuple[float, int, int]]:
        """(coefficient, template, first word) of the windows of a template's size that match, those that begin with a bigram of it or end the text."""
        pairs, at, out = list(zip(words, words[1:])), defaultdict(list), []
        if self.known.isdisjoint(pairs):
            return out
        for i, pair in enumerate(pairs):
            if pair in self.known:
                for k in self.holding[pair]:
                    at[k].append(i)
        for k, places in at.items():
            size, grams = self.sizes[k], self.grams[k]
            if size > len(pairs) or len(places) < self.threshold * size:
                continue
            held, common, begin, end = Counter(), 0, 0, 0
            for place in places:
                first = min(place, len(pairs) - size)
                while end < len(places) and places[end] < first + size:
                    pair = pairs[places[end]]
                    held[pair] += 1
                    common += held[pair] <= grams[pair]
                    end += 1
                while places[begin] < first:
                    pair = pairs[places[begin]]
                    common -= held[pair] <= grams[pair]
                    held[pair] -= 1
                    begin += 1
                if common / size >= self.threshold:
                    out.append((common / size, k, first))
                if first < place:
                    break
        return out

    def scan(self, text: str) -> list[tuple[float, str, int, int]]:
        """(coefficient, licence, first line, lines) of all units that match."""
        out, kept, words, line_of, cover = [], {}, [], [], []
        lines = normalise(text).split("\n")
        block: list[str] = []

        def keep(found, first: int, end: int) -> None:
            out.append((*found, line_of[first], line_of[end - 1] - line_of[first] + 1))
            cover.append((first, end, found[0]))

        for i, line in enumerate([*lines, ""]):
            parts = _END.split(line)
            joined = _END.sub("", line).split() if len(parts) > 1 else line.split()
            if joined:
                start = len(words)
                words += joined
                line_of += [i] * len(joined)
                if found := self.best(joined, kept):
                    keep(found, start, len(words))
                at = start
                for s in (p.split() for p in parts) if len(parts) > 1 else ():
                    if s and len(s) < len(joined) and (found := self.best(s, kept)):
                        keep(found, at, at + len(s))
                    at += len(s)
                block.append(line)
            else:
                if len(block) > 1:
                    at = start = len(words) - sum(len(_END.sub("", x).split()) for x in block)
                    if found := self.best(words[start:], kept):
                        keep(found, start, len(words))
                    for s in (p.split() for p in _END.split(" ".join(block))):
                        if s and len(s) < len(words) - start and line_of[at] < line_of[at + len(s) - 1] and (found := self.best(s, kept)):
                            keep(found, at, at + len(s))
                        at += len(s)
                block = []
        if len(lines) > 1 and any(not x.split() for x in lines) and (found := self.best(words, kept)):
            out.append((*found, 0, len(lines)))
            cover.append((0, len(words), found[0]))
        if close := self.windows(words):
            best = [0.0] * len(words)
            for first, end, d in cover:
                best[first:end] = [max(x, d) for x in best[first:end]]
            for d, k, first in sorted(close, key=lambda x: (-x[0], -self.sizes[x[1]], x[2], self.names[x[1]])):
                end = first + self.sizes[k] + 1
                if max(best[first:end]) < d:
                    keep((d, self.names[k]), first, end)
                    best[first:end] = [d] * (end - first)
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, licence and its coefficient (null if none), all licences found, and the units (licence, dice, first_line, lines)."""
    known, kind = Templates(templates or TEMPLATES, threshold), docs.schema[id_col].dataType.simpleString()
    unit = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("lines", pa.int64())])

    def run(batches):
        for b in batches:
            best, score, names, units = [], [], [], []
            for value in b.column(1):
                found = known.scan(value.as_py() or "")
                top = max(found, key=lambda x: (x[0], -x[2]), default=(None, None))
                best.append(top[1]), score.append(top[0])
                names.append(sorted({x[1] for x in found}))
                units.append([{"licence": x[1], "dice": x[0], "first_line": x[2], "lines": x[3]} for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(units, pa.list_(unit))], names=[id_col, "licence", "dice", "licences", "units"])

    return docs.select(id_col, F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, licence string, dice double, licences array<string>, units array<struct<licence:string,dice:double,first_line:bigint,lines:bigint>>")
