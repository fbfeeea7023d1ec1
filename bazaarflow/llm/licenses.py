"""License scan by patience alignment of texts with notice templates, and the longest common subsequence where it falls short."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import hashing as H
from .common import in_small_batches

# Common public notices by SPDX identifier; pass others as ``templates``.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Proprietary": ["All rights reserved."],
}
# Whole licences.
TEMPLATES["MIT"].append(
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES["ISC"].append(
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
    "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES["BSD-3-Clause"].append(
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Part of a template's words that must be aligned.
COVERAGE = 0.9

_WORDS = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions: words unique to both sides anchor, gaps between anchors are aligned in turn."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict[str, int] = {}
        for i in range(c, d):
            once[template[i]] = -1 if template[i] in once else i
        there: dict[str, int] = {}
        for i in range(a, b):
            if once.get(text[i], -1) >= 0:
                there[text[i]] = -1 if text[i] in there else i
        anchors = sorted((i, once[w]) for w, i in there.items() if i >= 0)
        chain = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not chain:
            continue
        edges = [(a - 1, c - 1), *chain, (b, d)]
        out += chain
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def shared(counts: Counter, template: Counter) -> int:
    """Words that two texts of these counts have in common, repeats included: no alignment has more."""
    return sum(min(n, counts[w]) for w, n in template.items())


def nearest(words: list[str], places: list[int], template: list[str], gap: int) -> tuple[int, int, int]:
    """Most aligned words with gaps of at most ``gap`` words of the text: (their number, first word, word after).

    A row holds, for one place and each position of the template, the best alignment that ends at this place and before
    this position: its length in the high bits, its first word in the low ones.
    """
    one, end = 1 << 40, (0, 0, 0)
    at: dict[str, list[int]] = {}
    for c, w in enumerate(template):
        at.setdefault(w, []).append(c)
    rows: deque[tuple[int, np.ndarray]] = deque()
    for p in places:
        while rows and p - rows[0][0] > gap:
            rows.popleft()
        before = np.max([r for _, r in rows], axis=0) if rows else np.zeros(len(template) + 1, np.int64)
        row = np.zeros(len(template) + 1, np.int64)
        for c in at[words[p]]:
            v = int(before[c])
            row[c + 1] = v = v + one if v else one | p
            if v >> 40 > end[0]:
                end = (v >> 40, v & (one - 1), p + 1)
        rows.append((p, np.maximum.accumulate(row)))
    return end


def cover(words: list[str], template: list[str], known: frozenset, least: float) -> tuple[float, int, int] | None:
    """Best coverage of ``template`` by a passage of ``words``: (share, first word, word after), if at least ``least``.

    Only words of the template can align, so the others are left out first. A passage has no gap of more than half the
    template's length between its aligned words; passages that hold enough words of the template, repeats included, are
    aligned one by one. Where unique words do not anchor all of the template, as in a passage that holds it twice, the
    longest common subsequence with such gaps is taken if it is longer.
    """
    need, gap, wanted = least * len(template) - 1e-9, max(2, len(template) // 2), Counter(template)
    places = [i for i, w in enumerate(words) if w in known]
    best, start = (0, 0, 0), 0
    for k in range(1, len(places) + 1):
        if k < len(places) and places[k] - places[k - 1] <= gap:
            continue
        part, start = places[start:k], k
        if len(part) < need or shared(Counter([words[i] for i in part]), wanted) < need:
            continue
        found = align([words[i] for i in part], template)
        if len(found) > best[0]:
            best = (len(found), part[found[0][0]], part[found[-1][0]] + 1)
        if len(found) < len(template) and (n := nearest(words, part, template, gap))[0] > best[0]:
            best = n
    return (best[0] / len(template), *best[1:]) if best[0] >= need else None


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def _scan(templates: dict[str, list[str]], least: float):
    def run(batches):
        known = [(name, n, t, frozenset(t), Counter(t)) for name, texts in templates.items() for n, t in enumerate(tokens(x) for x in texts) if t]
        words_of = {(name, n): len(t) for name, n, t, *_ in known}

        def size(f):
            return f["end_word"] - f["first_word"], f["coverage"] * words_of[f["license"], f["template"]]

        for batch in H.slices(batches, 1):
            rows, sizes = [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text or "")
                here = Counter(words)
                found = []
                for name, n, t, own, counts in known:
                    if shared(here, counts) >= least * len(t) - 1e-9 and (c := cover(words, t, own, least)):
                        found.append({"license": name, "template": n, "coverage": round(c[0], 6), "first_word": c[1], "end_word": c[2]})
                rows.append([f for f in found if not any(g is not f and g["first_word"] <= f["first_word"] and f["end_word"] <= g["end_word"] and size(g) > size(f) for g in found)])
                sizes.append(len(words))
            names = [sorted({f["license"] for f in r}) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rows, _FOUND)], ["doc_id", "n_words", "licenses", "found"])

    return run


@in_small_batches
def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices in each row's whole text: doc_id, n_words, licenses, found (license, template, coverage, place).

    A template is found where a passage aligns with at least ``coverage`` of its words; one inside another's longer match is
    left out. Null or empty text has no words and no license; repeated rows give the same; of equally good passages the first
    counts; texts of any length are scanned whole; other columns, whatever their names, are ignored; an empty table gives none. Templates are a parameter; each text is aligned alone, nothing is shuffled.
    """
    schema = "doc_id long, n_words long, licenses array<string>, found array<struct<license: string, template: int, coverage: double, first_word: bigint, end_word: bigint>>"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_scan(templates or TEMPLATES, coverage), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
