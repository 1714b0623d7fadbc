"""License scans by patience alignment.

A document is searched for every template (a notice or a license text).  Words
that occur once in the text and once in the template are anchors; the longest
increasing subsequence of their positions is kept, and the stretches between
neighbouring anchors are aligned in the same way.  The template is found if the
aligned words cover at least ``COVERAGE`` of it, and its own distinguishing
words are among them.

Documents are scanned where they lie: three-word seeds of the templates, a few
thousand numbers, are looked up in rolling hashes, and only the stretches around
them are aligned.  Words are folded and without punctuation (see ``textvec``).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches

COVERAGE = 0.8
SEED = 3
SCHEMA = "doc_id long, license string, template string, coverage double, start_word int, n_words int, start_byte long, end_byte long"

# Public license notices and texts, as (license, template, words
# that tell it from its like, text).
TEMPLATES: tuple[tuple[str, str, str, str], ...] = (
    ("MIT", "notice", "mit", "Released under the MIT License."),
    ("MIT", "notice-licensed", "mit", "Licensed under the MIT License."),
    (
        "MIT", "text", "permission hereby granted software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "notice", "apache 2 0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0", "header", "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "notice", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "gnu lesser general public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-3.0", "header", "gnu general public 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-4.0", "notice", "cc 4 0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "cc sa 4 0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "cc nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "name", "creative attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "notice", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "text", "permission use copy modify distribute", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "BSD-2-Clause", "text", "redistributions source binary",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "clause", "endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "text", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "notice", "cc0", "Released under CC0 1.0 Universal."),
)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(x: list, y: list) -> list[tuple[int, int]]:
    """Patience alignment of two sequences: pairs of positions of equal items.

    Equal items at both ends of a stretch pair up; between them, items that
    occur once in either side are anchors, kept by a longest increasing
    subsequence, and the gaps are aligned likewise.  A stretch without anchors
    pairs nothing more.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict = {}
        for i in range(a, b):
            once[x[i]] = -1 if x[i] in once else i
        other: dict = {}
        for j in range(c, d):
            other[y[j]] = -1 if y[j] in other else j
        pairs = sorted((i, other[v]) for v, i in once.items() if i >= 0 and other.get(v, -1) >= 0)
        if not pairs:
            continue
        anchors = [pairs[i] for i in increasing([j for _, j in pairs])]
        out += anchors
        before = (a - 1, c - 1)
        for i, j in [*anchors, (b, d)]:
            if i > before[0] + 1 and j > before[1] + 1:
                todo.append((before[0] + 1, i, before[1] + 1, j))
            before = (i, j)
    return sorted(out)


class Templates:
    """Word hashes of the templates and their seeds."""

    def __init__(self, templates: tuple[tuple[str, str, str, str], ...]):
        self.names = [t[:2] for t in templates]
        self.words, self.must, seeds = [], [], {}
        for n, (_, _, must, text) in enumerate(templates):
            words = textvec.split(pa.array([text, must]))
            cut = int(words.first[1])
            self.words.append(words.hash[:cut].tolist())
            self.must.append(set(words.hash[cut:].tolist()))
            one = textvec.split(pa.array([text]))
            g, ok = textvec.grams(one, SEED)
            for h in g[ok].tolist():
                seeds.setdefault(h, set()).add(n)
        self.seeds = np.array(sorted(seeds), np.uint64)
        self.of = [sorted(seeds[h]) for h in self.seeds.tolist()]


def find(text: list, template: list, must: set, hits: list[int], coverage: float) -> list[tuple[float, int, int]]:
    """Disjoint stretches (coverage, start, end) of ``text`` that hold the
    template, from the positions of its seeds.

    Seeds closer together than the template is long share a stretch, which is
    searched a template's length beyond them; a stretch with several copies of
    the template gives them one by one.
    """
    n, out = len(template), []
    groups: list[list[int]] = []
    for h in hits:
        if groups and h - groups[-1][-1] <= n:
            groups[-1].append(h)
        else:
            groups.append([h])
    for group in groups:
        low, high = max(0, group[0] - n), min(len(text), group[-1] + n + SEED)
        # a stretch of many copies is cut, for copies aren't unique words
        while low < high:
            end = min(high, low + 3 * n) if high - low > 4 * n else high
            best = None
            steps = set(range(low, end, max(1, n // 2)))  # one of them begins at most half a template before any copy
            for begin in sorted(steps | {max(low, h - k) for h in group if low <= h < end for k in (0, n // 2)}):
                pairs = patience(text[begin : min(end, begin + 2 * n)], template)
                if len(pairs) >= coverage * n and must <= {template[j] for _, j in pairs}:
                    share, s, e = len(pairs) / n, begin + pairs[0][0], begin + pairs[-1][0] + 1
                    if e - s <= 2 * n and (best is None or (share, s - e, -s) > (best[0], best[1] - best[2], -best[1])):
                        best = (share, s, e)
            if best:
                out.append(best)
                low = best[2]
            elif end < high:
                low = end - n
            else:
                break
    return out


def best_places(places: list[tuple]) -> list[tuple]:
    """Of overlapping places (words aligned, coverage, start, end, template) the
    one with most aligned words, then the closest fit; in text order."""
    out: list[tuple] = []
    for p in sorted(places, key=lambda p: (-p[0] * (p[0] / (p[3] - p[2])), -p[1], p[2], p[4])):
        if all(p[3] <= q[2] or p[2] >= q[3] for q in out):
            out.append(p)
    return sorted(out, key=lambda p: p[2])


def _scan(templates: Templates, coverage: float):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in textvec.slices(texts):
                words = textvec.split(texts.slice(i, j - i))
                g, ok = textvec.grams(words, SEED)
                slot = np.minimum(np.searchsorted(templates.seeds, g), len(templates.seeds) - 1)
                hit = np.flatnonzero(ok & (templates.seeds[slot] == g))
                docs = np.searchsorted(words.first, hit, side="right") - 1
                wanted: dict[tuple[int, int], list[int]] = {}
                for at, d, s in zip(hit.tolist(), docs.tolist(), slot[hit].tolist()):
                    for t in templates.of[s]:
                        wanted.setdefault((d, t), []).append(at - int(words.first[d]))
                found: dict[int, list[tuple]] = {}
                last, text = -1, []
                for (d, t), hits in sorted(wanted.items()):
                    if d != last:
                        last, text = d, words.hash[words.first[d] : words.first[d + 1]].tolist()
                    for share, s, e in find(text, templates.words[t], templates.must[t], hits, coverage):
                        found.setdefault(d, []).append((round(share * len(templates.words[t])), share, s, e, t))
                rows = []
                for d, places in sorted(found.items()):
                    at = int(words.first[d])
                    for _, share, s, e, t in best_places(places):
                        rows.append((ids[i + d].as_py(), *templates.names[t], round(share, 6), s, e - s, int(words.start[at + s]), int(words.end[at + e - 1])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def scan(docs: DataFrame, templates: tuple[tuple[str, str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per place where a template is found in a row of ``docs``:
    ``doc_id``, ``license``, ``template``, ``coverage``, the words (``start_word``,
    ``n_words``) and the bytes (``start_byte``, ``end_byte``) it spans.  Of
    templates that overlap in the text, the best one is reported.

    Null and empty texts hold nothing; null doc_ids are carried through; repeated
    rows give repeated results; other columns are ignored; an empty table gives
    no rows.
    """
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_scan(Templates(templates), coverage), SCHEMA)
