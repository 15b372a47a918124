"""Licence scan: texts compared to licence templates by the Dice coefficient of word bigrams.

Normalised words are maximal runs of ASCII letters and digits and of non-ASCII bytes, A-Z
lower-cased. The units compared are each line, each paragraph (lines up to one without a
word), the whole text, and windows: runs of words anywhere in the text, across lines and
paragraphs. The coefficient of a unit of n distinct bigrams and a template of
m is 2 * common / (n + m); it can reach t only for n between m t/(2 - t) and m (2 - t)/t
with at least m t/(2 - t) in common, which rules out most templates by size, and most texts
by the template's bigrams in them.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U64, Words, ragged, slices, text_bytes

#: Notices and short texts by which works state a licence.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
#: Full texts, in files of the package.
for _name, _files in {"Apache-2.0": ["Apache-2.0"], "BSD": ["BSD"], "GPL-2.0": ["GPL-2"], "GPL-3.0": ["GPL-3"], "LGPL": ["LGPL-2.1", "LGPL-3"], "MPL-2.0": ["MPL-2.0"]}.items():
    TEMPLATES[_name] += [pkgutil.get_data(__package__, f"licences/{f}.txt").decode() for f in _files]

_NORMAL = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _NORMAL[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_NORMAL[0x41:0x5B] += 32


def _normal(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The column's normalised bytes, and where its line feeds are."""
    data, offsets = text_bytes(column)
    buffers = [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(_NORMAL[data].tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(column), buffers), np.flatnonzero(data == 0x0A)


class Matcher:
    """Finds the licence templates that a unit of text reaches a coefficient with."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.names, texts = zip(*[(name, t) for name, ts in sorted(templates.items()) for t in ts], strict=True)
        words = Words(_normal(pa.array(texts, pa.string()))[0])
        h, counts = words.windows(2, short=True)
        self.sets = [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]
        self.sizes = np.array([len(s) for s in self.sets])
        self.known = np.unique(h)
        self.low, self.high = self.sizes.min() * threshold / (2 - threshold) - 1e-9, self.sizes.max() * (2 - threshold) / threshold + 1e-9
        self.single = any(c == 1 for c in words.counts.tolist())
        self.lone = np.array([c == 1 for c in words.counts.tolist()])
        # a coefficient t takes m t/(2 - t) common bigrams, of at most m (2 - t)/t
        self.need = np.maximum(1, np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)).astype(np.int64)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        # templates of known bigram g: owners[begin[g] : begin[g + 1]]
        place = np.searchsorted(self.known, np.concatenate(self.sets))
        order = np.argsort(place, kind="stable")
        self.owners = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.begin = np.searchsorted(place[order], np.arange(len(self.known) + 1))

    def best(self, grams: np.ndarray) -> tuple[float, int]:
        """The best coefficient of these distinct bigrams, and its template (of equal ones the first)."""
        n, t = len(grams), self.threshold
        fit = np.flatnonzero((n * (2 - t) >= self.sizes * t - 1e-9) & (self.sizes * (2 - t) >= n * t - 1e-9))
        top = (0.0, -1)
        for i in fit.tolist():
            score = 2 * len(np.intersect1d(grams, self.sets[i], assume_unique=True)) / (n + len(self.sets[i]))
            if score >= t and score > top[0]:
                top = (score, i)
        return top


SCHEMA = "license string, score double, unit string, n_units long, licenses array<string>"


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, score, unit, n_units and licenses of each row of ``docs`` (doc_id, text).

    license, score and unit ('text', 'paragraph', 'line' or 'window') are those of the unit with the
    largest coefficient of at least ``threshold``; of equal ones the first kind of these, then
    the first in the text, then the licence first by name. n_units is the number of
    lines, paragraphs, texts and windows that reach it (a paragraph of one line is a line only, a text of one
    paragraph a paragraph only; windows that say no more than others are left out, see
    ``matched_windows``) and licenses the sorted distinct licences of all. A unit of one word
    counts as one bigram, and two units of one word as equal only if the word is. Without such a unit, and for a null or empty text, license, score
    and unit are null, n_units 0 and licenses empty. Rows repeating a doc_id are scanned one by one;
    other columns are not read.
    """
    matcher = Matcher(templates or TEMPLATES, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            column, feeds = _normal(part.column("text"))
            words = Words(column)
            out = [[None, None, None, 0, []] for _ in range(part.num_rows)]
            both = matched_units(words, feeds, matcher)
            for d, more in matched_windows(words, matcher, both).items():
                both.setdefault(d, []).extend(more)
            for d, found in both.items():
                score, kind, _, i, _ = min(found, key=lambda f: (-f[0], f[1], f[2], f[3]))
                out[d] = [matcher.names[i], score, ("text", "paragraph", "line", "window")[kind], len(found), sorted({matcher.names[f[3]] for f in found})]
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([part.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.string()))], ["doc_id", "license", "score", "unit", "n_units", "licenses"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def units(words: Words, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and kind (0 text, 1 paragraph, 2 line) of all units with a word, each once."""
    n = len(words.counts)
    # lines begin at text starts and after line feeds; those without a word are empty spans
    begins = np.sort(np.concatenate((words.offsets[:-1], feeds + 1)))
    doc = np.searchsorted(words.offsets, begins, "right") - 1
    first = np.searchsorted(words.starts, begins)
    end = np.append(first[1:], len(words.starts))
    full = end > first
    # a paragraph begins at a line with a word that follows none in its text
    opens = full.copy()
    opens[1:] &= ~(full[:-1] & (doc[1:] == doc[:-1]))
    heads = np.flatnonzero(opens)
    tails = np.flatnonzero(full & np.append(opens[1:] | ~full[1:] | (doc[1:] != doc[:-1]), True)) if len(full) else heads
    rows = np.concatenate((
        np.stack((first[full], end[full], np.full(int(full.sum()), 2)), 1),
        np.stack((first[heads], end[tails], np.full(len(heads), 1)), 1),
        np.stack((words.first[:-1], words.first[1:], np.zeros(n, np.int64)), 1)[words.counts > 0],
    ))
    # of equal spans the smallest kind of unit stays
    rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def bigrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bigrams, the word at which each begins, and the same by word (0 at the last of a text)."""
    h, counts = words.windows(2)
    grams = np.zeros(len(words.starts), U64)
    at = np.repeat(words.first[:-1], counts) + ragged(counts)
    grams[at] = h
    return h, at, grams


def matched_units(words: Words, feeds: np.ndarray, matcher: Matcher) -> dict[int, list[tuple[float, int, int, int, int]]]:
    """By text: (coefficient, kind, first word, template, end) of its lines, paragraphs and text that reach a template."""
    h, at, grams = bigrams(words)
    known = np.zeros(len(grams) + 1, np.int64)
    place = np.minimum(np.searchsorted(matcher.known, h), len(matcher.known) - 1)
    known[at + 1] = matcher.known[place] == h
    known = np.cumsum(known)
    first, end, kind = units(words, feeds)
    # a coefficient t takes m t/(2 - t) common bigrams
    need = max(1, int(np.ceil(matcher.sizes.min() * matcher.threshold / (2 - matcher.threshold) - 1e-9)))
    maybe = (known[end - 1] - known[first] >= need) | (end - first == 1)
    found: dict[int, list] = {}
    docs = np.searchsorted(words.first, first, "right") - 1
    for x, y, k, d in zip(first[maybe].tolist(), end[maybe].tolist(), kind[maybe].tolist(), docs[maybe].tolist(), strict=True):
        if y - x == 1:
            if not matcher.single:
                continue
            unit = words.spans(np.array([x]), 1)
        else:
            unit = np.unique(grams[x : y - 1])
            if not matcher.low <= len(unit) <= matcher.high:
                continue
        score, i = matcher.best(unit)
        if i >= 0:
            found.setdefault(d, []).append((score, k, x, i, y))
    return found


def matched_windows(words: Words, matcher: Matcher, found: dict[int, list[tuple[float, int, int, int, int]]]) -> dict[int, list[tuple[float, int, int, int, int]]]:
    """By text: (coefficient, 3, first word, template, end) of its windows that reach a template.

    Every window that can be the best of its place is tried: one that begins and ends with a
    bigram of the template, neither of which it has a second time (without such an end it
    would do as well). A window gives way to an overlapping unit or window of ``found`` or of these
    with no smaller coefficient whose template holds at least half of its common bigrams.
    """
    h, at, grams = bigrams(words)
    if matcher.single:  # templates of one word occur at words
        every = np.arange(len(words.starts))
        h, at, lone = np.concatenate((h, words.spans(every, 1))), np.concatenate((at, every)), np.arange(len(h) + len(every)) >= len(h)
    else:
        lone = np.zeros(len(h), bool)
    place = np.minimum(np.searchsorted(matcher.known, h), len(matcher.known) - 1)
    seed = np.flatnonzero(matcher.known[place] == h)
    times = np.diff(matcher.begin)[place[seed]]
    seed = np.repeat(seed, times)
    place = place[seed]
    template = matcher.owners[matcher.begin[place] + ragged(times)]
    fits = matcher.lone[template] == lone[seed]
    seed, place, template = seed[fits], place[fits], template[fits]
    at = at[seed]
    # (text, template) with enough distinct bigrams
    n, k = len(matcher.sets), len(matcher.known)
    pair = (np.searchsorted(words.first, at, "right") - 1) * n + template
    pairs, distinct = np.unique(np.unique(pair * k + place) // k, return_counts=True)
    pairs = pairs[distinct >= matcher.need[pairs % n]]
    order = np.flatnonzero(np.isin(pair, pairs))
    order = order[np.argsort(pair[order], kind="stable")]
    cuts = np.searchsorted(pair[order], np.append(pairs, np.iinfo(np.int64).max))
    tried: dict[int, list] = {}
    last, text = -1, None
    for j, (d, i) in enumerate(zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True)):
        places = at[order[cuts[j] : cuts[j + 1]]]
        if matcher.lone[i]:
            tried.setdefault(d, []).extend((1.0, 3, x, i, x + 1) for x in places.tolist())
            continue
        base = int(words.first[d])
        if d != last:
            last, text = d, _neighbours(grams[base : int(words.first[d + 1]) - 1])
        tried.setdefault(d, []).extend((score, 3, base + x, i, base + y) for score, x, y in _windows(*text, places - base, int(matcher.sizes[i]), int(matcher.need[i]), int(matcher.most[i]), matcher.threshold))
    out: dict[int, list] = {}
    for d, windows in tried.items():
        kept: dict[int, list[tuple[int, int]]] = {}  # by template, spans that do not overlap
        units: list[tuple[float, int, int, int, int]] = found.get(d, [])
        for w in sorted(windows, key=lambda w: (-w[0], w[2], w[4], w[3])):
            score, _, x, i, y = w
            rivals = {u[3] for u in units if u[0] >= score and u[2] < y and u[4] > x}
            for other, spans in kept.items():
                p = bisect_left(spans, (y, 0))  # those before begin before y
                if p and spans[p - 1][1] > x:
                    rivals.add(other)
            if i in rivals:
                continue
            if rivals:
                own = words.spans(np.array([x]), 1) if matcher.lone[i] else np.intersect1d(grams[x : y - 1], matcher.sets[i])
                if any(2 * np.isin(own, matcher.sets[r]).sum() >= len(own) for r in rivals):
                    continue
            insort(kept.setdefault(i, []), (x, y))
            out.setdefault(d, []).append(w)
    return out


def _neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bigram occurs before (-1: nowhere) and next (their number: nowhere)."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _windows(before: np.ndarray, after: np.ndarray, places: np.ndarray, m: int, need: int, most: int, threshold: float) -> Iterator[tuple[float, int, int]]:
    """(coefficient, first word, end): from each place the best window that reaches the threshold."""
    hit = np.zeros(len(before), bool)
    hit[places] = True
    # distinct bigrams of the template from each place to the end of the text
    rest = np.cumsum((hit & (after == len(after)))[::-1])[::-1]
    # a window from s that has enough takes in the place of `need` - 1 hits later, and ends before s occurs again
    far = np.append(places[need - 1 :], np.full(min(need - 1, len(places)), len(before)))
    for s in places[(rest[places] >= need) & (far < after[places])].tolist():
        stop, step = int(after[s]), 2 * most
        while True:
            end = min(stop, s + step)
            fresh = before[s:end] < s
            n = np.cumsum(fresh)
            if end == stop or n[-1] > most:
                break
            step *= 2
        common = np.cumsum(fresh & hit[s:end])
        if common[-1] < need:
            continue
        score = np.where(n <= most, 2 * common / (n + m), 0.0)
        e = int(score.argmax())
        if score[e] >= threshold:
            yield float(score[e]), s, s + e + 2
