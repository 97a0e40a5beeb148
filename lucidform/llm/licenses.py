"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are words; every run of GRAM words has a hash, and of each WINDOW of hashes the smallest is kept in an
inverted index (hash to template and place).  All runs of a document are looked up, so any stretch of
GRAM + WINDOW - 1 template words is met.  Hits of a template near one diagonal make a candidate; a local alignment of
the template with that part of the document, in a band around the diagonal, tells how much of it is there and where.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, chunks
from lucidform.llm.words import split_words

GRAM, WINDOW, BAND = 4, 4, 12
#: Least share of a template's words that must be matched.
COVERED = 0.6
TRIMMED = ".,;:!?\"'`()[]{}<>*#/-_“”‘’«»"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# fixed values: notices of well-known licenses
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


class Index(NamedTuple):
    """grams: sorted hashes; posts: for each, template and place.  Size follows the templates."""

    grams: np.ndarray
    template: np.ndarray
    place: np.ndarray
    words: list[list[str]]
    names: list[str]


class Match(NamedTuple):
    template: int
    matched: int
    start: int
    end: int


def plain(word: str) -> str:
    return word.strip(TRIMMED).lower()


def hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of ``gram`` word hashes."""
    out = np.zeros(max(0, len(codes) - gram + 1), dtype=np.uint64)
    for j in range(gram):
        out = (out ^ codes[j : len(codes) - gram + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every window."""
    if len(values) <= window:
        return np.arange(len(values)) if len(values) < window else np.array([len(values) - 1 - int(values[::-1].argmin())])
    windows = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(len(windows)) + window - 1 - windows[:, ::-1].argmin(1))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def build_index(templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = GRAM, window: int = WINDOW) -> Index:
    """Inverted index over the templates' fingerprints.  Templates shorter than ``gram`` words are never found."""
    words = [[p for w in WORD.findall(text) if (p := plain(w))] for _, text in templates]
    posts = []
    for t, own in enumerate(words):
        values = hashes(np.array([word_hash(w) for w in own], dtype=np.uint64), gram)
        posts += [(int(values[p]), t, int(p)) for p in winnow(values, window)]
    posts.sort()
    return Index(np.array([p[0] for p in posts], dtype=np.uint64), np.array([p[1] for p in posts], dtype=np.int64), np.array([p[2] for p in posts], dtype=np.int64), words, [n for n, _ in templates])


def align(template: Sequence[str], text: Sequence[str], diagonal: int, band: int = BAND, lo: int = 0, hi: int | None = None) -> Match | None:
    """Best local alignment within text[lo:hi] with text place - template place within ``band`` of ``diagonal``: equal
    words score 2, others and gaps -1.  Of equal scores the one that ends first counts."""
    hi = len(text) if hi is None else hi
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(lo, i + diagonal - band), min(hi, i + diagonal + band + 1)):
            score, matched, start = before.get(j - 1, (0, 0, j))
            if score == 0:
                matched, start = 0, j
            cell = (score + 2, matched + 1, start) if word == text[j] else (score - 1, matched, start)
            for other in (before.get(j), now.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                continue
            now[j] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = now
    return Match(-1, best[1], best[2], best[3]) if best[0] else None


def matches(index: Index, words: Sequence[str], hits: list[tuple[int, int, int]], covered: float = COVERED) -> list[Match]:
    """Templates in one document from its hits (template, template place, text place), best first where they overlap."""
    found: set[Match] = set()
    groups: dict[tuple[int, int], list[int]] = {}
    for t, p, q in sorted(hits, key=lambda h: (h[0], h[2] - h[1])):
        near = next((k for k in ((t, (q - p) // BAND), (t, (q - p) // BAND - 1)) if k in groups), (t, (q - p) // BAND))
        groups.setdefault(near, []).append(q - p)
    for (t, _), diagonals in groups.items():
        for d in sorted({diagonals[0], diagonals[len(diagonals) // 2], diagonals[-1]}):
            open_ = [(0, len(words))]
            while open_:  # what lies on either side of a match may hold another
                lo, hi = open_.pop()
                m = align(index.words[t], words, d, lo=lo, hi=hi)
                if m and m.matched >= covered * len(index.words[t]):
                    found.add(m._replace(template=t))
                    open_ += [(lo, m.start), (m.end, hi)]
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-m.matched, -m.matched / len(index.words[m.template]), m.template, m.start)):
        if all(m.end <= k.start or m.start >= k.end for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.start)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """(doc_id, license, template, coverage, matched, start, end) of each match in whole texts.

    ``start`` and ``end`` are character places in the text, ``coverage`` the share of the template's words matched.
    Overlapping matches leave the one with more words.  Null, empty and short texts match nothing; repeated rows are
    scanned each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(templates)
        known = np.unique(index.grams)
        for batch in chunks(batches, "text"):
            codes, distinct, bounds = split_words(batch.column("text"))
            trimmed = pc.utf8_lower(pc.utf8_trim(distinct, characters=TRIMMED))
            value = np.fromiter(map(word_hash, trimmed.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(trimmed))
            empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
            full = ~empty[codes] if len(codes) else np.zeros(0, dtype=bool)
            at = np.concatenate([[0], np.cumsum(full)])[bounds]
            values = hashes(value[codes[full]])
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hit = np.flatnonzero(known[place] == values) if len(known) else np.zeros(0, dtype=np.int64)
            owner = np.searchsorted(at, hit, side="right") - 1
            ok = hit + GRAM <= at[owner + 1]
            rows = []
            for d in np.unique(owner[ok]):
                text = batch.column("text")[int(d)].as_py()
                spans = [(m.start(), m.end(), p) for m in WORD.finditer(text) if (p := plain(m.group()))]
                hits = []
                for q in hit[ok & (owner == d)]:
                    lo, hi = np.searchsorted(index.grams, values[q], side="left"), np.searchsorted(index.grams, values[q], side="right")
                    hits += [(int(index.template[k]), int(index.place[k]), int(q - at[d])) for k in range(lo, hi)]
                key = batch.column("doc_id")[int(d)].as_py()
                for m in matches(index, [s[2] for s in spans], hits, covered):
                    rows.append((key, index.names[m.template], m.template, m.matched / len(index.words[m.template]), m.matched, spans[m.start][0], spans[m.end - 1][1]))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "license", "template", "coverage", "matched", "start", "end"])

    bounded_batches(docs)
    plain_rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain_rows.mapInArrow(run, "doc_id bigint, license string, template int, coverage double, matched bigint, start bigint, end bigint")
