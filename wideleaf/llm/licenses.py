"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of m shingles (of ``WORDS`` words) belongs to the size 2^c >= m, at least ``CELL``.  Windows of two
sizes' length, one size apart, hold any place of such a length whole.  A window that holds a template has a Jaccard
similarity to it of at least 1/4 (1/8 in the smallest size, where m may be 1); with ``BANDS`` bands of one row a
template is retrieved with 1 - (3/4)^64 > 1 - 1e-7 (1 - (7/8)^64 > 0.9998).  Then shingles are compared exactly:
a match is a template of which ``CONTAINED`` or more of the shingles are in a stretch of the window that repeats none of them, and its span is
the shortest that holds them; a window may hold several.  Of templates that differ in a few words only the fullest is listed: a match
goes if one of another template shares more than three quarters of the words of both and holds more.  A template of fewer than ``WORDS`` words is one whole
shingle of its own length, and is found wherever these words stand.

Defined results: a null or empty text holds no license; templates without words are rejected; a template found in several windows is listed once for each stretch of overlapping spans; equal rows are
scanned separately and alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideleaf.llm.common import map_batches

WORDS, CONTAINED, BANDS, CELL = 5, 0.8, 64, 4

#: Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib-permission": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0-permission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "PostgreSQL-permission": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "has waived all copyright and related or neighboring rights to this work",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "rights-reserved-notice": "All rights reserved.",
}

_WORD = regex.compile(r"\w+")
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_U64 = np.uint64
_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(0, 1 << 32, BANDS, np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, BANDS, np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of what isn't ASCII, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def _hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, found), _U64, len(found))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, given the words' hashes."""
    if len(h) < size:
        return np.zeros(0, _U64)
    out = np.zeros(len(h) - size + 1, _U64)
    for i in range(size):
        out = out * _U64(0xD6E8FEB86659FD93) + h[i : len(out) + i]
    out = (out ^ (out >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return out ^ (out >> _U64(29))


def shingles(found: list[bytes]) -> np.ndarray:
    """A hash for each run of WORDS words, in order."""
    return _runs(_hashed(found), WORDS)


def _permuted(x: np.ndarray, band: int) -> np.ndarray:
    return (x >> _U64(32)).astype(np.uint32) * _FACTORS[band] + _ADDENDS[band]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names, self.sets, self.order = [], [], []
        #: number of words: the whole shingles of the templates of so few words, and their names
        self.short: dict[int, list[tuple[np.uint64, str]]] = {}
        by_size: dict[int, list[int]] = {}
        for name, text in templates.items():
            if not (own := words(text)):
                raise ValueError(f"{name} has no words")
            if len(own) < WORDS:
                self.short.setdefault(len(own), []).append((_runs(_hashed(own), len(own))[0], name))
                continue
            s, at, n = np.unique(shingles(own), return_index=True, return_counts=True)
            by_size.setdefault(max(CELL, 1 << (len(s) - 1).bit_length()), []).append(len(self.names))
            self.names.append(name)
            self.sets.append(s)
            #: how often the template has a shingle, and where first
            self.order.append((dict(zip(s.tolist(), n.tolist())), dict(zip(s.tolist(), at.tolist()))))
        #: size: for each band, sorted minima of its templates and the templates in that order
        self.bands = {}
        for size, own in by_size.items():
            bands = []
            for b in range(BANDS):
                minima = np.array([_permuted(self.sets[t], b).min() for t in own])
                order = np.argsort(minima)
                bands.append((minima[order], np.array(own)[order]))
            self.bands[size] = bands

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first, last) of windows of the shingles ``h`` that share a band with a template."""
        cells = -(-len(h) // CELL)
        padded = np.concatenate((h, np.zeros(cells * CELL - len(h), _U64)))
        found: set[tuple[int, int, int]] = set()
        for b in range(BANDS):
            x = _permuted(padded, b)
            x[len(h) :] = _NONE
            low, size = x.reshape(-1, CELL).min(1), CELL
            for want in sorted(self.bands):
                while size < want:
                    if len(low) % 2:
                        low = np.append(low, _NONE)
                    low, size = np.minimum(low[::2], low[1::2]), size * 2
                window = np.minimum(low, np.append(low[1:], _NONE))
                minima, own = self.bands[want][b]
                at = np.searchsorted(minima, window)
                at[at == len(minima)] = 0
                for w in np.flatnonzero(minima[at] == window):
                    k = at[w]
                    while k < len(minima) and minima[k] == window[w]:
                        found.add((int(own[k]), int(w) * want, (int(w) + 2) * want))
                        k += 1
        return found

    def matches(self, h: np.ndarray, first: int, last: int, template: int) -> list[tuple[int, int, float, int]]:
        """The spans of shingles in [first, last) that hold the template, none overlapping another; how much they hold of it,
        and how often they step back in it.

        A span has no shingle more often than the template.  Spans in the template's order come first, as one that
        joins the end of a copy to the start of the next would hide both; then those that hold more, then shorter ones."""
        part, own, (often, place) = h[first:last], self.sets[template], self.order[template]
        places = np.flatnonzero(np.isin(part, own))
        least = CONTAINED * len(own)
        if len(np.unique(part[places])) < least:
            return []
        at, found = places.tolist(), part[places].tolist()
        spans = []
        for i in range(len(at)):
            seen: dict[int, int] = {}
            back, before = 0, -1
            for p, x in zip(at[i:], found[i:]):
                if seen.get(x, 0) == often[x]:
                    break
                seen[x] = seen.get(x, 0) + 1
                if often[x] == 1:
                    back += place[x] < before
                    before = place[x]
                if len(seen) >= least and seen[x] == 1:
                    spans.append((first + at[i], first + p + 1, len(seen) / len(own), back))
        return _disjoint(spans)


def _disjoint(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    kept: list[tuple[int, int, float, int]] = []
    for span in sorted(set(spans), key=lambda s: (s[3], -s[2], s[1] - s[0], s[0])):
        if all(span[1] <= x[0] or span[0] >= x[1] for x in kept):
            kept.append(span)
    return kept


def _scan(batch_words: list[list[bytes]], scanner: Scanner) -> list[list[dict]]:
    """The licenses of each text.  Texts are put behind one another; windows over their borders are cut to one text."""
    single = [_hashed(w) for w in batch_words]
    hashes = [_runs(x, WORDS) for x in single]
    bounds = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U64)
    out: list[list[dict]] = [[] for _ in hashes]
    best: dict[tuple[int, int], list[tuple[int, int, float, int]]] = {}
    for t, first, last in scanner.candidates(h) if len(h) else ():
        d = int(np.searchsorted(bounds, first, "right")) - 1
        while d < len(hashes) and bounds[d] < last:
            a, b = max(first, int(bounds[d])), min(last, int(bounds[d + 1]))
            if a < b:
                for m in scanner.matches(h, a, b, t):
                    best.setdefault((d, t), []).append((m[0] - int(bounds[d]), m[1] - int(bounds[d]), *m[2:]))
            d += 1
    for (d, t), spans in best.items():
        out[d] += [{"license": scanner.names[t], "first_word": a, "last_word": b + WORDS - 2, "containment": c} for a, b, c, _ in _disjoint(spans)]
    for size, templates in scanner.short.items():
        for found, x in zip(out, single):
            runs = _runs(x, size)
            for h1, name in templates:
                free = 0
                for a in np.flatnonzero(runs == h1).tolist():
                    if a >= free:
                        free = a + size
                        found.append({"license": name, "first_word": a, "last_word": free - 1, "containment": 1.0})
    out = [_fullest(found) for found in out]
    for found in out:
        found.sort(key=lambda x: (x["first_word"], x["license"]))
    return out


def _fullest(found: list[dict]) -> list[dict]:
    """Without the matches that share more than three quarters of their words, and of the other's, with one of another template that holds more."""

    def size(a: int, b: int) -> int:
        return b - a + 1

    def covered(x: dict) -> bool:
        for y in found:
            if y["license"] != x["license"] and y["containment"] > x["containment"]:
                common = size(max(x["first_word"], y["first_word"]), min(x["last_word"], y["last_word"]))
                if 4 * common > 3 * max(size(x["first_word"], x["last_word"]), size(y["first_word"], y["last_word"])):
                    return True
        return False

    return [x for x in found if not covered(x)] if len(found) > 1 else found


_scanner: list[Scanner] = []


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_licenses, licenses (names, sorted, comma-joined) and matches, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates) if templates else (_scanner or _scanner.append(Scanner()) or _scanner)[0]
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            found_words = [words(t) for t in batch.column("text").to_pylist()]
            found = _scan(found_words, scanner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, found_words), pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    match = "array<struct<license:string,first_word:bigint,last_word:bigint,containment:double>>"
    out = map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, matches {match}")
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return out.select("doc_id", "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), "matches")
