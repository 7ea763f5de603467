"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of n words belongs to the class with the least stride s >= n (a power of two, 8 at
least).  A document is read in windows of 2 s shingles that start every s words, so each run of n words
lies whole in some window.

Templates of up to ``EXACT`` = 16 words are few shingles in a wide window, too few for MinHash.  They are looked up exactly: a window that
holds ``need`` of a template's k distinct shingles holds one of any k - need + 1 of them, so each place of one of those
makes the windows over it candidates, and none is missed.

Longer templates (n > s / 2, so s >= 32 and n >= 17) are retrieved by MinHash.  With k = n - 4 shingles (no repeats), of which a window holds c, the Jaccard
similarity is c / (2 s + k - c) at least.  Bands are single MinHash values, so ``BANDS`` = 48 find it with probability
1 - (1 - J)**48.  The worst verified case is containment 0.8 at n = 17, s = 32: c = 11, k = 13, J = 1/6, probability 0.9998; whole
templates and the wider classes lie above it.
Candidates are verified by the exact share of the template's distinct shingles that the window holds; 0.8
or more is a match.

Block minima are formed once, for the least stride, and merged for the wider ones.  Templates of
less than five words are one shingle of all their words, looked up with shingles of
that width.  Templates are few and fixed (``MAX_TEMPLATES`` is checked) and are broadcast; nothing is shuffled.

Defined results: null texts, empty texts and templates without words match nothing; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from markwright.llm.hashing import SHINGLE, U64, HashIndex, batches, mix, shingle_hashes, token_hashes
from markwright.llm.sampling import bounded_batches

BANDS = 48
THRESHOLD = 0.8
BASE = 8
EXACT = 16
MAX_TEMPLATES = 5_000

# Short notices, the usual short forms, and opening or operative passages of widely used licenses.  A line
# gives a row for each template that it holds.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-available": "Available under the Apache License",
    "apache-distributed": "Distributed under the Apache License",
    "apache-provided": "Provided under the Apache License",
    "apache-released": "Released under the Apache License",
    "apache-2.0-short": "under the Apache 2.0 License",
    "bsd-2-short": "under the BSD 2-Clause License",
    "bsd-3-short": "under the BSD 3-Clause License",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-licensed": "Licensed under the BSD License",
    "bsd-released": "Released under the BSD License",
    "bsd-short": "under the BSD License",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-released": "Released under the GNU General Public License",
    "gpl-short": "under the GNU General Public License",
    "gpl-abbreviated": "under the GPL",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-released": "Released under the MIT License",
    "mit-under": "under the MIT License",
    "mit-short": "Licensed under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_SALTS = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _minhash(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each band, the least hash of each block of shingles; blocks are given by their starts."""
    out = np.empty((BANDS, len(starts)), U64)
    for k, salt in enumerate(_SALTS):
        hashed = shingles * salt
        hashed ^= hashed >> U64(32)
        out[k] = np.minimum.reduceat(hashed, starts)
    return out


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.classes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted(texts.items()):
            words, at = token_hashes([text])
            if n := len(words):
                stride = BASE
                while stride < n:
                    stride *= 2
                bag = np.unique(shingle_hashes(words, at)[0])
                self.classes.setdefault((min(n, SHINGLE), stride), []).append((name, bag))
        self.tables = {}
        self.lookups = {}
        for width in {w for w, s in self.classes if s <= EXACT}:
            holders: dict[int, list[tuple[int, int]]] = {}
            for stride in sorted(s for w, s in self.classes if w == width and s <= EXACT):
                for t, (_, bag) in enumerate(self.classes[width, stride]):
                    enough = np.arange(1, len(bag) + 1) / len(bag) >= threshold
                    for h in bag[: enough.sum()].tolist():
                        holders.setdefault(h, []).append((stride, t))
            self.lookups[width] = (HashIndex(np.array(list(holders), U64)), list(holders.values()))
        for key, own in self.classes.items():
            if key[1] <= EXACT:
                continue
            values = np.stack([_minhash(bag, np.zeros(1, np.int64))[:, 0] for _, bag in own])  # template, band
            index = [np.unique(values[:, k], return_inverse=True) for k in range(BANDS)]
            self.tables[key] = [(HashIndex(v), [np.flatnonzero(of == i) for i in range(len(v))]) for v, of in index]

    def matches(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int]]:
        """(text, template, containment, first word, end word) of the best window for each template found."""
        words, offsets = token_hashes(texts)
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        for width in sorted({w for w, _ in self.classes}):
            runs, at = shingle_hashes(words, offsets, width)
            if len(runs) and width in self.lookups:
                self._find(width, runs, at, np.diff(offsets), best)
            if len(runs) and any(w == width and s > EXACT for w, s in self.classes):
                self._scan(width, runs, at, np.diff(offsets), best)
        return [(row, name, *found) for (row, name), found in sorted(best.items())]

    def _find(self, width, runs, at, n_words, best) -> None:
        """The short templates, by exact lookup of shingles."""
        index, holders = self.lookups[width]
        found = index.find(runs)
        seen: dict[int, set[tuple[int, int, int]]] = {}
        for p in np.flatnonzero(found >= 0).tolist():
            r = int(np.searchsorted(at, p, "right")) - 1
            for stride, t in holders[found[p]]:
                block = (p - int(at[r])) // stride
                seen.setdefault(stride, set()).update((r, w, t) for w in (block - 1, block) if w >= 0)
        for stride, places in seen.items():
            for r, w, t in sorted(places):
                self._verify(width, stride, r, w, t, runs, at, n_words, best)

    def _verify(self, width, stride, r, w, t, runs, at, n_words, best) -> None:
        """Takes window ``w`` of text ``r`` if it holds enough of the template and more than the best one so far."""
        name, bag = self.classes[width, stride][t]
        a = at[r] + w * stride
        window = runs[a : min(a + 2 * stride, at[r + 1])]
        share = float(np.isin(bag, window).mean())
        if share >= self.threshold and share > best.get((r, name), (0.0,))[0]:
            place = np.flatnonzero(np.isin(window, bag)) + w * stride
            best[r, name] = (share, int(place[0]), int(min(place[-1] + width, n_words[r])))

    def _scan(self, width, runs, at, n_words, best) -> None:
        size = np.diff(at)
        blocks = -(-size // BASE)
        row = np.repeat(np.arange(len(size)), blocks)
        first = np.cumsum(blocks) - blocks
        number = np.arange(len(row)) - first[row]
        least = _minhash(runs, at[row] + number * BASE)
        stride = BASE
        top = max(s for w, s in self.classes if w == width)
        while True:
            # a window is two blocks; the last one of a text stands alone
            pair = least.copy()
            pair[:, :-1] = np.where(row[1:] == row[:-1], np.minimum(least[:, :-1], least[:, 1:]), least[:, :-1])
            if (width, stride) in self.tables:
                self._look(width, stride, pair, row, number, runs, at, n_words, best)
            if stride >= top:
                return
            keep = number % 2 == 0
            least, row, number = pair[:, keep], row[keep], number[keep] // 2
            stride *= 2

    def _look(self, width, stride, pair, row, number, runs, at, n_words, best) -> None:
        seen: set[tuple[int, int]] = set()
        for k, (index, members) in enumerate(self.tables[width, stride]):
            found = index.find(pair[k])
            for w in np.flatnonzero(found >= 0):
                seen.update((int(w), int(t)) for t in members[found[w]])
        for w, t in sorted(seen):
            self._verify(width, stride, int(row[w]), int(number[w]), t, runs, at, n_words, best)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, containment, first_word, end_word for each template that a document holds."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates can be broadcast")
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates, threshold)
        for part in parts:
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            out = [(ids[a + r], *rest) for a, b in batches(texts, 1 << 20) for r, *rest in own.matches(texts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "containment", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, end_word long")
