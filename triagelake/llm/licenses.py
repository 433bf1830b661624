"""License notices in texts: winnowed fingerprints pick candidates, a banded alignment judges them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from importlib.resources import files
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from triagelake.llm.common import mix, only, prepared, texts

#: words of a fingerprint, and fingerprints of which the smallest is kept
GRAM, WINDOW = 3, 3
#: templates of up to so many words keep every gram, longer ones are winnowed
SHORT = 24
BAND = 6
MIN_COVERAGE = 0.8
#: the templates are sent to every task, so their number of words is limited
MAX_TEMPLATE_WORDS = 2_000_000

# fixed values: names and notices of common licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-short": "GNU General Public License v3.0",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "MIT-short": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "Copyright All rights reserved",
    "all-rights-reserved-short": "All rights reserved",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
}
# whole texts of common licenses, kept as files
FULL_TEXTS = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
TEMPLATES |= {f"{n}-text": (files("triagelake.llm") / "license_texts" / f"{n}.txt").read_text("utf-8") for n in FULL_TEXTS}

_TOKEN = re.compile(r"[^\W_]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(known: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``gram`` words, whether all of its words are known)."""
    n = len(known) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(gram):
        part = known[j : j + n]
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + part.astype(np.uint64))
        whole &= part > 0
    return h, whole


def winnow(known: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints): of each ``window`` neighbouring grams the smallest hash.

    ``known`` has a number per word, 0 for words that no template has; a gram with such a word can't
    match and is passed over. A text of fewer grams than a window is one window. Any run of
    gram + window - 1 equal words has an equal fingerprint in both texts.
    """
    h, whole = grams(known, gram)
    n = len(h)
    if n < 1:
        return np.zeros(0, np.int64), h
    h = np.where(whole, h, _NONE)
    m = min(window, n)
    least = np.lib.stride_tricks.sliding_window_view(h, m).min(axis=1)
    # a gram is kept if it is the smallest of a window that it lies in
    padded = np.concatenate((np.full(m - 1, least[0]), least, np.full(m - 1, least[-1])))
    kept = (np.lib.stride_tricks.sliding_window_view(padded, m)[:n] == h[:, None]).any(axis=1) & whole
    at = np.flatnonzero(kept)
    return at, h[at]


def _among(h: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted ``prints``."""
    return prints[np.minimum(np.searchsorted(prints, h), len(prints) - 1)] == h if len(prints) else np.zeros(len(h), bool)


def sure_gram(n: int, min_coverage: float = MIN_COVERAGE) -> int:
    """Words of the longest run, up to GRAM, that n words keep however those not needed are substituted."""
    spare = n - ceil(min_coverage * n - 1e-9)
    return max(1, min(GRAM, ceil((n - spare) / (spare + 1))))


def align(template: list[int], doc: list[int], shift: int, band: int = BAND, floor: int = 0) -> tuple[int, int, int, int]:
    """(score, equal words, first, end) of the best local alignment near the diagonal ``shift``.

    Word i of the template may meet document word i + shift + d with abs(d) <= band. An equal pair
    counts 1, an unequal pair or a left-out word -1. first and end are document words, none of them
    before ``floor``.
    """
    width = 2 * band + 1
    score, equal, first = [0] * (width + 1), [0] * width, [0] * width
    score[width] = -1
    best = (0, 0, 0, 0)
    n = len(doc)
    for i, w in enumerate(template):
        new, now_equal, now_first = [0] * (width + 1), [0] * width, [0] * width
        new[width] = -1
        for k in range(width):
            j = i + shift + k - band
            if not floor <= j < n:
                continue
            same = doc[j] == w
            top, e, f = score[k] + (1 if same else -1), equal[k] + same, first[k] if score[k] > 0 else j
            if k + 1 < width and score[k + 1] - 1 > top:  # the template word is left out
                top, e, f = score[k + 1] - 1, equal[k + 1], first[k + 1]
            if k > 0 and new[k - 1] - 1 > top:  # the document word is left out
                top, e, f = new[k - 1] - 1, now_equal[k - 1], now_first[k - 1]
            if top > 0:
                new[k], now_equal[k], now_first[k] = top, e, f
                if (top, e) > best[:2]:
                    best = (top, e, f, j + 1)
        score, equal, first = new, now_equal, now_first
    return best


@dataclass
class Index:
    """Word numbers, and for each fingerprint where the templates have it.

    ``every`` has all grams of the short templates by size of gram, ``places`` the winnowed grams of
    the others; ``counts`` are the times of each word in each template.
    """

    names: list[str]
    words: dict[str, int]
    bodies: list[list[int]]
    counts: list[tuple[np.ndarray, np.ndarray]]
    every: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]]
    prints: np.ndarray
    places: dict[int, list[tuple[int, int]]]

    def hits(self, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in the text, template, place in the template) of all equal fingerprints, by place in the text."""
        out = []
        for g, (prints, places) in self.every.items():
            h, whole = grams(known, g)
            at = np.flatnonzero(whole)
            at = at[_among(h[at], prints)]
            out += [(p, t, q) for p, f in zip(at.tolist(), h[at].tolist(), strict=True) for t, q in places[f]]
        at, h = winnow(known)
        hit = _among(h, self.prints)
        out += [(p, t, q) for p, f in zip(at[hit].tolist(), h[hit].tolist(), strict=True) for t, q in self.places[f]]
        return sorted(out)

    def at_most(self, t: int, known: np.ndarray, first: int, end: int) -> int:
        """No alignment of the template with these words of the text has more equal words than this."""
        word, times = self.counts[t]
        part = np.sort(known[max(0, first) : max(0, end)])
        return int(np.minimum(np.searchsorted(part, word, side="right") - np.searchsorted(part, word), times).sum())


def build_index(templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> Index:
    words: dict[str, int] = {}
    names = sorted(templates)
    bodies = [[words.setdefault(w, len(words) + 1) for w in _TOKEN.findall(templates[n].lower())] for n in names]
    if sum(map(len, bodies)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in all are too many to send to every task")
    places: dict[int, list[tuple[int, int]]] = {}
    every: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for t, body in enumerate(bodies):
        known = np.array(body, np.int64)
        if 0 < len(body) <= SHORT:
            g = sure_gram(len(body), min_coverage)
            for p, h in enumerate(grams(known, g)[0].tolist()):
                every.setdefault(g, {}).setdefault(h, []).append((t, p))
        else:
            for p, h in zip(*(x.tolist() for x in winnow(known)), strict=True):
                places.setdefault(h, []).append((t, p))
    sized = {g: (np.array(sorted(x), np.uint64), x) for g, x in sorted(every.items())}
    counts = [np.unique(np.array(b, np.int64), return_counts=True) for b in bodies]
    return Index(names, words, bodies, counts, sized, np.array(sorted(places), np.uint64), places)


def find_notices(text: str, index: Index, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> list[dict]:
    """The notices of a text by place: license, coverage of its template, span in code points.

    Of overlapping matches of one template the first hit's alignment stands; matches of different
    templates may overlap. Coverage is the share of template words met by an equal word. A template of
    up to SHORT words is aligned wherever the text has one of its grams, which no substitutions that
    leave the coverage can prevent; a longer one needs gram + window - 1 equal words in a row.
    """
    low = text.lower()
    known = np.fromiter((index.words.get(w, 0) for w in _TOKEN.findall(low)), dtype=np.int64)
    hits = index.hits(known)
    if not hits:
        return []
    if len(low) == len(text):
        spans = [m.span() for m in _TOKEN.finditer(low)]
    else:  # lower-casing changed the length: words are looked up in the text itself
        spans = [m.span() for m in _TOKEN.finditer(text)]
        known = np.fromiter((index.words.get(text[a:b].lower(), 0) for a, b in spans), dtype=np.int64)
        hits = index.hits(known)
    doc = known.tolist()
    found, upto, tried = [], {}, set()
    for p, t, q in hits:
        since = upto.get(t, 0)
        if p < since or (t, p - q, since) in tried:
            continue
        tried.add((t, p - q, since))
        body = index.bodies[t]
        need = min_coverage * len(body) - 1e-9
        if index.at_most(t, known, max(since, p - q - band), p - q + len(body) + band) < need:
            continue
        score, equal, first, end = align(body, doc, p - q, band, since)
        if equal >= need:
            upto[t] = end
            found.append({"license": index.names[t], "coverage": equal / len(body), "n_equal": equal, "start": spans[first][0], "end": spans[end - 1][1]})
    return sorted(found, key=lambda r: (r["start"], r["license"]))


def license_notices(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_equal, start, end: one row per notice found in a row's text.

    Rows without a notice, null and empty texts give none; equal rows give equal rows; a null doc_id
    is passed through. Whole texts are read, however long; memory is bounded by one batch.
    """
    prepared(docs.sparkSession)
    index = build_index(templates, min_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, r) for i, t in enumerate(texts(b)) for r in find_notices(t, index, min_coverage)]
            if rows:
                own = {c: [r[c] for _, r in rows] for c in ("license", "coverage", "n_equal", "start", "end")}
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array([i for i, _ in rows]))} | own)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, n_equal long, start long, end long")
