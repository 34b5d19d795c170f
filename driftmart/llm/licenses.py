"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms.

Texts and templates are reduced to lower-case ASCII letters and digits. Of a template's
hashes over ``GRAM`` such characters, the smallest of every ``WINDOW`` neighbours is a
fingerprint; an inverted index leads from a fingerprint to its templates and places. A
text's hashes are looked up in it. Hits of one template on nearly one diagonal (text place
minus template place) are a candidate, unless too few of the template's fingerprints are
hit. A local alignment in a band around the diagonal then tells which part of the template
is matched where; ``COVERAGE`` of it must be, and of the text between the match's ends, and
``NAMES`` of licences and versions must stand in it letter by letter. Where a template
follows itself, each repetition is aligned on its own. Of overlapping matches the one with more
matched characters stays, then the higher coverage, then the first id.

Templates are few and part of the program; every text is read whole, in bounded steps.
Positions are code points, ends exclusive.

Defined cases: NULL and empty texts have no licenses; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmart.llm.common import mix64, random_words, ranges, steps, string_bytes

GRAM = 12
WINDOW = 8
BAND = 48
COVERAGE = 0.8
# Share of a template's fingerprints that a candidate has to hit.
FINGERPRINTS = 0.3

# Common license statements and notices.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-statement": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-statement": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

# Names and versions in templates, which have to stand in a match letter by letter.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "AGPL-notice": ("GNU Affero General Public License", "either version 3"),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "Apache-2.0-notice": ("Apache License, Version 2.0",),
    "BSD-statement": ("BSD License",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-4.0-notice": ("Creative Commons Attribution 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "GPL-notice": ("GNU General Public License", "either version 3"),
    "GPL-warranty": ("GNU General Public License",),
    "ISC-statement": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0",),
}

_CODE = np.zeros(256, np.uint8)
_CODE[48:58] = np.arange(48, 58)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_VALUE = random_words(256, 21)
_POWER = random_words(GRAM, 22)


def _letters(text: str) -> np.ndarray:
    code = _CODE[np.frombuffer(text.encode(), np.uint8)]
    return code[code > 0]


def gram_hashes(letters: np.ndarray) -> np.ndarray:
    if len(letters) < GRAM:
        return np.zeros(0, np.uint64)
    count = len(letters) - GRAM + 1
    total = np.zeros(count, np.uint64)
    values = _VALUE[letters]
    for k in range(GRAM):
        total += values[k : k + count] * _POWER[k]
    return mix64(total)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the rightmost smallest hash of every window."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows.argmin(axis=1))


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    letters: tuple[np.ndarray, ...]
    prints: np.ndarray  # fingerprints per template
    hashes: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # by the low 16 bits
    exact: tuple[tuple[bytes, ...], ...]  # letters of names and versions


def build_index(templates: Mapping[str, str] = TEMPLATES) -> Index:
    names = tuple(templates)
    letters = []
    for name in names:
        letters.append(_letters(templates[name]))
    grams = [gram_hashes(x) for x in letters]
    kept = [winnow(h) for h in grams]
    hashes = np.concatenate([h[k] for h, k in zip(grams, kept)])
    order = np.argsort(hashes, kind="stable")
    maybe = np.zeros(1 << 16, bool)
    maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(
        names,
        tuple(letters),
        np.array([len(k) for k in kept]),
        hashes[order],
        np.repeat(np.arange(len(names)), [len(k) for k in kept])[order],
        np.concatenate(kept)[order],
        maybe,
        tuple(tuple(_letters(x).tobytes() for x in NAMES.get(name, ())) for name in names),
    )


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched characters, and the first and end place in ``text``, of the best local alignment.

    Cell (i, j) of the band stands for template place i and text place i + diagonal + j - band.
    A match counts 2, a mismatch or a gap -1.
    """
    rows, width = len(template), 2 * band + 1
    offset = np.arange(width)
    score = np.zeros((rows + 1, width + 1), np.int32)
    equal = np.zeros((rows, width), bool)
    for i in range(rows):
        place = i + diagonal + offset - band
        inside = (place >= 0) & (place < len(text))
        equal[i, inside] = text[place[inside]] == template[i]
        straight = score[i, :-1] + np.where(equal[i], 2, -1)
        skipped = score[i, 1:] - 1  # the template's character has no partner
        best = np.maximum(np.maximum(straight, skipped), 0)
        best[~inside] = 0
        score[i + 1, :-1] = np.maximum.accumulate(best + offset) - offset
    i, j = np.unravel_index(int(score[1:].argmax()), (rows, width + 1))
    i = int(i)
    j = int(j)
    end, matched, first = i + diagonal + j - band + 1, 0, i + diagonal + j - band + 1
    while i >= 0 and score[i + 1, j] > 0:
        here = score[i + 1, j]
        if here == score[i, j] + (2 if equal[i, j] else -1):
            matched += int(equal[i, j])
            first = i + diagonal + j - band
            i -= 1
        elif here == score[i, j + 1] - 1:
            i, j = i - 1, j + 1
        elif j and here == score[i + 1, j - 1] - 1:
            j -= 1
        else:
            break
    return matched, max(first, 0), min(end, len(text))


def _candidates(index: Index, letters: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, template, diagonal within the row, end) of hits close to one diagonal.

    Hits that spread by half the template are of its next repetition. The end is where in the
    row a later repetition begins, as copies are at least about the template's length apart.
    """
    hashes = gram_hashes(letters)
    at = np.flatnonzero(index.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    low = np.searchsorted(index.hashes, hashes[at])
    high = np.searchsorted(index.hashes, hashes[at], side="right")
    entry = ranges(low, high - low)
    at = np.repeat(at, high - low)
    row = np.searchsorted(bounds[1:], at, side="right")
    inside = at + GRAM <= bounds[row + 1]
    entry, at, row = entry[inside], at[inside], row[inside]
    if not len(at):
        return
    template, diagonal = index.template[entry], at - bounds[row] - index.place[entry]
    order = np.lexsort((diagonal, template, row))
    row, template, diagonal, place = row[order], template[order], diagonal[order], index.place[entry][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1])
    firsts = np.append(np.flatnonzero(new), len(row))
    for a, b in zip(firsts[:-1], firsts[1:]):
        t, own = int(template[a]), diagonal[a:b]
        size = len(index.letters[t])
        cuts = [0]
        for k in range(1, b - a):
            if own[k] - own[k - 1] > BAND // 2 or own[k] - own[cuts[-1]] > min(BAND, size // 2):
                cuts.append(k)
        for c, d in zip(cuts, [*cuts[1:], int(b - a)]):
            if len(np.unique(place[a + c : a + d])) >= max(1, FINGERPRINTS * index.prints[t]):
                middle = int(np.median(own[c:d]))
                later = int(np.searchsorted(own, middle + 3 * size // 4, side="right"))
                end = int(own[later]) + size // 10 if later < len(own) else int(bounds[row[a] + 1] - bounds[row[a]])
                yield int(row[a]), t, middle, end


def _named(index: Index, t: int, raw: np.ndarray, places: np.ndarray, letters: np.ndarray) -> bool:
    """Whether the template's names and versions stand in the matched text, as whole words."""
    text = letters.tobytes()
    for name in index.exact[t]:
        at = text.find(name)
        while at >= 0:
            before, after = int(places[at]) - 1, int(places[at + len(name) - 1]) + 1
            follows = raw[after : after + 2]
            version = name[-1:].isdigit() and len(follows) == 2 and follows[0] == 46 and 48 <= follows[1] <= 57
            if not (before >= 0 and _CODE[raw[before]]) and not (len(follows) and _CODE[follows[0]]) and not version:
                break
            at = text.find(name, at + 1)
        else:
            return False
    return True


def find(index: Index, raw: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, license, coverage) of every row, in code points."""
    base = starts[0]
    code = _CODE[raw[base : starts[-1]]]
    kept = np.flatnonzero(code)
    bounds = np.searchsorted(kept, starts - base)
    letters = code[kept]
    found: list[list[tuple]] = [[] for _ in range(len(starts) - 1)]
    last = (-1, -1, 0)
    for row, t, diagonal, stop in _candidates(index, letters, bounds):
        own = letters[bounds[row] : bounds[row + 1]]
        # A repetition is aligned behind the one found before.
        start = last[2] if last[:2] == (row, t) else 0
        matched, first, end = align(index.letters[t], own[start:stop], diagonal - start)
        first, end = first + start, end + start
        coverage = matched / len(index.letters[t])
        if coverage >= COVERAGE and end > first and matched >= COVERAGE * (end - first):
            places = kept[bounds[row] + first : bounds[row] + end] + base
            inside = places - starts[row]
            if _named(index, t, raw[starts[row] : starts[row + 1]], inside, own[first:end]):
                found[row].append((matched, coverage, t, int(places[0]), int(places[-1]) + 1))
                last = (row, t, end)
    out = []
    for row, matches in enumerate(found):
        chosen: list[tuple] = []
        for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            if all(m[4] <= c[3] or c[4] <= m[3] for c in chosen):
                chosen.append(m)
        if chosen:
            points = np.concatenate([[0], np.cumsum((raw[starts[row] : starts[row + 1]] & 0xC0) != 0x80)])
            chosen = sorted(
                (int(points[m[3] - starts[row]]), int(points[m[4] - starts[row]]), index.names[m[2]], m[1]) for m in chosen
            )
        out.append(chosen)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_matches, licenses, best_coverage, spans (license:start:end:coverage) of every row."""
    index = build_index(templates)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = string_bytes(batch.column("text"))
            found = [row for a, b in steps(starts) for row in find(index, raw, starts[a : b + 1])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) for r in found], pa.int64()),
                    pa.array([",".join(sorted({m[2] for m in r})) for r in found], pa.string()),
                    pa.array([max((m[3] for m in r), default=0.0) for r in found], pa.float64()),
                    pa.array([",".join(f"{n}:{a}:{b}:{c:.3f}" for a, b, n, c in r) for r in found], pa.string()),
                ],
                names=["doc_id", "n_matches", "licenses", "best_coverage", "spans"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scanned, f"doc_id {id_type}, n_matches long, licenses string, best_coverage double, spans string"
    )
