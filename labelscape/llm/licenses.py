"""Licence scan: winnowed fingerprints find candidates, banded alignment confirms them (operator 4).

Templates are cut into words; hashes of a few words in a row are winnowed and put into an inverted index. A document's winnowed hashes are looked up
there; hits of one template near one diagonal are one candidate place, which is aligned with the template inside a band around
the diagonals hit. The result says which share of the template's words matched, and where.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelscape.llm.common import rows_of
from labelscape.llm.order_minhash import MULTIPLIER, mixed
from labelscape.llm.shingles import runs_hashed

#: Wordings of well-known licences and of the lines that point to them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
}


@dataclass(frozen=True)
class Scan:
    """``gram`` words a hash and ``window`` hashes a choice: any ``gram + window - 1`` words in a row that match share one. ``band`` is how far
    an alignment may leave its diagonals, ``coverage`` the least share of a template's words that counts. Templates of fewer than
    ``short`` words are found by each run of words that a place of that coverage must have if words are left out or changed, not by
    chosen hashes; words put in between more often may part such runs."""

    gram: int = 3
    window: int = 3
    band: int = 12
    coverage: float = 0.8
    short: int = 25

    def run(self, n: int) -> int:
        """Words in a row that match in a place that covers enough of ``n`` words: those left out or changed part the others into so many runs."""
        matched = next(m for m in range(n + 1) if m >= self.coverage * n)
        return max(1, min(self.gram, -(-matched // (n - matched + 1))))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each run of letters and digits (A-Z lower-cased; anything outside ASCII is a letter), and the bytes where it starts and ends."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    return runs_hashed(data, starts, ends), starts, ends


def grams_of(numbers: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` words in a row."""
    n = max(0, len(numbers) - gram + 1)
    grams = numbers[:n].copy()
    for i in range(1, gram):
        grams = mixed(grams * MULTIPLIER + numbers[i:i + n])
    return grams


def fingerprints(numbers: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes and their places: the smallest of every ``window`` hashes in a row."""
    grams = grams_of(numbers, scan.gram)
    n = len(grams)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > scan.window:
        least = np.lib.stride_tricks.sliding_window_view(grams, scan.window).min(axis=1)
        chosen = np.zeros(n, bool)
        for i in range(scan.window):
            chosen[i:i + len(least)] |= grams[i:i + len(least)] == least
    else:
        chosen = grams == grams.min()
    at = np.flatnonzero(chosen)
    return grams[at], at


class Index:
    """Inverted index from fingerprint to (template, place); as large as the templates given."""

    def __init__(self, templates: dict[str, str], scan: Scan):
        self.scan, self.names = scan, list(templates)
        self.words = [words(text)[0] for text in templates.values()]
        #: at most half a template, so that copies that follow each other stay apart
        self.band = np.array([max(1, min(scan.band, len(w) // 2)) for w in self.words], np.int64)
        #: by length of a run (0: chosen hashes): sorted hashes, their templates and places
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for t, numbers in enumerate(self.words):
            if 0 < len(numbers) < scan.short:
                gram = scan.run(len(numbers))
                rows.setdefault(gram, []).extend((h, t, p) for p, h in enumerate(grams_of(numbers, gram)))
            else:
                rows.setdefault(0, []).extend((h, t, p) for h, p in zip(*fingerprints(numbers, scan)))
        for gram, some in rows.items():
            some.sort()
            self.parts[gram] = (np.array([r[0] for r in some], np.uint64), np.array([r[1] for r in some], np.int64),
                                np.array([r[2] for r in some], np.int64))

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Template and diagonal (word of the text less word of the template) of every hash found."""
        for gram, (known, templates, places) in self.parts.items():
            if gram:
                hashes = grams_of(numbers, gram)
                at = np.arange(len(hashes))
            else:
                hashes, at = fingerprints(numbers, self.scan)
            if not len(hashes) or not len(known):
                continue
            low = np.searchsorted(known, hashes, side="left")
            some = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == hashes)
            if not len(some):
                continue
            low = low[some]
            many = np.searchsorted(known, hashes[some], side="right") - low
            row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield templates[row], np.repeat(at[some], many) - places[row]

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template, and the first and last diagonal of hits that belong together."""
        found = list(self.hits(numbers))
        if not found:
            return
        template, diagonal = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((diagonal, template))
        template, diagonal = template[order], diagonal[order]
        new = np.concatenate([[True], (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > self.band[template[1:]])])
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(template)]]) - 1
        for a, b in zip(starts, ends):
            yield int(template[a]), int(diagonal[a]), int(diagonal[b])

    def matches(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(name, start, end, words matched, words of the template) of every place that covers enough; code points, ends excluded.

        Places of one template that overlap are one, the better (then the earlier).
        """
        numbers, starts, ends = words(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, first, last in self.candidates(numbers):
            matched, a, b = align(self.words[t], numbers, first - int(self.band[t]), last + int(self.band[t]))
            if matched and matched >= self.scan.coverage * len(self.words[t]):
                found.setdefault(t, []).append((-matched, a, b))
        if not found:
            return []
        points = np.cumsum(np.concatenate([[0], (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80]))
        out = []
        for t, places in found.items():
            taken: list[tuple[int, int]] = []
            for matched, a, b in sorted(places):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    out.append((self.names[t], int(points[starts[a]]), int(points[ends[b]]), -matched, len(self.words[t])))
        return sorted(out, key=lambda m: (m[1], m[0]))


def align(template: np.ndarray, numbers: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
    """Most words of ``template`` matched in order by words of the text on diagonals ``first`` to ``last``, and the first and last word matched.

    A match scores 2, a word left out on either side -1 once something has matched; the best-scoring stretch counts, the earliest of equals.
    """
    width = last - first + 1
    low = np.int64(-1 << 40)
    # state by diagonal: score, words matched, first word matched
    score, matched, start = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1, np.int64)
    best = (0, 0, -1, -1)
    slots = np.arange(width)
    for i, word in enumerate(template):
        place = first + slots + i  # word of the text at each diagonal
        valid = (place >= 0) & (place < len(numbers))
        equal = np.zeros(width, bool)
        equal[valid] = numbers[place[valid]] == word
        # one diagonal up: the template's word is left out
        skip_score = np.concatenate([score[1:] - 1, [low]])
        skip_matched, skip_start = np.concatenate([matched[1:], [0]]), np.concatenate([start[1:], [-1]])
        other = score - 1 >= skip_score  # both words left out together
        new_score, new_matched, new_start = np.where(other, score - 1, skip_score), np.where(other, matched, skip_matched), np.where(other, start, skip_start)
        gain = equal & (score + 2 >= new_score)
        new_score, new_matched = np.where(gain, score + 2, new_score), np.where(gain, matched + 1, new_matched)
        new_start = np.where(gain, np.where(matched > 0, start, place), new_start)
        # words of the text left out: a running best along the diagonals
        rising = np.maximum.accumulate(new_score + slots)
        source = np.maximum.accumulate(np.where(new_score + slots == rising, slots, 0))
        new_score, new_matched, new_start = rising - slots, new_matched[source], new_start[source]
        gone = new_score <= 0
        score, matched, start = np.where(gone, 0, new_score), np.where(gone, 0, new_matched), np.where(gone, -1, new_start)
        ends = np.flatnonzero(gain & (score > best[0]))
        if len(ends):
            at = ends[np.lexsort((ends, -score[ends]))[0]]
            best = (int(score[at]), int(matched[at]), int(start[at]), int(place[at]))
    return best[1:]


def license_scan(df: DataFrame, templates: dict[str, str] | None = None, scan: Scan = Scan(), *, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """key, license, start, end (code points), matched_words, template_words, coverage: one row for each place found.

    Null and empty texts have none; repeated rows are found again, null keys stay null; no templates, no rows. Other columns are not read.
    """
    index = Index(TEMPLATES if templates is None else templates, scan)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "license", "start", "end", "matched_words", "template_words", "coverage"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = [(i, *m, m[3] / m[4]) for i, value in enumerate(batch.column(1)) if value.as_py() for m in index.matches(value.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())),
                                              *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], names)

    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, license string, start long, end long, matched_words long, template_words long, coverage double")
