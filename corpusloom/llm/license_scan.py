"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts are words, lower-cased, of ASCII letters, digits and what is beyond ASCII. Hashes
of K words in a row of a template (of all its words, if it has fewer) are winnowed: of each WINDOW of them the smallest stays (the right one of equals).
They form an inverted index (hash, template, place), which is small and goes to every task, and all grams of a text are looked up in it, so a
stretch that shares K + WINDOW - 1 words in a row with a template is found.

One rule serves templates of every length. What a text shares with a template falls into runs on diagonals (place in the text less
place in the template); runs are chained in the order of both, over gaps of up to the template's length in words, and a chain is one
candidate. The stretch of a chain, with twice the words of the template's unmatched ends on both sides, is aligned with the whole template:
`matched_words` is the length of a longest common subsequence. At least `min_coverage` of the template must be matched, so that no alignment that
counts leaves a band whose width follows from what may be missing and what the stretch has more; within it the result is that of a
full alignment. Phrases that tell a template from others (`KEYS`, and the name in a notice) must stand in the matched stretch word for word.

A copy word for word gives way only to templates of which more words must match than it has. Of other matches that overlap, the one with more
matched words stays, then the one of higher coverage, then the first by name. All others are reported, as many as a text has. Null and empty texts have none. Rows are scanned one by one; repeated rows report their matches each; columns other
than doc_id and text are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import license_texts
from corpusloom.llm.words import HASHES, mixed

K, WINDOW = 3, 2
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# The usual notices and opening paragraphs of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def tokens(raw: bytes) -> list[bytes]:
    """Words of UTF-8 text."""
    return _WORD.findall(raw.translate(_UPPER))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, from the words' hashes."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n] + np.uint64(k))
    for j in range(1, k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the smallest of some WINDOW in a row."""
    if len(hashes) <= WINDOW:
        return np.asarray([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(rows)) + WINDOW - 1 - np.argmin(rows[:, ::-1], axis=1))


def align(template: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int] | None:
    """(length of a longest common subsequence, the first place in the text by which it is complete); None if it is shorter than `least`.

    An alignment of so many words skips at most len(template) - least words of the template before any place and leaves at least so many of the text behind it as it still has to match.
    So it stays on the diagonals from least - len(template) to len(text) - least, and only these are filled, a template's word at a time.
    """
    n, m = len(template), len(text)
    low, high = least - n, m - least
    if high < low or least > min(n, m):
        return None
    width = high - low + 1
    edge = np.zeros(width + n, np.uint64)
    held, real = np.concatenate([edge, text, edge]), np.zeros(m + 2 * len(edge), bool)
    real[len(edge) : len(edge) + m] = True
    row = np.zeros(width + 1, np.int32)  # the last place is beyond the band: nothing comes from there
    for i, word in enumerate(template):
        at = len(edge) + i + low
        same = (held[at : at + width] == word) & real[at : at + width]
        row[:-1] = np.maximum.accumulate(np.maximum(row[:-1] + same, row[1:]))
        row[-1] = 0
    best = int(row.max())
    return (best, n + low + int(np.argmax(row == best))) if best >= least else None


def stretch(template: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(matched words, begin, end) of the alignment that is complete first, and begins as late as it then can; None if it has fewer than `least` words."""
    forth = align(template, text, least)
    if forth is None:
        return None
    n, end = forth
    back = align(template[::-1], text[:end][::-1], n)
    return n, end - back[1], end


def chains(j: np.ndarray, i: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first place in the text, in the template, last place in the text, in the template) of candidates. j, i: places of shared grams."""
    d = j - i
    order = np.lexsort((j, d))
    j, i, d = j[order], i[order], d[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (j[1:] - j[:-1] > n)])
    js, ix, je, ie, w = j[cut], i[cut], np.r_[j[cut[1:] - 1], j[-1:]], np.r_[i[cut[1:] - 1], i[-1:]], np.diff(np.r_[cut, len(j)])
    order = np.lexsort((ix, js))
    js, ix, je, ie, w = js[order], ix[order], je[order], ie[order], w[order]
    best, before = w.astype(np.float64), np.full(len(w), -1)
    low = np.searchsorted(js, js - 2 * n - 1)
    for r in np.flatnonzero(low < np.arange(len(w))).tolist():
        q = slice(low[r], r)
        gain = np.where((ix[q] < ix[r]) & (ie[q] <= ie[r]) & (js[q] < js[r]) & (js[r] - je[q] <= n), best[q] - 1e-6 * np.maximum(0, js[r] - je[q]), 0)
        if len(gain) and gain.max() > 0:
            k = int(np.argmax(gain))
            best[r] += gain[k]
            before[r] = low[r] + k
    used = np.zeros(len(w), bool)
    for r in np.argsort(-best, kind="stable").tolist():
        if used[r]:
            continue
        first = r
        used[r] = True
        while before[first] >= 0 and not used[before[first]]:
            first = int(before[first])
            used[first] = True
        yield int(js[first]), int(ix[first]), int(je[r]), int(ie[r])


class Scanner:
    """templates: (name, text, phrases that must be there)."""

    def __init__(self, templates: list[tuple[str, str, tuple[str, ...]]]) -> None:
        unique = {tuple(tokens(text.encode())): (name, keys) for name, text, keys in reversed(templates)}
        unique.pop((), None)
        self.names = [name for name, _ in unique.values()]
        self.hashes = [HASHES.of(list(w)) for w in unique]
        self.n = np.asarray([len(w) for w in unique], np.int64)
        self.keys_of = [[HASHES.of(k) for k in (tokens(key.encode()) for key in keys) if k and _has(w, k)] for w, (_, keys) in zip(unique, unique.values(), strict=True)]
        index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, h in enumerate(self.hashes):
            k = min(K, len(h))
            g = grams(h, k)
            for at in winnow(g).tolist():
                index[k][int(g[at])].append((t, at))
        #: Length of grams -> sorted hashes, where each one's places begin, template and place of each.
        self.index = {}
        for k, places in index.items():
            known = np.sort(np.fromiter(places, np.uint64, len(places)))
            flat = [x for g in known.tolist() for x in places[g]]
            self.index[k] = known, np.cumsum([0, *(len(places[g]) for g in known.tolist())]), np.asarray([t for t, _ in flat]), np.asarray([i for _, i in flat])

    def _seeds(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in the text, place in the template) of shared grams."""
        found = []
        for k, (known, begin, template, place) in self.index.items():
            g = grams(text, k)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            j = np.flatnonzero(known[at] == g)
            size = begin[at[j] + 1] - begin[at[j]]
            pick = np.repeat(begin[at[j]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            found.append((template[pick], np.repeat(j, size), place[pick]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def scan(self, raw: bytes, min_coverage: float) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, distance of its words, start byte, end byte) of each match."""
        low = raw.translate(_UPPER)
        text = HASHES.of(_WORD.findall(low))
        t_of, j_of, i_of = self._seeds(text)
        if not len(t_of):
            return []
        places: dict[bytes, np.ndarray] = {}

        def where(phrase: np.ndarray) -> np.ndarray:
            key = phrase.tobytes()
            if key not in places:
                places[key] = np.flatnonzero(grams(text, len(phrase)) == grams(phrase, len(phrase))[0])
            return places[key]

        there = np.asarray([t for t in np.unique(t_of).tolist() if all(len(where(key)) for key in self.keys_of[t])], np.int64)
        order = np.lexsort((j_of, t_of))
        t_of, j_of, i_of = t_of[order], j_of[order], i_of[order]
        words, matches = np.unique(text), []
        covered = np.zeros(len(text) + 1, np.int64)  # words of an equal copy of a template that a place lies in
        seeds = {}
        for t in there[np.argsort(-self.n[there], kind="stable")].tolist():
            n, mine, end = int(self.n[t]), slice(*np.searchsorted(t_of, (t, t + 1)).tolist()), -1
            seeds[t] = j_of[mine], i_of[mine]
            for start in self._copies(self.hashes[t], text, np.unique(j_of[mine] - i_of[mine])):
                if start >= end and covered[start] < n:
                    end = start + n
                    covered[start:end] = np.maximum(covered[start:end], n)
                    matches.append((n, t, start, end))
        for t, (j, i) in seeds.items():
            template, n = self.hashes[t], int(self.n[t])
            least = max(1, int(np.ceil(min_coverage * n - 1e-9)))
            open_ = covered[j] < least
            j, i = j[open_], i[open_]
            if not len(j) or np.isin(template, words).sum() < least:
                continue
            here, bare = np.zeros(len(text) + K, bool), np.zeros(len(text) + 1, np.int64)  # places of stretches of this template; up to where no region from a place on holds one
            shared = np.cumsum(np.r_[0, np.isin(text, template)])
            for j1, i1, j2, i2 in chains(j, i, n):
                a, b = max(0, j1 - 2 * i1), min(len(text), j2 + K + 2 * (n - i2))
                # A chain with an end in a stretch belongs to it; a part of a region has no more than the whole.
                if here[j1] or here[j2] or bare[a] >= b or shared[b] - shared[a] < least or np.isin(template, text[a:b]).sum() < least:
                    continue
                got = stretch(template, text[a:b], least)
                if got is None:
                    bare[a:b] = np.maximum(bare[a:b], b)
                    continue
                here[a + got[1] : a + got[2]] = True
                if all(((where(key) >= a + got[1]) & (where(key) + len(key) <= a + got[2])).any() for key in self.keys_of[t]):
                    matches.append((got[0], t, a + got[1], a + got[2]))
        taken, out = np.zeros(len(text), bool), []
        spans = np.asarray([m.span() for m in _WORD.finditer(low)]) if matches else None
        for matched, t, a, b in sorted(matches, key=lambda x: (-x[0], -x[0] / self.n[x[1]], self.names[x[1]], x[2])):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((self.names[t], matched / int(self.n[t]), matched, b - a, int(spans[a, 0]), int(spans[b - 1, 1])))
        return sorted(out, key=lambda x: (x[4], x[0]))

    @staticmethod
    def _copies(template: np.ndarray, text: np.ndarray, starts: np.ndarray) -> list[int]:
        """Those of starts where the text has the template word for word."""
        starts = starts[(starts >= 0) & (starts + len(template) <= len(text))]
        for at in np.unique(np.linspace(0, len(template) - 1, min(8, len(template))).astype(np.int64)):
            starts = starts[text[starts + at] == template[at]]
        return [s for s in starts.tolist() if np.array_equal(text[s : s + len(template)], template)]


def _has(words: tuple[bytes, ...], phrase: list[bytes]) -> bool:
    return any(list(words[k : k + len(phrase)]) == phrase for k in range(len(words) - len(phrase) + 1))


MATCHES = "doc_id long, license string, coverage double, matched_words int, span_words int, span_start long, span_end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8) -> DataFrame:
    """One row for each match of a row of docs: of the given templates, or of all that license_texts has. span_start and span_end count code points of the text, the end not included."""
    given = license_texts.every(TEMPLATES) if templates is None else [(name, text, license_texts.KEYS.get(name, ())) for name, text in templates.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        names = [x.split()[0] for x in MATCHES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = (text or "").encode()
                found = scanner.scan(raw, min_coverage)
                if found:
                    points = np.cumsum(np.r_[0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80])  # code points before each byte
                    rows += [(doc_id, name, coverage, n, width, int(points[start]), int(points[end])) for name, coverage, n, width, start, end in found]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, MATCHES)
