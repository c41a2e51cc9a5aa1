"""Licence scans by patience alignment.

Words that are unique both in a passage and in a licence text anchor the alignment; the longest increasing subsequence of
the anchors stays, and the gaps between them are aligned in the same way; a gap without anchors, of any size, by a longest
common subsequence. The part of the licence's words that is matched is its coverage.

Where that finds no verbatim notice around a keyword (repeated notices leave no unique words), all passages that can hold
the keyword are compared with the notice by longest common subsequences, in bit-parallel rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, table

#: Least coverage, and least matched words for each word of the passage between the first and the last match.
COVERAGE, DENSITY = 0.8, 0.6
#: Words around the licence's length that are aligned first on both sides of a keyword.
SLACK = 20
#: What a word of a passage costs in matched words when its bounds are chosen: an end is moved for one more match over up to 3 others.
WORD_COST = 0.25

# Notices of public licences, and the words of each that must be among the matched ones.
NOTICES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2"),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache compliance",
    ),
    "mit": ("Released under the MIT License.", "mit"),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "permission sublicense",
    ),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    "lgpl-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE.",
        "gnu redistribute",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "cc nc 4"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "cc sa 4"),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "redistribution redistributions",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        "permission fee",
    ),
}

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of bytes from 0x80 on."""
    return text.translate(_PLAIN).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers rise."""
    ends, at, before = [], [], []
    for k, (_, b) in enumerate(pairs):
        place = bisect_left(ends, b)
        if place == len(ends):
            ends.append(b), at.append(k)
        else:
            ends[place], at[place] = b, k
        before.append(at[place - 1] if place else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _masks(b: list[bytes]) -> dict[bytes, int]:
    """The places of each word, as bits."""
    out: dict[bytes, int] = {}
    for j, w in enumerate(b):
        out[w] = out.get(w, 0) | 1 << j
    return out


def _common(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """A longest common subsequence; one row of bits for each word of a."""
    masks, full = _masks(b[::-1]), (1 << len(b)) - 1
    rows, row = [full] * (len(a) + 1), full  # row i: bit k is 0 where the last k + 1 words of b have one match more in a[i:] than the last k
    for i in range(len(a) - 1, -1, -1):
        hit = row & masks.get(a[i], 0)
        rows[i] = row = (row + hit | row - hit) & full
    best = lambda i, j: len(b) - j - (rows[i] & (1 << len(b) - j) - 1).bit_count()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two word lists, rising in both."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n, m = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if m[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if n[w] == 1 and w in place])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
        else:
            out += [(i + a0, j + b0) for i, j in _common(a[a0:a1], b[b0:b1])]
    return sorted(out)


def _best_end(words: Iterable[bytes], masks: dict[bytes, int], size: int, coverage: float, density: float) -> tuple[float, int] | None:
    """Score and length of the best beginning of `words` that reaches the limits for a notice of `size` words, the shortest of equals."""
    row = full = (1 << size) - 1
    best, matched = None, 0
    for n, w in enumerate(words, 1):
        if not (mask := masks.get(w)):
            continue
        hit = row & mask
        row = (row + hit | row - hit) & full
        if (now := size - row.bit_count()) > matched:
            matched = now
            if matched >= coverage * size and matched >= density * n and (best is None or matched - WORD_COST * n > best[0]):
                best = (matched - WORD_COST * n, n)
    return best


class Scanner:
    def __init__(self, notices: dict[str, tuple[str, str]] = NOTICES):
        self.notices = []
        for name, (text, must) in notices.items():
            notice = words_of(text.encode())
            self.notices.append((name, notice, Counter(notice), [w.encode() for w in must.split()], _masks(notice), _masks(notice[::-1])))
        self.any = {must[0] for _, _, _, must, _, _ in self.notices}

    def scan(self, text: bytes, coverage: float = COVERAGE, density: float = DENSITY) -> list[tuple[str, float, int, int, int]]:
        """License, coverage, first word, past the last word, and number of passages; for each licence found, its best passage."""
        words = words_of(text)
        if self.any.isdisjoint(words):
            return []
        has, out = set(words), []
        for name, notice, number, must, masks, back in self.notices:
            if not has.issuperset(must):
                continue
            found, begin, tried = [], 0, 0
            for p in [i for i, w in enumerate(words) if w == must[0]]:
                if p < begin:
                    continue
                low = max(begin, p - len(notice) - SLACK)
                pairs = _dense(align(words[low : p + len(notice) + SLACK], notice), len(notice))
                if len(pairs) == len(notice) and pairs[-1][0] - pairs[0][0] < len(notice) and 0 <= p - low - pairs[0][0] < len(notice):
                    first, last = low + pairs[0][0], low + pairs[-1][0] + 1
                elif bounds := self._around(words, p, begin, tried, notice, number, must, masks, back, coverage, density):
                    first, last, pairs = bounds
                else:
                    tried = p + 1
                    continue
                found.append((len(pairs) / len(notice), -first, last))
                begin = last
            if found:
                best = max(found)
                out.append((name, best[0], -best[1], best[2], len(found)))
        return out

    @staticmethod
    def _around(words, p, begin, tried, notice, number, must, masks, back, coverage, density):
        """First word, past the last word and matched places of the first passage with word p, from `begin` on, that reaches the limits.

        Starts before `tried` are known to give none.
        """
        size = len(notice)
        span = int(size / density + 1e-9)  # beyond it even a whole match is too thin
        base = max(begin, p - span + 1)
        area = words[base : p + span]
        if sum((Counter(area) & number).values()) < coverage * size:  # too few of the notice's words in any order
            return None
        known = list(accumulate((w in masks for w in area), initial=0))
        where = [[i for i, w in enumerate(area) if w == m] for m in must[1:]]
        for start in range(max(0, tried - base), p - base + 1):
            stop = min(start + span, len(area))
            if area[start] not in masks or known[stop] - known[start] < coverage * size:
                continue
            if any((k := bisect_left(own, start)) == len(own) or own[k] >= stop for own in where):
                continue
            if not (best := _best_end(area[start:stop], masks, size, coverage, density)):
                continue
            first, last = start, start + best[1]
            while True:  # each step moves one bound to where the score is higher
                score, n = _best_end(reversed(area[max(0, last - span) : last]), back, size, coverage, density)
                if score <= best[0]:
                    break
                first, best = last - n, (score, n)
                score, n = _best_end(area[first : first + span], masks, size, coverage, density)
                if score <= best[0]:
                    break
                last, best = first + n, (score, n)
            if first <= p - base < last:
                pairs = align(area[first:last], notice)
                if len(pairs) < len(longest := _common(area[first:last], notice)):
                    pairs = longest
                if {area[first + i] for i, _ in pairs}.issuperset(must):
                    return base + first, base + last, pairs
        return None


def _dense(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The pairs whose places lie together: a stretch of at most twice the notice's length with the most of them, the earliest such."""
    best, begin = (0, 0, 0), 0
    for end in range(len(pairs)):
        while pairs[end][0] - pairs[begin][0] >= 2 * size:
            begin += 1
        if end + 1 - begin > best[0]:
            best = (end + 1 - begin, begin, end + 1)
    return pairs[best[1] : best[2]]


SCHEMA = "doc_id long, license string, coverage double, first_word long, end_word long, passages long"


def _scan(notices):
    def scan(batches):
        scanner = Scanner(notices)
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                rows += [(doc, *found) for found in scanner.scan(text or b"")]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "first_word", "end_word", "passages"])

    return scan


def license_scan(docs: DataFrame, notices: dict[str, tuple[str, str]] = NOTICES) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...) and notice whose coverage in one passage reaches the limits.

    first_word and end_word bound the best passage (the earliest of equals) in words_of(text); passages is how many there are.
    Null and empty texts hold no notice. A long text is held by its task as a list of words, and time grows with its length.
    Rows are judged one by one, so repeated rows agree; a null doc_id stays null. Other columns are ignored. Coverage is that
    of the notice, as NOTICES has it, not of the licence that it names.
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan(notices), SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence notices in every whole text of documents; nulls, empty and long texts and repeated rows as in license_scan()."""
    return license_scan(table(spark, sf_dir, "documents"))
