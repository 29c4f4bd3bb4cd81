"""License scans by patience alignment of documents with license templates.

A finding is a place in a text where at least COVERAGE of a template's words stand in order, all of them within SPREAD template
lengths of one of its rare words; words of a template that are further apart make no notice.

Words that occur once in the text and once in the template are anchors; the longest run of anchors that ascends in both is
kept, and the gaps between them are aligned in the same way. Where a gap has no such word, equal words at its
edges are taken. Coverage is the share of the template's words that are aligned.

A template is aligned in the neighbourhood of its word that the text has least often, so that a notice that stands twice
still has anchors. Where copies stand so close that a neighbourhood holds several and less is aligned than the words allow, regions of about one
copy are aligned at every occurrence: between the neighbouring occurrences of the word, and as long as the template. Only a template whose words occur in the text in sufficient number is aligned: coverage cannot exceed
their share, so nothing is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexisift.llm.common import keyed, map_texts

#: Least share of a template's words that makes a finding, and how far these may lie from a rare one among them, in lengths of the template.
COVERAGE, SPREAD = 0.8, 6.0
#: Names and texts of public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0 header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0 header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT permission",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Bytes of words: ASCII letters in lower case; all ASCII but letters, digits and the point between digits is a gap.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() and c != 46 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    return [w for raw in text.encode("utf-8", "replace").translate(TABLE).split() if (w := raw.strip(b"."))]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that ascends in the second, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), ascending in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if once[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Templates, ready to be looked for."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float, spread: float = SPREAD):
        self.coverage, self.spread = coverage, spread
        self.templates = [(name, own, Counter(own)) for name, text in templates if (own := words_of(text))]

    def findings(self, words: list[bytes]) -> list[tuple[str, int, float, int, int]]:
        """(name, aligned words, coverage, first word, word after the last), best first: most words, then name."""
        out, present, places = [], set(words), None
        for name, template, counts in self.templates:
            need = self.coverage * len(template)
            if sum(n for w, n in counts.items() if w in present) < need:
                continue
            if places is None:
                places = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            most = sum(min(n, len(places.get(w, ()))) for w, n in counts.items())
            if most < need:
                continue
            best: tuple[int, int, int] | None = None
            # some of any so many different words must be in a finding
            spare = len(template) - int(np.ceil(need - 1e-9))
            rare = sorted((w for w in counts if w in places), key=lambda w: (len(places[w]), w))
            chosen, missing = [], sum(n for w, n in counts.items() if w not in places)
            for w in rare:
                chosen.append(w)
                missing += counts[w]
                if missing > spare:
                    break
            reach, end = int(self.spread * len(template)), -1
            for at in sorted(i for w in chosen for i in places[w]):
                if at < end:
                    continue
                begin = max(0, at - reach)
                end = at + reach
                region = words[begin : end + reach]
                pairs = align(region, template)
                if pairs and (best is None or len(pairs) > best[0]):
                    best = (len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1)
            if best is None or best[0] < most:
                best = self.single(words, template, counts, {w: places[w] for w in chosen}, spare, most, best)
            if best and best[0] >= need - 1e-9:
                out.append((name, best[0], best[0] / len(template), best[1], best[2]))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def single(self, words: list[bytes], template: list[bytes], counts: Counter, places: dict[bytes, list[int]], spare: int, most: int, best: tuple[int, int, int] | None) -> tuple[int, int, int] | None:
        """The best of best and the alignments of regions that hold about one copy; most: no alignment has more words."""
        reach = int(self.spread * len(template))
        done: set[tuple[int, int]] = set()
        for w, own in places.items():
            n = counts[w]
            inside = [j for j, x in enumerate(template) if x == w]
            for k, at in enumerate(own):
                last = own[min(k + n, len(own)) - 1]
                regions = [(max(at - reach, own[k - 1] + 1 if k else 0), min(last + reach, own[k + n] if k + n < len(own) else len(words)))]
                regions += [(max(0, at - j - more), at - j + len(template) + more) for j in inside for more in sorted({0, spare})]
                for begin, end in regions:
                    if (begin, end) in done:
                        continue
                    done.add((begin, end))
                    region = words[begin:end]
                    there = Counter(region)
                    bound = sum(min(c, there[x]) for x, c in counts.items())
                    if bound < len(template) - spare or (best and bound <= best[0]):
                        continue
                    pairs = align(region, template)
                    if pairs and (best is None or len(pairs) > best[0]):
                        best = (len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1)
                    if best and best[0] == most:
                        return best
        return best


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, license (that with most aligned words, then the first name; null if none), n_matched,
    coverage, first_word, end_word (places of words in the text), n_licenses, licenses (all names, best first).

    Words are runs of letters and digits, ASCII in lower case. Null, empty and wordless texts have no license.
    Null ids, repeated rows and rows that share an id each have a result; other columns are not read; an empty table gives an
    empty one. Whole texts are scanned, however long.
    """
    held: list[Scanner] = []
    given = TEMPLATES if templates is None else templates

    def step(ids: pa.Array, texts: list[str]) -> dict:
        if not held:
            held.append(Scanner(given, coverage, spread))
        found = [held[0].findings(words_of(x)) for x in texts]
        best = [f[0] if f else (None, 0, 0.0, None, None) for f in found]
        return {
            "doc_id": ids,
            "license": pa.array([b[0] for b in best], pa.string()),
            "n_matched": pa.array([b[1] for b in best], pa.int64()),
            "coverage": pa.array([b[2] for b in best], pa.float64()),
            "first_word": pa.array([b[3] for b in best], pa.int64()),
            "end_word": pa.array([b[4] for b in best], pa.int64()),
            "n_licenses": pa.array([len(f) for f in found], pa.int64()),
            "licenses": pa.array([", ".join(x[0] for x in f) for f in found], pa.string()),
        }

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, license string, n_matched bigint, coverage double, first_word bigint, end_word bigint, n_licenses bigint, licenses string")
