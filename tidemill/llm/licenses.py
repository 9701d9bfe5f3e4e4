"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table
from tidemill.llm.words import LOWER, hash_spans, raw_bytes, word_bounds

#: Share of a template's words that must align.
COVERAGE = 0.8
#: Aligned words lie within so many template lengths of text.
STRETCH = 2

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: ")
_BSD_2 = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the "
          "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
          "conditions and the following disclaimer in the documentation and/or other materials provided with the "
          "distribution. ")
_GNU = (("GPL", "General Public", "2.0", "2"), ("LGPL", "Lesser General Public", "2.1", "2.1"),
        ("LGPL", "Lesser General Public", "3.0", "3"), ("AGPL", "Affero General Public", "3.0", "3"))
_GNU_SHORT = "This work is licensed under the GNU {} License, version {}."
_GNU_LONG = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License "
             "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later "
             "version.")

#: Public notices: name, text and the phrases that tell a license from its kin, which must align word
#: by word. Pass others for more, with or without phrases.
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software.", "free of charge"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache License Version 2 0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2 0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License", "version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version.", "GNU General Public License", "version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "CC BY NC 4 0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     "Attribution 4 0"),
    # What both BSD licenses begin with says only that it is one of them.
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_2),
    ("BSD-3-Clause", _BSD + _BSD_2 + "Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written permission.",
     "Neither the name of", "endorse or promote"),
    *((f"{short}-{version}", _GNU_SHORT.format(name, number), f"GNU {name} License", f"version {number}")
      for short, name, version, number in _GNU),
    *((f"{short}-{version}", _GNU_LONG.format(name, number), f"GNU {name} License", f"version {number}")
      for short, name, version, number in _GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
     "Mozilla Public License v 2 0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
     "with or without fee", "appear in all copies"),
    *((f"CC-{kind.replace(' ', '-')}-4.0", f"Licensed under CC {kind} 4.0.", f"CC {kind} 4 0")
      for kind in ("BY", "BY SA", "BY ND", "BY NC SA", "BY NC ND")),
    *((f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons Attribution {name} 4.0 International License.",
       f"Attribution {name} 4 0")
      for kind, name in (("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC", "NonCommercial"),
                         ("BY-NC-SA", "NonCommercial ShareAlike"), ("BY-NC-ND", "NonCommercial NoDerivatives"))),
)

_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[[b for b in range(128) if not chr(b).isalnum()]] = 32
#: Words so common in prose that they don't speak for a license.
_COMMON = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "do", "for", "in", "is", "it", "of", "or", "so",
           "that", "the", "this", "to", "with", "you", "all", "can", "may", "not", "either", "use")


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each text's first word, word starts and ends in bytes, the bytes, each text's first byte.

    Words part at ASCII blanks and punctuation and compare after lower-casing A-Z.
    """
    raw, offsets = raw_bytes(texts)
    starts, ends = word_bounds(_SPLIT[raw], offsets)
    return hash_spans(LOWER[raw], starts, ends), np.searchsorted(starts, offsets), starts, ends, raw, offsets


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, x in enumerate(values):
        k = bisect_left(tops, x)
        back[i] = at[k - 1] if k else -1
        tops[k:k + 1] = [x]
        at[k:k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: (place in a, place in b) of the words that stand for each other.

    Words unique to both sides anchor; of the anchors a longest increasing
    subsequence holds, and the gaps between them align in the same way. A gap
    without anchors aligns at its equal ends.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        times_a, times_b = Counter(a[i:j]), Counter(b[k:m])
        where = {x: k + n for n, x in enumerate(b[k:m]) if times_b[x] == 1}
        anchors = [(n, where[a[n]]) for n in range(i, j) if times_a[a[n]] == 1 and a[n] in where]
        anchors = [anchors[x] for x in increasing([y for _, y in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Templates:
    def __init__(self, templates=TEMPLATES):
        def words_of(texts: list[str]) -> list[list[int]]:
            hashes, first = word_rows(pa.array(texts, pa.string()))[:2]
            return [hashes[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)]

        self.names = [t[0] for t in templates]
        self.words = words_of([t[1] for t in templates])
        # Where the phrases stand in the template: (first word, words).
        self.phrases = []
        for template, words in zip(templates, self.words, strict=True):
            own = words_of(list(template[2:]))
            self.phrases.append([(next(i for i in range(len(words)) if words[i:i + len(p)] == p), len(p)) for p in own])
        common = set(word_rows(pa.array([" ".join(_COMMON)]))[0].tolist())
        # A template of common words alone is looked for by all of them.
        own = [set(w) - common or set(w) for w in self.words]
        self.rare = [np.array(sorted(words), np.uint64) for words in own]
        self.all_rare = np.unique(np.concatenate(self.rare)) if self.rare else np.zeros(0, np.uint64)
        # Of the words that must align, so many are among these.
        self.least = [max(1, math.ceil(COVERAGE * len(w) - 1e-9) - sum(x not in words for x in w))
                      for w, words in zip(self.words, own, strict=True)]

    def find(self, words: np.ndarray, rare_places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, aligned words) of every notice in a text."""
        found = []
        for t, template in enumerate(self.words):
            places = rare_places[np.isin(words[rare_places], self.rare[t])]
            need, reach = self.least[t], STRETCH * len(template)
            if len(places) < need:
                continue
            close = np.flatnonzero(places[need - 1:] - places[:len(places) - need + 1] < reach)
            after = -1
            for start in places[close]:
                if start <= after:
                    continue
                low, high = max(after + 1, int(start) - len(template)), int(start) + reach
                # A copy that stands here word by word, beside other copies or not, and else whatever aligns.
                at = max(low, int(start) - template.index(int(words[start])))
                notice = self._aligned(t, words, at, at + len(template)) or self._aligned(t, words, low, high)
                while notice:
                    found.append(notice)
                    after = max(after, notice[2])
                    # What stands before it may be another copy.
                    notice = self._aligned(t, words, low, notice[1])
        # Of notices that overlap, the one with more aligned words says what it is.
        kept: list[tuple[int, int, int, int]] = []
        for notice in sorted(found, key=lambda n: (-n[3], n[1], n[0])):
            if all(notice[2] < k[1] or k[2] < notice[1] for k in kept):
                kept.append(notice)
        return sorted(kept, key=lambda n: n[1])


    def _aligned(self, t: int, words: np.ndarray, begin: int, end: int) -> tuple[int, int, int, int] | None:
        """The notice in a stretch of words: enough words align, and every phrase word by word."""
        template = self.words[t]
        if end - begin < COVERAGE * len(template):
            return None
        pairs = align(template, words[begin:end].tolist())
        if not pairs or len(pairs) < COVERAGE * len(template):
            return None
        at = dict(pairs)
        for first, size in self.phrases[t]:
            if first not in at or any(at.get(first + k) != at[first] + k for k in range(size)):
                return None
        return t, begin + pairs[0][1], begin + pairs[-1][1], len(pairs)


SCHEMA = "doc_id long, license string, start long, end long, aligned long, coverage double"


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, aligned, coverage): every license notice of every text.

    A notice is a stretch of text in which COVERAGE of a template's words align
    (``align``), its distinguishing phrases word by word, within STRETCH template lengths; places are code points, ends
    exclusive. Of overlapping notices the one with more aligned words is
    reported, of equal ones the first. Whole texts are searched; a text is
    aligned only around places with as many of a template's own words, close
    together, as the coverage demands. Null and empty texts hold no notice;
    repeated rows are reported each; other columns are ignored.
    """
    prepared(docs.sparkSession)
    known = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first, starts, ends, raw, offsets = word_rows(batch.column("text"))
            rare = np.flatnonzero(np.isin(words, known.all_rare))
            edges = np.searchsorted(rare, first)
            out = []
            for text in np.flatnonzero(np.diff(edges)):
                i, j = first[text], first[text + 1]
                places = rare[edges[text]:edges[text + 1]] - i
                for t, a, b, aligned in known.find(words[i:j], places):
                    low, high = int(starts[i + a]), int(ends[i + b])
                    start = len(raw[offsets[text]:low].tobytes().decode())
                    out.append((int(text), known.names[t], start, start + len(raw[low:high].tobytes().decode()), aligned,
                                aligned / len(known.words[t])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                 *[pa.array(c, pa.int64()) for c in columns[2:5]], pa.array(columns[5], pa.float64())],
                ["doc_id", "license", "start", "end", "aligned", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
