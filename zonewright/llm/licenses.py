"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut into lower-cased words; of every few neighbouring hashes of a
few words the least is a fingerprint. Length and window follow from the template
(``gram_and_window``), so that each stretch of a document within a fifth of its
words in edits shares a fingerprint. An inverted index leads from
fingerprint to (template, place). A document's grams found there vote for a
template and a diagonal; each group of votes is a candidate, which a banded
alignment of the whole template against that stretch of the document verifies.
Reported are the matched share of the template and the span in the document.

Templates are a parameter, as ``read_templates`` gives them from a folder of
whole texts; the list here holds common short notices and the openings of long
ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import text_of

GRAM = 3
COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+")

TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software"
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL terms": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"
    ),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense opening": "This is free and unencumbered software released into the public domain.",
    "zlib opening": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software."
    ),
    "BSL-1.0 grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license"
    ),
    "LGPL-2.1 terms": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation"
    ),
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}


def read_templates(spark: SparkSession, folder: str, limit: int = 64 << 20) -> dict[str, str]:
    """Whole template texts by file name (without its extension), one file each.

    They travel to every task, so more than ``limit`` bytes raise an error.
    """
    files = spark.read.format("binaryFile").load(folder)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > limit:
        raise ValueError(f"{size} bytes of templates, more than {limit}")
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), F.decode("content", "UTF-8").alias("text")).collect()
    if len({r["name"] for r in rows}) < len(rows):
        raise ValueError("two templates have one name")
    return {r["name"]: r["text"] for r in rows}


def gram_and_window(m: int, coverage: float = COVERAGE) -> tuple[int, int]:
    """Length and window of the fingerprints of a template of m words.

    E = (1 - coverage) m edits (words changed, left out or put in) leave m - E
    words in at most E + 1 runs, so one run has (m - E) / (E + 1) words or more;
    a window over the grams of such a run holds a fingerprint.
    """
    edits = int((1 - coverage) * m + 1e-9)
    run = -(-(m - edits) // (edits + 1))
    gram = max(1, min(GRAM, run))
    return gram, max(1, run - gram + 1)


def winnow(hashes: list[int], window: int) -> set[int]:
    """Places of the least hash of each window, the rightmost of equals."""
    if not hashes:
        return set()
    width = min(window, len(hashes))
    return {min(range(i, i + width), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - width + 1)}


class Index:
    """Postings per gram length: templates of few words have shorter grams."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> None:
        texts = TEMPLATES if templates is None else templates
        words = {n: WORDS.findall(t.lower()) for n, t in texts.items()}
        self.names = sorted(n for n, w in words.items() if w)
        self.coverage = coverage
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for n in self.names for w in words[n]}))}
        self.codes = [[self.ids[w] for w in words[n]] for n in self.names]
        self.base = len(self.ids) + 1
        postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, codes in enumerate(self.codes):
            gram, window = gram_and_window(len(codes), coverage)
            grams = [tuple(codes[i : i + gram]) for i in range(len(codes) - gram + 1)]
            hashes = [xxhash.xxh64_intdigest(",".join(map(str, g))) for g in grams]
            for at in winnow(hashes, window):
                postings[gram][sum(c * self.base**j for j, c in enumerate(grams[at]))].append((t, at))
        self.postings = {gram: dict(found) for gram, found in postings.items()}
        self.keys = {gram: np.array(sorted(found), np.int64) for gram, found in postings.items()}

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, template, place in the template) of every indexed gram."""
        for gram, keys in self.keys.items():
            n = len(codes) - gram + 1
            if n <= 0:
                continue
            full = np.ones(n, bool)
            key = np.zeros(n, np.int64)
            for j in range(gram):
                part = codes[j : j + n]
                full &= part > 0
                key += part * self.base**j
            at = np.flatnonzero(full)
            for i in at[np.isin(key[at], keys)].tolist():
                for t, place in self.postings[gram][int(key[i])]:
                    yield i, t, place

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each match, by place."""
        words = WORDS.findall(text.lower())
        get = self.ids.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        votes: dict[int, list[int]] = defaultdict(list)
        for i, t, place in self.hits(codes):
            votes[t].append(i - place)
        out, spans = [], None
        for t, diagonals in votes.items():
            template = self.codes[t]
            # Templates too short for an edit match word for word, so copies side by side stay apart.
            band = max(3, len(template) // 5) if int((1 - self.coverage) * len(template) + 1e-9) else 0
            diagonals.sort()
            groups = [[diagonals[0], diagonals[0]]]
            for d in diagonals[1:]:
                if d - groups[-1][1] <= band and d - groups[-1][0] <= 2 * band:
                    groups[-1][1] = d
                else:
                    groups.append([d, d])
            taken: list[tuple[int, int]] = []
            for low, high in groups:
                a = max(0, low - band)
                b = min(len(codes), high + len(template) + band)
                found = align(template, codes[a:b].tolist(), low - a - band, high - a + band)
                if found is None or found[0] < self.coverage * len(template):
                    continue
                start, end = a + found[1], a + found[2]
                if any(start < y and x < end for x, y in taken):
                    continue
                taken.append((start, end))
                if spans is None:
                    # word spans in the original text; lower-casing may change lengths, words do not change order
                    spans = [m.span() for m in WORDS.finditer(text)]
                    if len(spans) != len(words):
                        spans = [m.span() for m in WORDS.finditer(text.lower())]
                out.append((self.names[t], found[0] / len(template), found[0], spans[start][0], spans[end - 1][1]))
        return sorted(out, key=lambda r: (r[3], r[4], r[0]))


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """Best alignment of the template within text, on diagonals low..high.

    Match 2, mismatch and gap -1; both ends of the text are free, and so are
    unmatched ends of the template. Returns (matched words, start, end).
    """
    m, n = len(template), len(text)
    below = -(10**9)
    # per cell: (score, matches, first matched place in text, end of last match)
    before: dict[int, tuple[int, int, int, int]] = {}
    best = (0, 0, 0, 0)
    for i in range(m):
        now: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + low), min(n - 1, i + high) + 1):
            s, c, a, b = before.get(j - 1, (0, 0, -1, -1))
            if s < 0:
                s, c, a, b = 0, 0, -1, -1
            if template[i] == text[j] and text[j] > 0:
                cell = (s + 2, c + 1, j if a < 0 else a, j + 1)
            else:
                cell = (s - 1, c, a, b)
            up, left = before.get(j), now.get(j - 1)
            if up and up[0] - 1 > cell[0]:
                cell = (up[0] - 1, *up[1:])
            if left and left[0] - 1 > cell[0]:
                cell = (left[0] - 1, *left[1:])
            now[j] = cell if cell[0] > below else (0, 0, -1, -1)
            if (cell[0], cell[1]) > (best[0], best[1]):
                best = cell
        before = now
    return (best[1], best[2], best[3]) if best[1] else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, license, coverage, matched, start, end): one row per match.

    ``start`` and ``end`` are code points in the text. Whole texts are scanned;
    null and empty texts and empty tables have no match, repeated rows match
    alike, other columns do not matter, and templates without a word never match.
    An id column named like an output column raises an error.
    """
    index = Index(templates, coverage)
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)[id_col]
    names = [id_col, "license", "coverage", "matched", "start", "end"]
    if id_col in names[1:]:
        raise ValueError(f"rename the id column {id_col!r}: an output column has its name")

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            take, rows = [], []
            for i, t in enumerate(part.column(1)):
                found = index.scan(t.as_py())
                rows += found
                take += [i] * len(found)
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, pa.int64())), *columns], names=names)

    return rows.mapInArrow(step, f"`{id_col}` {kind}, license string, coverage double, matched long, start long, end long")
