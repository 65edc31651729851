"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' words are cut into grams of three, and of every window of two grams the one with the
smallest hash is kept (winnowing), so any four words in common share a kept gram. An inverted index
from gram to (template, place) is broadcast; its size follows from the templates, which are checked.
A document's kept grams name templates and diagonals; along each diagonal a banded local alignment
of words reports how much of the template is there, and where.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from wirelark.llm import texts

GRAM = 3
WINNOW = 2
BAND = 6                           # words that a copy may gain or lose along the way
COVERAGE = 0.8                     # of a template's words that must be matched
MOST_TEMPLATE_WORDS = 2_000_000    # of all templates together; more is an error
_MATCH, _MISMATCH, _GAP = 2, -1, -1

#: Notices and openings of widespread licenses, as they are printed in files.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."),
    "mit-notice": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]        # hashes of each template's words
    grams: np.ndarray              # kept grams, rising
    template: np.ndarray           # of each kept gram
    place: np.ndarray              # of each kept gram in its template


def _grams(hashes: np.ndarray) -> np.ndarray:
    """A hash of each GRAM words in a row."""
    n = max(0, len(hashes) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = texts.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return out


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places kept: of each WINNOW grams in a row the smallest, the last of equal ones."""
    if len(grams) <= WINNOW:
        return np.flatnonzero(grams == grams.min())[-1:] if len(grams) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)[:, ::-1]
    return np.unique(np.arange(len(view)) + WINNOW - 1 - view.argmin(1))


def build(templates: dict[str, str] | None = None) -> Index:
    """Templates shorter than GRAM words cannot be found and are refused."""
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    data, offsets = texts.column_bytes(pa.array([templates[n] for n in names], pa.string()))
    data = texts.LOWER[data]
    starts, ends, first = texts.words(data, offsets, texts.ALNUM)
    hashes = texts.word_hashes(data, starts, ends)
    words = [hashes[first[i]:first[i + 1]] for i in range(len(names))]
    if any(len(w) < GRAM for w in words) or len(hashes) > MOST_TEMPLATE_WORDS:
        raise ValueError("templates need at least three words each, and together no more than MOST_TEMPLATE_WORDS")
    kept = [(int(g[p]), i, int(p)) for i, w in enumerate(words) for g in [_grams(w)] for p in winnow(g)]
    kept.sort()
    return Index(names, words, np.array([k[0] for k in kept], np.uint64), np.array([k[1] for k in kept], np.int64), np.array([k[2] for k in kept], np.int64))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched template words, begin, end): the best local alignment of the template with the
    document's words that stays within `band` of the diagonal; the words begin:end take part."""
    width = 2 * band + 1
    best, span, top = (0, 0), (0, 0, 0), [(0, 0, 0)] * (width + 2)
    for i in range(len(template)):
        row = [(0, 0, 0)] * (width + 2)
        for b in range(width):
            j = i + diagonal + b - band
            if not 0 <= j < len(words):
                continue
            same = template[i] == words[j]
            s, m, begin = top[b + 1]                               # diagonal step
            s, m, begin = (s, m, begin) if s else (0, 0, j)
            here = (s + _MATCH, m + 1, begin) if same else (s + _MISMATCH, m, begin)
            for other in (top[b + 2], row[b]):                     # a template word or a document word left out
                if other[0] + _GAP > here[0]:
                    here = (other[0] + _GAP, other[1], other[2])
            if here[0] <= 0:
                continue
            row[b + 1] = here
            if (here[0], -abs(b - band)) > best:                   # of equal ones that nearest to the diagonal
                best, span = (here[0], -abs(b - band)), (here[1], here[2], j + 1)
        top = row
    return span


def scan(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
    """For each document its (template, coverage, begin, end), in bytes, by place; of findings
    that overlap, the one with more matched words stays."""
    low = texts.LOWER[data]
    starts, ends, first = texts.words(low, offsets, texts.ALNUM)
    hashes = texts.word_hashes(low, starts, ends)
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    grams = _grams(hashes)
    if not len(grams) or not len(index.grams):
        return out
    owner = np.repeat(np.arange(len(out)), np.diff(first))
    at = winnow(grams)
    # winnowing looks across the border of two documents, so there every gram is kept
    edges = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hashes))]
    near = (edges[:, None] + np.arange(-GRAM - WINNOW, WINNOW)).ravel()
    at = np.unique(np.concatenate([at, near[(near >= 0) & (near < len(grams))]]))
    at = at[owner[at] == owner[at + GRAM - 1]]
    lo, hi = np.searchsorted(index.grams, grams[at], "left"), np.searchsorted(index.grams, grams[at], "right")
    n = hi - lo
    place = np.repeat(at, n)
    hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(hit):
        return out
    doc, template = owner[place], index.template[hit]
    diagonal = place - first[doc] - index.place[hit]
    # one candidate for each bundle of diagonals within half a band of each other
    order = np.lexsort((diagonal, template, doc))
    doc, template, diagonal = doc[order], template[order], diagonal[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND // 2)])
    bounds = np.append(np.flatnonzero(fresh), len(doc))
    found: dict[int, list] = {}
    for b, e in zip(bounds[:-1], bounds[1:]):
        d, t = int(doc[b]), int(template[b])
        words = hashes[first[d]:first[d + 1]]
        size, done = len(index.words[t]), None
        for k in range(b, e):                                      # a wide bundle is aligned at more than one place
            if done is None or diagonal[k] - done > BAND // 2:
                done = int(diagonal[k])
                low_word = max(0, done - BAND)
                m, begin, end = align(index.words[t], words[low_word:done + size + BAND + 1], done - low_word)
                if m >= COVERAGE * size:
                    found.setdefault(d, []).append((m, t, begin + low_word, end + low_word))
    for d, rows in found.items():
        taken: list[tuple] = []
        for m, t, begin, end in sorted(set(rows), key=lambda r: (-r[0], r[2], r[1])):
            if all(end <= x[2] or begin >= x[3] for x in taken):
                taken.append((m, t, begin, end))
        for m, t, begin, end in sorted(taken, key=lambda r: r[2]):
            out[d].append((index.names[t], m / len(index.words[t]), int(starts[first[d] + begin] - offsets[d]), int(ends[first[d] + end - 1] - offsets[d])))
    return out


FINDING = StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("begin", LongType()), StructField("end", LongType())])
NEW = [StructField("findings", ArrayType(FINDING))]
_FINDINGS = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))


def find_licenses(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Adds `findings` (license, coverage, begin and end in bytes of the text) to every row; a column
    of this name is replaced. Null and empty texts have none."""
    kept = [f for f in docs.schema.fields if f.name != "findings"]
    broadcast = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in texts.blocks(batch, text):
                found = [[dict(zip(("license", "coverage", "begin", "end"), f)) for f in fs] for fs in scan(broadcast.value, data, offsets)]
                yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + [pa.array(found, _FINDINGS)], [f.name for f in kept] + ["findings"])
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType(kept + NEW))
