"""Licence notices: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into runs of K words, hashed, and winnowed: of every WINDOW
consecutive runs the least hash stays. Templates of up to WINDOW + K - 1 words
keep all their runs, and all pairs of words, so that one changed word hides
none. These fingerprints are an inverted index from hash to (template,
position), as large as the template list, which is bounded. A text looks up all
its runs and pairs, so any text that holds a template, or WINDOW + K - 1 of its
words in a row, hits the index. A local alignment of the template with the text
in a band around a hit's diagonal gives the matched words and the span; the
text on either side is aligned again until no hit is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, mix, slices

K, WINDOW, BAND = 3, 4, 8
#: Words of the runs that short templates are indexed by besides.
PAIR = 2
#: Least share of a template's words that a match has, and least words.
COVERAGE, LEAST_WORDS = 0.75, 3
#: Most words over all templates: the index goes to every task.
MOST_TEMPLATE_WORDS = 200_000

#: Public notices by SPDX name; several for one licence are numbered.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Proprietary": "All rights reserved.",
}

_EDGES = np.zeros(256, bool)
_EDGES[[b for b in range(128) if not chr(b).isalnum()]] = True
_ODD = np.random.default_rng(11).integers(1, 2**62, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Normal:
    """A batch's words without punctuation at their ends; words of nothing else are left out."""

    def __init__(self, texts: pa.Array) -> None:
        words = Words(texts)
        mark = np.concatenate([[0], np.cumsum(~_EDGES[words.data])])
        real = mark[words.end] > mark[words.start]
        start, end = words.start[real].copy(), words.end[real].copy()
        while len(start) and (cut := _EDGES[words.data[start]]).any():
            start += cut
        while len(end) and (cut := _EDGES[words.data[end - 1]]).any():
            end -= cut
        self.start, self.end, self.hash = start, end, words.hashes(start, end)
        self.first = np.searchsorted(start, words.at)
        self.data, self.at = words.data, words.at

    def runs(self, many: int = K) -> np.ndarray:
        """A hash for the `many` words from each position; the last many - 1 of a text run into the next one."""
        n = len(self.hash) - many + 1
        return mix(sum((self.hash[k : n + k] * _ODD[k] for k in range(many)), start=np.uint64(0))) if n > 0 else np.zeros(0, np.uint64)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash, the rightmost of equals, of every `window` consecutive ones (of all, if there are fewer)."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class Index:
    """Fingerprints, sorted, with the template and position of each; templates as word hashes."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        words = Normal(pa.array([templates[n] for n in self.names], pa.string()))
        if len(words.hash) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates have {len(words.hash)} words; {MOST_TEMPLATE_WORDS} are allowed")
        self.words = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(self.names))]
        runs, pairs, rows = words.runs(), words.runs(PAIR), []
        for i, own in enumerate(self.words):
            if len(own) < K:
                raise ValueError(f"template {self.names[i]} has under {K} words")
            low = words.first[i]
            short = len(own) <= WINDOW + K - 1
            rows += [(int(runs[low + p]), i, int(p)) for p in (range(len(own) - K + 1) if short else winnow(runs[low : low + len(own) - K + 1]))]
            if short and len(own) > LEAST_WORDS:
                rows += [(int(pairs[low + p]), i, p) for p in range(len(own) - PAIR + 1)]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[k] for r in rows]) for k in (1, 2))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words and the text's span [start, end) of the best local alignment near a diagonal (text place less template place)."""
    best = (0, 0, 0, 0)  # score, matched words, span
    width = 2 * band + 1
    before = [(0, 0, -1)] * (width + 2)  # score, matched words, where it began; cells are by offset from the diagonal
    for i, word in enumerate(template.tolist()):
        now = [(0, 0, -1)] * (width + 2)
        for o in range(1, width + 1):
            j = i + diagonal + o - 1 - band
            if not 0 <= j < len(text):
                continue
            score, matched, began = before[o]
            if text[j] == word:
                take = (score + 2, matched + 1, began if began >= 0 else j)
            else:
                take = (score - 1, matched, began)
            cell = max(take, (before[o + 1][0] - 1, *before[o + 1][1:]), (now[o - 1][0] - 1, *now[o - 1][1:]))
            now[o] = cell if cell[0] > 0 else (0, 0, -1)
            if now[o][:2] > best[:2]:
                best = (*now[o], j + 1)
        before = now
    return best[1:]


def occurrences(template: np.ndarray, text: np.ndarray, places: np.ndarray, diagonals: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(matched, start, end) of all matches of a template near its hits; none overlaps another."""
    order = np.argsort(diagonals, kind="stable")
    todo = [(0, len(text), places[order], diagonals[order])]
    while todo:
        low, high, at, near = todo.pop()
        matched, start, end = align(template, text[low:high], int(near[0]) - low)
        if matched >= max(LEAST_WORDS, COVERAGE * len(template)):
            yield matched, low + start, low + end
            parts = [(low, low + start, np.ones(len(at), bool)), (low + end, high, np.ones(len(at), bool))]
        else:
            parts = [(low, high, near != near[0])]
        for a, b, left in parts:
            left &= (at < b) & (at + K > a)
            if left.any() and b - a >= LEAST_WORDS:
                todo.append((a, b, at[left], near[left]))


def matches(words: Normal, index: Index, i: int, hits: np.ndarray, entry: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched, start, end in the text's words) of text i, the better of overlapping ones only."""
    text = words.hash[words.first[i] : words.first[i + 1]]
    found = []
    template, place = index.template[entry], hits - words.first[i]
    diagonal = place - index.place[entry]
    for name in np.unique(template).tolist():
        own, mine = index.words[name], template == name
        found += [(m >= len(own), m, m / len(own), name, start, end) for m, start, end in occurrences(own, text, place[mine], diagonal[mine])]
    kept: list[tuple[int, int, int, int]] = []
    for _, matched, _, name, start, end in sorted(found, key=lambda f: (-f[0], -f[1], -f[2], f[3], f[4])):
        if all(end <= a or start >= b for _, _, a, b in kept):
            kept.append((name, matched, start, end))
    return sorted(kept, key=lambda f: f[2])


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and matches, an array of (license, matched_words, coverage, start, end).

    start and end are code points, end exclusive, of the matched words without
    the punctuation around them; matches do not overlap and are in order. Texts
    without a match, null and empty ones have an empty array. Rows that repeat
    are returned each; no rows give no rows; other columns are not read.
    """
    index = Index(templates)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("license", pa.string()), ("matched_words", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Normal(batch.column(1))
                hits, entries = [], []
                for many in (K, PAIR):
                    runs = words.runs(many)
                    low, high = np.searchsorted(index.hash, runs), np.searchsorted(index.hash, runs, "right")
                    hit = np.flatnonzero(high > low)
                    hit = hit[hit + many <= words.first[np.searchsorted(words.first, hit, "right")]]
                    each = high[hit] - low[hit]
                    hits.append(np.repeat(hit, each))
                    entries.append(np.repeat(low[hit] - np.cumsum(each) + each, each) + np.arange(each.sum()))
                hit, entry = np.concatenate(hits), np.concatenate(entries)
                owner = np.searchsorted(words.first, hit, "right") - 1
                order = np.argsort(owner, kind="stable")
                hit, entry, owner = hit[order], entry[order], owner[order]
                out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                some, begin, many = np.unique(owner, return_index=True, return_counts=True)
                for i, x, y in zip(some.tolist(), begin.tolist(), (begin + many).tolist(), strict=True):
                    found = matches(words, index, i, hit[x:y], entry[x:y])
                    if not found:
                        continue
                    a, b = int(words.at[i]), int(words.at[i + 1])
                    chars = np.concatenate([[0], np.cumsum(words.data[a:b] & 0xC0 != 0x80)])
                    for name, matched, start, end in found:
                        x, y = words.start[words.first[i] + start] - a, words.end[words.first[i] + end - 1] - a
                        out[i].append({"license": index.names[name], "matched_words": matched, "coverage": matched / len(index.words[name]), "start": int(chars[x]), "end": int(chars[y])})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=["id", "matches"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(scan, f"id {kind}, matches array<struct<license:string,matched_words:int,coverage:double,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def summary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of matches, the one with most matched words, its coverage, and all as text."""
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["matched_words"].alias("n"), m["coverage"].alias("coverage"), m["license"].alias("license"))))
    text = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["matched_words"].cast("string"))), ",")
    return rows.select(id_col, F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), best["coverage"].alias("coverage"), text.alias("matches"))
