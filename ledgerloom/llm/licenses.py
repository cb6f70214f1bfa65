"""Licence scan: normalised text against licence notices, by the Dice coefficient over word bigrams.

A text is compared whole, and so is each of its lines. For notices over several lines or inside a paragraph, and
licence files inside longer texts, a window of each template's number of words slides over the words of the text.
Only templates whose number of bigrams can give the wanted coefficient with that of the piece are compared: with sizes
a and b it is 2 min(a, b) / (a + b) at most. So at least t m / (2 - t) bigrams of a template of m must be in a piece,
and windows are scored only where so many lie close enough.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.llm.common import alnum_words, documents, sub_batches

THRESHOLD = 0.8
#: Coefficients at the threshold match, whichever way it is rounded.
EPSILON = 1e-9

# Short licence notices in use, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole licences, by the names of their files.
BODIES = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(resources.files("ledgerloom.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class TemplateSet:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.words = _Words()
        listed = [alnum_words(t.encode()) for _, t in templates]
        for ws in listed:
            for w in ws:
                self.words.setdefault(w, len(self.words) + 1)
        self.grams = [{self.code(a, b) for a, b in zip(x, x[1:])} for x in ([self.words[w] for w in ws] for ws in listed)]
        self.by_gram: dict[int, list[int]] = {}
        for k, g in enumerate(self.grams):
            for c in g:
                self.by_gram.setdefault(c, []).append(k)
        self.table = np.zeros((len(self.words) + 1) ** 2, bool)
        self.table[list(self.by_gram)] = True
        self.sizes = list(map(len, listed))
        self.codes = np.array(sorted(self.by_gram), np.int64)
        self.member = np.array([np.isin(self.codes, list(g)) for g in self.grams]).reshape(len(listed), len(self.codes))

    def code(self, a: int, b: int) -> int:
        return a * (len(self.words) + 1) + b

    def best(self, words: list[bytes]) -> tuple[float, int] | None:
        """(coefficient, template) of the best template at or over the threshold; ties: the first template."""
        own = set(zip(words, words[1:]))
        if not own:
            return None
        t = self.threshold
        shared: dict[int, int] = {}
        for a, b in own:
            for k in self.by_gram.get(self.code(self.words[a], self.words[b]), ()):
                n, m = len(own), len(self.grams[k])
                if 2 * min(n, m) >= t * (n + m) - EPSILON:
                    shared[k] = shared.get(k, 0) + 1
        found = [(2 * n / (len(own) + len(self.grams[k])), -k) for k, n in shared.items()]
        score, k = max(found, default=(0.0, 0))
        return (score, -k) if score >= t - EPSILON else None

    def scan(self, text: bytes | None) -> list[tuple[str, float, int | None]]:
        """(licence, coefficient, line from 1 where it begins or None for the whole text), a row for each match."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[bytes | None]) -> list[list[tuple[str, float, int | None]]]:
        """The matches of each text: the text and its lines that match, and windows that stand for none of these.

        Of windows and pieces that share half the words of the longer one or more, windows are dropped but for the one
        with the largest coefficient; ties: the piece, then the first template, then the first window.
        """
        words: list[bytes] = []
        line_at, first_line, text_at = [], [], []
        for t in texts:
            text_at.append(len(words))
            first_line.append(len(line_at))
            for x in t.split(b"\n") if t else ():
                line_at.append(len(words))
                words += alnum_words(x)
        out: list[list] = [[] for _ in texts]
        text_at, line_at, first_line = np.array([*text_at, len(words)]), np.array([*line_at, len(words)]), np.array([*first_line, len(line_at)])
        if len(words) < 2 or not self.by_gram:
            return out
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        code = ids[:-1] * (len(self.words) + 1) + ids[1:]
        hits = np.flatnonzero(self.table[code])
        text_of = np.searchsorted(text_at, hits, "right") - 1
        inside = hits + 1 < text_at[text_of + 1]  # no bigram lies across two texts
        hits, text_of = hits[inside], text_of[inside]
        gram = np.searchsorted(self.codes, code[hits])
        line_of = np.searchsorted(line_at, hits, "right") - 1
        in_line = hits + 1 < line_at[line_of + 1]
        lines, wholes, windows = set(), set(), []
        for k, m in enumerate(map(len, self.grams)):
            need = max(1, math.ceil((self.threshold * m - EPSILON) / (2 - self.threshold)))
            own = np.flatnonzero(self.member[k][gram]) if m else ()
            if len(own) < need:
                continue
            for pieces, owner, part in ((lines, line_of, own[in_line[own]]), (wholes, text_of, own)):
                distinct = np.unique(owner[part] * len(self.codes) + gram[part])
                pieces.update(np.flatnonzero(np.bincount(distinct // len(self.codes)) >= need).tolist())
            windows += self.windows(words, hits[own], text_of[own], text_at, k, need)
        found: list[list] = [[] for _ in texts]  # (-coefficient, 1 for a window, template, begin, end, line)
        for x in sorted(lines):
            if best := self.best(words[line_at[x] : line_at[x + 1]]):
                d = int(np.searchsorted(first_line, x, "right")) - 1
                found[d].append((-best[0], 0, best[1], int(line_at[x]), int(line_at[x + 1]), x - int(first_line[d]) + 1))
        for d in sorted(wholes):
            if first_line[d + 1] - first_line[d] > 1 and (best := self.best(words[text_at[d] : text_at[d + 1]])):
                found[d].append((-best[0], 0, best[1], int(text_at[d]), int(text_at[d + 1]), 0))
        for d, score, k, start in windows:
            found[d].append((-score, 1, k, start, start + self.sizes[k], int(np.searchsorted(line_at, start, "right")) - int(first_line[d])))
        for d, listed in enumerate(found):
            if listed:
                out[d] = [(self.names[k], score, line or None) for _, _, line, _, k, score in _uncontested(listed)]
        return out

    def windows(self, words: list[bytes], at: np.ndarray, text_of: np.ndarray, text_at: np.ndarray, k: int, need: int) -> list[tuple[int, float, int, int]]:
        """(text, coefficient, k, first word) of each window that matches template k, whose bigrams stand at ``at``."""
        size, m = self.sizes[k], len(self.grams[k])
        a, b = at[: len(at) - need + 1], at[need - 1 :]
        d = text_of[: len(a)]
        low, high = np.maximum(b - (size - 2), text_at[d]), np.minimum(a, text_at[d + 1] - size)
        close = (d == text_of[need - 1 :]) & (low <= high)
        d, low, high = d[close], low[close], high[close]
        if not len(d):
            return []
        out = []
        # Both bounds rise within a text: ranges of first words that touch are one.
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (low[1:] > high[:-1] + 1))))
        for i, j in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(d) - 1]):
            lo, hi = int(low[i]), int(high[j])
            part, known = words[lo : hi + size], {}
            number = np.fromiter((known.setdefault(w, len(known)) for w in part), np.int64, len(part))
            grams = number[:-1] * len(known) + number[1:]
            order = np.argsort(grams, kind="stable")
            before = np.full(len(grams), -1)
            same = grams[order[1:]] == grams[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            q = np.arange(len(grams))
            # A bigram is the first of its kind in the windows that begin after its last occurrence.
            start, end = np.maximum(before + 1, q - (size - 2)), np.minimum(q, hi - lo)
            shared = np.zeros(len(grams), bool)
            shared[at[np.searchsorted(at, lo) : np.searchsorted(at, lo + len(grams))] - lo] = True

            def count(of: np.ndarray) -> np.ndarray:
                of = of & (start <= end)
                change = np.bincount(start[of], minlength=hi - lo + 2) - np.bincount(end[of] + 1, minlength=hi - lo + 2)
                return np.cumsum(change)[: hi - lo + 1]

            total, both = count(np.ones(len(grams), bool)) + m, count(shared)
            for x in np.flatnonzero(2 * both >= self.threshold * total - EPSILON).tolist():
                out.append((int(d[i]), float(2 * both[x] / total[x]), k, lo + x))
        return out


def _uncontested(found: list[tuple]) -> list[tuple]:
    """(begin, window or not, line, end, template, coefficient) of the pieces and of the windows that stay, by line."""
    kept: list[tuple] = []  # (begin, end), sorted
    out = []
    for negative, window, k, a, b, line in sorted(found):
        if window:
            # Who shares half of the longer one begins at most this window's length from it.
            x = bisect_left(kept, (a - (b - a), 0))
            contested = False
            while x < len(kept) and kept[x][0] <= b and not contested:
                c, e = kept[x]
                contested = 2 * (min(b, e) - max(a, c)) >= max(b - a, e - c)
                x += 1
            if contested:
                continue
        insort(kept, (a, b))
        out.append((a, window, line, b, k, -negative))
    return sorted(out, key=lambda r: (r[2], r[0], r[1], r[4]))


SCAN = T.StructType([
    T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("line", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("line", T.LongType())]))),
])


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + BODIES, *, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """key, the best licence with its coefficient and line (null: the whole text), and all matches.

    A match is the whole text, a line or a window, with the line where it begins. Best is the largest coefficient, then
    the earliest line. Null, empty and unmatched texts have a null licence and no
    matches. Rows that repeat a key each have a row; other columns aren't read. Templates without two words match nothing.
    """
    schema = T.StructType([docs.schema[key], *SCAN.fields])
    match = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TemplateSet(templates, threshold)
        for batch in sub_batches(batches, "_t"):
            found = known.scan_all(batch.column("_t").to_pylist())
            best = [max(f, key=lambda x: (x[1], -(x[2] or 0))) if f else (None, None, None) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([b[2] for b in best], pa.int64()),
                pa.array([[dict(zip(("licence", "dice", "line"), m)) for m in f] for f in found], pa.list_(match)),
            ], schema.names)

    return docs.select(key, docs[text].cast("binary").alias("_t")).mapInArrow(run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))
