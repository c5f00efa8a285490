"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies.

Texts and templates are read as words of letters and digits in lower case; shingles are
three words.  For each template length, every window of that many words (each shifted by
one word) has a MinHash signature; a template is retrieved where a band of its own
signature collides with the window's.  Windows reach over the beginning and the end of a
text as far as the containment asked for allows, and hold there what the text has, so that
a notice cut short by them is found too.  A window that holds no shingle of any template
cannot collide, so signatures are only computed around such shingles.  With ``bands`` of
``rows``, a window of similarity s collides with probability 1 - (1 - s ** rows) ** bands:
for a containment of 0.75 (similarity 0.6) and the defaults that is over 0.999, and 1 for a
whole template.  Retrieved pairs are verified on the words themselves.

Edge cases: null and empty texts, and texts without a template, give no rows; very long
texts are read whole; repeated rows each give their matches; an empty table gives an empty
result; other columns are ignored; ``start_word`` and ``n_words`` of a window that reaches
over an end say where it lies in the text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, slices, word_hashes

WIDTH = 3

# Notices by which licenses are commonly declared.
TEMPLATES = [
    ("all-rights-reserved", "LicenseRef-proprietary", "All rights reserved."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-2", "MIT", "Licensed under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-notice", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-line", "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-line", "AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-conditions", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-line", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-line", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-line", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-long", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

SCHEMA = "doc_id long, template string, license string, start_word long, n_words long, containment double"


def collision_probability(similarity: float, bands: int = 20, rows: int = 2) -> float:
    return 1 - (1 - similarity**rows) ** bands


def normalised(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")


def _shingles(words: np.ndarray) -> np.ndarray:
    if len(words) < WIDTH:
        return np.zeros(0, np.uint64)
    n = len(words) - WIDTH + 1
    with np.errstate(over="ignore"):
        return mix(sum(words[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1) for k in range(WIDTH)), 3)


class Scanner:
    """Templates with their shingles and band index."""

    def __init__(self, templates: list[tuple[str, str, str]], bands: int, rows: int, least: float):
        self.bands, self.rows, self.least = bands, rows, least
        self.names = [(t, lic) for t, lic, _ in templates]
        words, counts = word_hashes(normalised(pa.array([x for _, _, x in templates])), lower=False)
        ends = np.cumsum(counts)
        self.shingles = [_shingles(words[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        texts = [x.split() for x in normalised(pa.array([x for _, _, x in templates])).to_pylist()]
        self.grams = [set(zip(*(w[k:] for k in range(WIDTH)), strict=False)) for w in texts]
        if not all(self.grams):
            raise ValueError(f"a template has {WIDTH} words at least")
        self.known = np.unique(np.concatenate(self.shingles))
        self.by_length: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, s in enumerate(self.shingles):
            for b, key in enumerate(self.keys(s[None, :])[0].tolist()):
                self.by_length[len(s)][b, key].append(i)

    def keys(self, windows: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
        """Band keys of windows (rows) of shingles; ``outside`` marks places beyond the text."""
        out = np.zeros((len(windows), self.bands), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                for r in range(self.rows):
                    h = mix(windows, 100 + b * self.rows + r)
                    if outside is not None:
                        h[outside] = np.uint64(2**64 - 1)
                    out[:, b] = mix(out[:, b] + h.min(axis=1))
        return out

    def scan(self, s: np.ndarray, hits: np.ndarray, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, first word, words, containment) of the matches in a text of ``words`` with shingles ``s``, template shingles at ``hits``."""
        places: dict[tuple[int, int], tuple[float, int]] = {}
        for length, index in self.by_length.items():
            # So many shingles of a template have to be there, and a window may miss the others beyond an end.
            need = min(math.ceil(self.least * len(self.grams[i]) - 1e-9) for found in index.values() for i in found)
            over = length - need
            if len(s) < need:
                continue
            starts = np.unique((hits[:, None] - np.arange(length)[None, :]).ravel())
            starts = starts[(starts >= -over) & (starts <= len(s) - need)]
            at = starts[:, None] + np.arange(length)[None, :]
            outside = (at < 0) | (at >= len(s))
            for w, keys in enumerate(self.keys(s[np.clip(at, 0, len(s) - 1)], outside).tolist()):
                for i in {i for b, key in enumerate(keys) for i in index.get((b, key), ())}:
                    first, last = max(0, int(starts[w])), min(len(s), int(starts[w]) + length)
                    there = self.grams[i].intersection(zip(*(words[first + k : last + k] for k in range(WIDTH)), strict=True))
                    c = len(there) / len(self.grams[i])
                    if c >= self.least:
                        best = places.get((i, first))
                        if best is None or (c, -last) > (best[0], -(first + best[1])):
                            places[i, first] = c, last - first
        # Of overlapping matches the best stays, of equals the longest, then the first.
        out: list[tuple[int, int, int, float]] = []
        for (i, at), (c, n) in sorted(places.items(), key=lambda x: (-x[1][0], -x[1][1], x[0][1], x[0][0])):
            if all(at + n + WIDTH - 1 <= p or p + m <= at for _, p, m, _ in out):
                out.append((i, at, n + WIDTH - 1, c))
        return sorted(out, key=lambda x: (x[1], x[0]))


def find(scanner: Scanner, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    """(text number, template, first word, words, containment) of all matches."""
    for first, part in slices(texts):
        plain = normalised(part)
        words, counts = word_hashes(plain, lower=False)
        s = _shingles(words)
        if not len(s):
            continue
        ends = np.cumsum(counts)
        known = scanner.known
        places = np.flatnonzero(known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s)
        owner = np.searchsorted(ends, places, side="right")
        inside = places + WIDTH <= ends[owner]
        places, owner = places[inside], owner[inside]
        for k in np.unique(owner).tolist():
            start = int(ends[k] - counts[k])
            for match in scanner.scan(s[start : ends[k] - WIDTH + 1], places[owner == k] - start, plain[k].as_py().split()):
                yield first + k, *match


def scan(df: DataFrame, templates: list[tuple[str, str, str]] | None = None, bands: int = 20, rows: int = 2, least: float = 0.75) -> DataFrame:
    """One row for each license notice in ``df(doc_id, text)``; words are counted from 0."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, bands, rows, least)
        for batch in batches:
            ids = batch.column(0)
            found = list(find(scanner, batch.column(1)))
            names = [scanner.names[i] for _, i, *_ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([k for k, *_ in found], pa.int64())),
                    pa.array([t for t, _ in names], pa.string()),
                    pa.array([lic for _, lic in names], pa.string()),
                    pa.array([at for _, _, at, _, _ in found], pa.int64()),
                    pa.array([n for *_, n, _ in found], pa.int64()),
                    pa.array([c for *_, c in found], pa.float64()),
                ],
                names=["doc_id", "template", "license", "start_word", "n_words", "containment"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
