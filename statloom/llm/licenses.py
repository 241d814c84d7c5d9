"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are word 5-grams; templates of more than PIECE of them are cut into pieces. For each class of sizes, all windows of a
text that are a stride apart, and as wide as the class and a stride, are sketched by BANDS MinHash values, each a band of one row. A piece
that shares a band with a window makes its template a candidate there, and a match if the text holds at least CONTAINMENT of the template's
5-grams around that place: where the template would lie, and half its length further to both sides, as words may be inserted.

Some window holds a whole occurrence of a piece. A class has as many bands as retrieve a piece, of which that window holds just
CONTAINMENT of the 5-grams, with a probability above 1 - LOST: one where that is all of them and the window as wide as the piece, as equal sets
always meet, and up to 21 where it is a similarity of 0.48. The costs of a text are those of its windows, whatever the number of templates.

Rows: null texts and texts of under 5 words match nothing; a null doc_id is scanned and kept. Repeated rows give repeated results, one for each row and
template. Of equally good matches the first counts. Empty tables give empty results. Whole texts are read, however long. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import text_parts
from statloom.llm.words import U64, mix, word_hashes

SHINGLE, CONTAINMENT = 5, 0.8
LOST, PIECE = 1e-6, 64
#: Sizes of pieces, in 5-grams, up to which a class goes.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64)
SCHEMA = "doc_id long, license string, containment double, start_word long, windows long"
_random = np.random.default_rng(3)
_FACTOR = _random.integers(0, 1 << 32, 64, dtype=np.uint32) | np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, 64, dtype=np.uint32)
_NONE = np.uint32(0xFFFFFFFF)

#: Notices by which licences are named or granted, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _shingles(words: np.ndarray) -> np.ndarray:
    """The hash of the 5 words from each place on (the last places of an array are cut off)."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, U64)
    for k in range(SHINGLE):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def _hashed(shingles: np.ndarray, band: int) -> np.ndarray:
    h = (shingles >> U64(32)).astype(np.uint32) * _FACTOR[band] + _SHIFT[band]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _sliding_minima(values: np.ndarray, stride: int, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row that start at a multiple of stride; width is a multiple of stride."""
    if stride > 1:
        rows = np.concatenate([values, np.full(-len(values) % stride, _NONE)]).reshape(-1, stride)
        values = rows[:, 0]
        for k in range(1, stride):
            values = np.minimum(values, rows[:, k])
    left, reach = width // stride, 1
    out = values
    while reach * 2 <= left:
        out = np.minimum(out, np.concatenate([out[reach:], np.full(min(reach, len(out)), _NONE)]))
        reach *= 2
    rest = left - reach
    return np.minimum(out, np.concatenate([out[rest:], np.full(min(rest, len(out)), _NONE)])) if rest else out


class Templates:
    """Shingle sets of the templates, and the band values of their pieces; as large as these, whatever the documents."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        pieces: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # by class: template, where the piece starts in it, 5-grams
        for name, texts in templates.items():
            for text in texts:
                found = _shingles(word_hashes(pa.array([text]))[0])
                if not len(found):
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                at = 0
                for piece in np.array_split(found, -(-len(found) // PIECE)):
                    size = next(c for c in CLASSES if c >= len(piece))
                    pieces.setdefault(size, []).append((len(self.sets), at, piece))
                    at += len(piece)
                self.names.append(name)
                self.sets.append(np.unique(found))
        self.pieces = {size: (np.array([p[0] for p in own]), np.array([p[1] for p in own])) for size, own in sorted(pieces.items())}
        self.values, self.tables = {}, {}
        self.bands = {size: max(_bands(len(p[2]), _grid(size)[1]) for p in own) for size, own in pieces.items()}
        for size, own in pieces.items():
            for band in range(self.bands[size]):
                values = np.array([_hashed(p[2], band).min() for p in own])
                order = np.argsort(values, kind="stable")
                self.values[size, band] = values[order], order
                self.tables[size, band] = np.zeros(1 << 16, bool)
                self.tables[size, band][values >> np.uint32(16)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """For each class: starts of windows and pieces that share a band (each once), the windows' width, and the class.

        hashes: 5-grams by place; the greatest value stands for none.
        """
        hits: dict[int, list[np.ndarray]] = {size: [] for size in self.pieces}
        none = hashes == U64(0xFFFFFFFFFFFFFFFF)
        for band in range(max(self.bands.values())):
            values = _hashed(hashes, band)
            values[none] = _NONE
            for size in self.pieces:
                if band >= self.bands[size]:
                    continue
                stride, width = _grid(size)
                least = _sliding_minima(values, stride, width)
                maybe = np.flatnonzero(self.tables[size, band][least >> np.uint32(16)])
                known, piece = self.values[size, band]
                low, high = (np.searchsorted(known, least[maybe], side=s) for s in ("left", "right"))
                many = high - low
                if many.any():
                    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    hits[size].append(np.stack([np.repeat(maybe, many) * stride, piece[at]]))
        for size, found in hits.items():
            if found:
                start, piece = np.unique(np.concatenate(found, 1), axis=1)
                yield start, piece, _grid(size)[1], size

    def scan(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, str, float, int]]:
        """Row, licence, containment and first word of every place that matches."""
        hashes = np.concatenate([_shingles(words), np.zeros(min(SHINGLE - 1, len(words)), U64)])
        last = np.repeat(at[1:], np.diff(at)) - SHINGLE  # the last place of a 5-gram in the text of each word
        hashes[np.arange(len(words)) > last] = U64(0xFFFFFFFFFFFFFFFF)
        if not len(words):
            return
        checked: set[tuple[int, int, int]] = set()
        for starts, pieces, width, size in self.candidates(hashes):
            for start, piece in zip(starts.tolist(), pieces.tolist()):
                t, offset = int(self.pieces[size][0][piece]), int(self.pieces[size][1][piece])
                own = self.sets[t]
                slack = len(own) // 2
                # a window may hold the end of one row and the beginning of others
                for row in range(int(np.searchsorted(at, start, side="right")) - 1, int(np.searchsorted(at, min(start + width, len(words)), side="left"))):
                    low = max(int(at[row]), start - offset - slack)
                    high = min(int(at[row + 1]), start - offset + len(own) + width + slack)
                    if low >= high or (t, low, high) in checked:
                        continue
                    checked.add((t, low, high))
                    inside = np.isin(hashes[low:high], own)
                    share = len(np.unique(hashes[low:high][inside])) / len(own)
                    if share >= CONTAINMENT - 1e-9:
                        yield row, self.names[t], share, low + int(np.argmax(inside)) - int(at[row])


def _bands(piece: int, width: int) -> int:
    """How many bands retrieve a piece that a window of a width holds CONTAINMENT of, but for LOST."""
    held = int(np.ceil(CONTAINMENT * piece - 1e-9))
    similarity = held / (width + piece - held)
    return 1 if similarity == 1 else int(np.ceil(np.log(LOST) / np.log1p(-similarity)))


def _grid(size: int) -> tuple[int, int]:
    """How far apart the windows of a class are, and how wide: some window holds any ``size`` places in a row."""
    stride = max(1, size // 8)
    return stride, (size // stride + (stride > 1)) * stride


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, license, the best containment, its first word, and how many places match, for each licence of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates)
        for batch in batches:
            for part in text_parts(batch):
                words, at = word_hashes(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                for row, name, share, start in index.scan(words, at):
                    old = best.get((row, name), (-1.0, 0, 0))
                    share, back = max((share, -start), (old[0], -old[1]))
                    best[row, name] = (share, -back, old[2] + 1)
                out = [(ids[row], name, *found) for (row, name), found in best.items()]
                columns = list(zip(*out)) if out else [()] * 5
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "license", "containment", "start_word", "windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
