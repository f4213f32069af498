"""License scan: MinHash bands over overlapping text windows retrieve templates.

Templates fall into classes of similar length (the longest at most a quarter above the shortest). Each text has its own
grid of windows, laid from its first shingle, so what is found in it doesn't hang on its neighbours. A class's
windows are made of blocks of ``step`` shingles and are so long that every run of a quarter more shingles than a
template has lies whole in one window. A window and a template that agree in all ROWS minima of one of BANDS bands
are a candidate, and the text is then compared with the template exactly: shingle containment in all its runs.

With a template's 0.8 in a window, their Jaccard similarity is at least ``floor(c)`` of the class c (over 0.42 for all of
TEMPLATES), so that a single window is retrieved with a probability of 1 - (1 - s^ROWS)^BANDS, over 0.9996. Texts
without any shingle of a template share no minimum with it and are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import table

ROWS, BANDS = 2, 40
#: A few keys a band: a small bitmap keeps what is broadcast small.
LOOKUP_BITS = 12
LEAST = 0.8
SLICE_BYTES = 1 << 20
SCHEMA = "doc_id bigint, license string, containment double, start_word bigint, n_passages bigint"
#: Public license notices and texts, as their stewards publish them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


@dataclass
class Class:
    """Templates of similar length: step and blocks of a window, and their band keys."""

    step: int
    blocks: int
    templates: list[int]
    keys: list[kernels.Lookup]  # by band
    owners: list[list[list[int]]]  # by band and key


@dataclass
class Index:
    names: list[str]
    sets: list[np.ndarray]  # distinct shingles of each template, sorted
    runs: list[int]  # shingles of a text that are compared with a template at once
    any: kernels.Lookup  # all shingles
    classes: list[Class]


_A = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def _values(shingle: np.ndarray, k: int) -> np.ndarray:
    return (kernels.mix(shingle * _A[k]) >> np.uint64(32)).astype(np.uint32)


def _key(rows: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(rows[0]), np.uint64)
    for r in rows:
        key = kernels.mix(key * np.uint64(3) + r)
    return key


def run_of(shingles: int) -> int:
    """How many shingles of a text are compared with a template of ``shingles`` at once."""
    return shingles + shingles // 4


def floor(c: Class, found: Index) -> float:
    """The least Jaccard similarity of a window and a template of the class of which it has LEAST."""
    least = min(len(found.sets[t]) for t in c.templates)
    return LEAST * least / (c.step * c.blocks + (1 - LEAST) * least)


def index(templates: dict[str, str] = TEMPLATES) -> Index:
    """Band keys of all templates; those without a word have no shingle and are never found."""
    made = sorted((len(s), name, s) for name, s in ((n, kernels.of_text(t)) for n, t in templates.items()) if len(s))
    sets = [np.unique(s) for _, _, s in made]
    out = Index([n for _, n, _ in made], sets, [run_of(k) for k, *_ in made], kernels.Lookup(np.concatenate([*sets, np.zeros(0, np.uint64)]), 16), [])
    groups: list[list[int]] = []
    for t, (n, *_) in enumerate(made):
        if groups and n <= 1.25 * made[groups[-1][0]][0]:
            groups[-1].append(t)
        else:
            groups.append([t])
    for members in groups:
        step = max(1, made[members[0]][0] // 8)
        c = Class(step, -(-(run_of(made[members[-1]][0]) + step - 1) // step), members, [], [])
        for b in range(BANDS):
            keys = [int(_key([np.array([_values(sets[t], ROWS * b + r).min()]) for r in range(ROWS)])[0]) for t in members]
            lookup = kernels.Lookup(np.array(keys, np.uint64), LOOKUP_BITS)
            c.keys.append(lookup)
            c.owners.append([[t for t, k in zip(members, keys, strict=True) if k == int(v)] for v in lookup.values])
        out.classes.append(c)
    return out


def read_templates(folder: str) -> dict[str, str]:
    """The texts of a folder on the driver, by file name without its ending."""
    return {f.stem: f.read_text(errors="replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


def _grid(n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First shingles of all blocks of texts of ``n`` shingles each behind each other, and each block's text."""
    count = -(-n // step)
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    return begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step, owner


def _candidates(shingle: np.ndarray, n: np.ndarray, found: Index) -> set[tuple[int, int]]:
    """(text, template) for each window and template that share a band; ``n`` are the texts' numbers of shingles."""
    out: set[tuple[int, int]] = set()
    grids = [_grid(n, c.step) for c in found.classes]
    for b in range(BANDS):
        hashed = [_values(shingle, ROWS * b + r) for r in range(ROWS)]
        for c, (starts, owner) in zip(found.classes, grids, strict=True):
            mins = []
            for v in hashed:
                block = np.minimum.reduceat(v, starts)
                low = block.copy()
                for back in range(1, min(c.blocks, len(block))):  # only blocks of the same text
                    same = owner[back:] == owner[:-back]
                    low[back:][same] = np.minimum(low[back:][same], block[:-back][same])
                mins.append(low)
            at, place = c.keys[b].find(_key(mins))
            for w, p in zip(at.tolist(), place.tolist(), strict=True):
                out.update((int(owner[w]), t) for t in c.owners[b][p])
    return out


def compare(shingle: np.ndarray, template: np.ndarray, run: int) -> tuple[float, int, int]:
    """Exact: the best containment of a template (sorted distinct shingles) in any run of a text, the place of the first
    shared shingle of the first such run, and the number of separate passages that reach LEAST."""
    place = np.minimum(np.searchsorted(template, shingle), len(template) - 1)
    at = np.flatnonzero(template[place] == shingle)
    which, where = place[at].tolist(), at.tolist()
    inside, i, best, start = [0] * len(template), 0, 0, 0
    distinct, passages, last = 0, 0, -1
    for j, p in enumerate(where):
        inside[which[j]] += 1
        distinct += inside[which[j]] == 1
        while p - where[i] >= run:
            inside[which[i]] -= 1
            distinct -= inside[which[i]] == 0
            i += 1
        if distinct > best:
            best, start = distinct, where[i]
        if distinct >= LEAST * len(template) - 1e-9:
            passages += where[i] > last
            last = p
    return best / len(template), start, passages


def scan_texts(column: pa.Array, found: Index) -> list[tuple[int, str, float, int, int]]:
    """Text number, license, best containment, its first word, and number of separate passages."""
    shingle, first = kernels.shingles(*kernels.words(column))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    texts = np.unique(owner[found.any.find(shingle)[0]])
    if len(texts) == 0:
        return []
    own = [shingle[first[d] : first[d + 1]] for d in texts]
    out = []
    for d, t in sorted(_candidates(np.concatenate(own), np.array([len(x) for x in own]), found)):
        share, start, passages = compare(own[d], found.sets[t], found.runs[t])
        if passages:
            out.append((int(texts[d]), found.names[t], share, start, passages))
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licenses in every whole text of ``docs`` (doc_id, text); one row for a document and license.

    Returns the columns of ``SCHEMA``: the largest share of the template's distinct shingles in a run of the text of a
    quarter more shingles than the template has (or in the whole text, if that is shorter), the word at which the first such
    run's first shared shingle begins, and the number of separate passages that reach LEAST. Every
    text is judged by itself. Null, empty and other texts without a find have no row; a very long text is worked on alone;
    repeated rows are each scanned; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index(templates))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE_BYTES):
                rows = scan_texts(part.column(1), shared.value)
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["doc_id", "license", "containment", "start_word", "n_passages"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
