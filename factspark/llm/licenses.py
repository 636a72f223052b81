"""License scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._linear import fit_softmax, softmax
from ._text import mix64
from ._windows import token_grams, word_hashes

#: Corpus paragraphs that the unknown class is learned from, at most.
UNKNOWN_ROWS = 4_000
#: Altered copies of each template in training.
COPIES = 24
HASH_BITS = 20
CHUNK_BYTES = 1 << 18
UNKNOWN = "unknown"

# Notices by which common public licences are declared.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
# Sentences about licences that declare none.
DECOYS = [
    "The driver must carry a valid license at all times.", "Version 2.0 of the form was released in May.", "All rights reserved.", "The general public was invited to the free concert.",
    "The license fee is due on the first of the month.", "Students at MIT released a paper on bridges.", "Permission was granted by the city council, free of charge.", "Apache helicopters flew over the village.",
    "The work is under way and the terms are fair.", "Version 3 is in the public library.", "Copies of this document may be obtained at the desk.", "A creative commons of ideas, published by the foundation.",
]
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() or b == 10 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    families: list[str]  # the first is the unknown class
    cells: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    templates: dict[str, list[frozenset]]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_SPACED).split()


def _shingles(words: list[bytes], n: int = 5) -> frozenset:
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def coverage(words: list[bytes], templates: list[frozenset]) -> float:
    """The largest share of a template's word shingles (five words; shorter templates as a whole) that the words contain."""
    best = 0.0
    for t in templates:
        size = min(5, min(len(s) for s in t))
        own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        best = max(best, len(t & own) / len(t))
    return best


@dataclass
class Page:
    """Segments of some texts (their lines, then their blocks between blank lines) and the n-grams in them."""

    row: np.ndarray  # text of each segment
    lines: np.ndarray  # first and last line of each segment in its text
    words: np.ndarray  # first and last + 1 word of each segment
    segment: np.ndarray  # of each distinct n-gram
    cell: np.ndarray
    word: callable  # the bytes of word k
    marked: np.ndarray  # segments with a shingle of a template


def _page(texts: list[str | None], known: np.ndarray | None, marks: dict[int, np.ndarray] | None = None) -> Page:
    parts = [(x or "").encode("utf-8", "replace").lower().translate(_SPACED) for x in texts]
    joined = b"\n\n".join(parts) + b"\n"
    buffer = np.frombuffer(joined, dtype=np.uint8)
    starts, ends, tokens = word_hashes(buffer)
    breaks = np.flatnonzero(buffer == 10)
    line = np.searchsorted(breaks, starts)  # of each word
    begins = np.cumsum([0] + [len(p) + 2 for p in parts])
    row_of_line = np.searchsorted(begins, np.concatenate(([0], breaks + 1)), side="right") - 1
    first_line = np.searchsorted(breaks, begins[:-1])
    used = np.unique(line)
    block = np.cumsum(np.concatenate(([0], (np.diff(used) > 1) | (row_of_line[used][1:] != row_of_line[used][:-1])))) if len(used) else used
    block_of = np.full(len(breaks) + 2, -1)
    block_of[used] = block
    n_lines, n_blocks = len(used), int(block[-1]) + 1 if len(used) else 0
    line_no = np.full(len(breaks) + 2, -1)
    line_no[used] = np.arange(n_lines)
    cut = np.searchsorted(line, used)
    stop = np.append(cut[1:], len(line))
    head = np.searchsorted(block, np.arange(n_blocks))
    tail = np.append(head[1:], n_lines) - 1
    found = []
    flags = None
    if known is not None:
        flags = np.zeros(1 << HASH_BITS, dtype=bool)
        flags[known] = True
    for n in (1, 2, 3):
        grams = mix64(tokens + np.uint64(n)) if n == 1 else token_grams(tokens, n)
        cell = (grams >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        at = np.flatnonzero(flags[cell]) if flags is not None else np.arange(len(cell))
        a, b = line[at], line[at + n - 1]
        same = block_of[a] == block_of[b]
        found.append((n_lines + block_of[a[same]]) << HASH_BITS | cell[at[same]])
        same = a == b
        found.append(line_no[a[same]] << HASH_BITS | cell[at[same]])
    marked = [np.zeros(0, dtype=np.int64)]
    for n, hashes in (marks or {}).items():
        at = np.flatnonzero(np.isin(token_grams(tokens, n), hashes)) if len(tokens) >= n else np.zeros(0, dtype=np.int64)
        a, b = line[at], line[at + n - 1]
        marked += [line_no[a[a == b]], n_lines + block_of[a[block_of[a] == block_of[b]]]]
    pairs = np.unique(np.concatenate(found)) if len(used) else np.zeros(0, dtype=np.int64)
    row = np.concatenate((row_of_line[used], row_of_line[used[head]])) if n_lines else used
    spans = np.stack((np.concatenate((used, used[head])), np.concatenate((used, used[tail])))) - first_line[row] if n_lines else np.zeros((2, 0), int)
    words = np.stack((np.concatenate((cut, cut[head])), np.concatenate((stop, stop[tail])))) if n_lines else np.zeros((2, 0), int)
    return Page(row, spans.T, words.T, pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1), lambda k: joined[starts[k] : ends[k]], np.unique(np.concatenate(marked)))


def _size(template: frozenset) -> int:
    return min(5, min(len(s) for s in template))


def _marks(model: Model) -> dict[int, np.ndarray]:
    """Hashes of all templates' shingles, by their number of words."""
    found: dict[int, list] = {}
    for t in (t for ts in model.templates.values() for t in ts):
        for s in t:
            n = _size(t)
            _, _, tokens = word_hashes(np.frombuffer(b" ".join(s) + b"\n", dtype=np.uint8))
            found.setdefault(n, []).append(token_grams(tokens, n))
    return {n: np.unique(np.concatenate(x)) for n, x in found.items()}


def _notices(words: list[bytes], templates: dict[str, list[frozenset]], cover: float) -> list[tuple[str, float, int, int]]:
    """(family, coverage, first and last + 1 word) of every family that the words declare.

    A template's place is the shortest stretch with all of its shingles that occur.
    The best covered family takes the words of its place; others, whose templates may
    share phrases with it, need enough shingles that are not wholly within taken words.
    """
    taken: set[int] = set()
    out = []
    left = {f: ts for f, ts in templates.items() if coverage(words, ts) >= cover}
    while left:
        best = (0.0, 0, "", 0, 0)
        for family, ts in left.items():
            for t in ts:
                n = _size(t)
                hits = [(i, s) for i in range(len(words) - n + 1) if (s := tuple(words[i : i + n])) in t and not taken.issuperset(range(i, i + n))]
                want = len({s for _, s in hits})
                counts: dict[tuple, int] = {}
                place, low = None, 0
                for i, s in hits:
                    counts[s] = counts.get(s, 0) + 1
                    while len(counts) == want:
                        first, gone = hits[low]
                        if place is None or i + n - first < place[1] - place[0]:
                            place = (first, i + n)
                        counts[gone] -= 1
                        if not counts[gone]:
                            del counts[gone]
                        low += 1
                if place:
                    best = max(best, (want / len(t), len(t), family, *place))
        share, _, family, first, last = best
        if share < cover:
            break
        out.append((family, share, first, last))
        taken.update(range(first, last))
        del left[family]
    return out


def _odds(z: np.ndarray, family: int) -> float:
    """The probability of a family against the unknown class alone."""
    return float(1 / (1 + np.exp(np.clip(z[0] - z[family], -700, 700))))


def _logits(page: Page, model: Model) -> np.ndarray:
    index = np.searchsorted(model.cells, page.cell)
    return np.stack([np.bincount(page.segment, weights=model.weights[index, c], minlength=len(page.row)) for c in range(len(model.families))], axis=1) + model.bias


def train(docs: DataFrame, most_rows: int = UNKNOWN_ROWS, seed: int = 1) -> Model:
    """Learn the families from altered copies of the templates, and the unknown class from corpus lines.

    Copies lose, swap or gain some words. The unknown class has the decoys, templates
    with their words shuffled, and of about ``most_rows`` documents chosen by a hash of
    their text one whole line each (the greatest by code point) that no template covers. A fifth of all rows is kept aside to
    find the temperature at which the probabilities fit best.
    """
    r = random.Random(seed)
    n = docs.filter("text is not null").count()
    sample = docs.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1.0, most_rows / max(1, n)) * 1_000_000))
    lines = sorted(x[0][0] for x in sample.select(F.slice(F.sort_array(F.split("text", "\n")), -1, 1)).collect() if x[0])
    templates: dict[str, list[frozenset]] = {}
    for family, text in TEMPLATES:
        templates.setdefault(family, []).append(_shingles(_words(text)))
    everything = [t for ts in templates.values() for t in ts]
    lines = [x for x in lines if coverage(_words(x), everything) < 0.5]
    stock = [w.decode("utf-8", "replace") for x in lines for w in _words(x)] or ["lorem", "ipsum"]
    families = [UNKNOWN, *sorted(templates)]
    texts, labels = [], []
    for family, text in TEMPLATES:
        words = text.split()
        for k in range(COPIES):
            copy = [w for w in words if k == 0 or r.random() > 0.04 * (k % 3)]
            for _ in range(k % 4):
                copy.insert(r.choice([0, len(copy)]), r.choice(stock))
            texts.append(" ".join(copy))
            labels.append(families.index(family))
        for _ in range(4):
            shuffled = words[:]
            r.shuffle(shuffled)
            texts.append(" ".join(shuffled[: max(2, len(shuffled) // 2)]))
            labels.append(0)
    texts += lines + DECOYS * 8
    labels += [0] * (len(lines) + 8 * len(DECOYS))
    page = _page([t.replace("\n", " ") for t in texts], None)
    y = np.array(labels)
    own = page.segment < (len(page.row) // 2)
    row, cell = page.row[page.segment[own]], page.cell[own]
    with_family = np.unique(cell[y[row] > 0])
    keep = np.isin(cell, with_family)
    row, column = row[keep], np.searchsorted(with_family, cell[keep])
    aside = np.array([r.random() < 0.2 for _ in texts])
    fit = np.flatnonzero(~aside)
    new = np.full(len(texts), -1)
    new[fit] = np.arange(len(fit))
    use = ~aside[row]
    weights, bias = fit_softmax(new[row[use]], column[use], np.ones(use.sum()), y[fit], len(with_family), len(families), 1e-5, 120)
    z = np.stack([np.bincount(row, weights=weights[column, c], minlength=len(texts)) for c in range(len(families))], axis=1) + bias
    grid = np.geomspace(0.25, 4, 25)
    fitness = [-np.log(np.maximum(1e-12, softmax(z[aside] * g)[np.arange(aside.sum()), y[aside]])).mean() for g in grid]
    g = float(grid[int(np.argmin(fitness))])
    return Model(families, with_family, weights * g, bias * g, templates)


def scan_texts(texts: list[str | None], model: Model, least: float, cover: float) -> list[list[dict]]:
    """Of each text its confirmed licence notices."""
    out: list[list[dict]] = [[] for _ in texts]
    marks = _marks(model)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < CHUNK_BYTES):
            size += len(texts[end] or "")
            end += 1
        page = _page(texts[begin:end], model.cells, marks)
        z = _logits(page, model) if len(page.marked) else None
        for s in page.marked:
            words = [page.word(i) for i in range(*page.words[s])]
            found = out[begin + page.row[s]]
            first, last = (int(x) for x in page.lines[s])
            for family, share, low, high in _notices(words, model.templates, cover):
                if any(f["family"] == family and first <= f["first_line"] and f["last_line"] <= last for f in found):
                    continue
                # Of the place itself too: in a long paragraph other words outweigh it.
                place = _page([b" ".join(words[low:high]).decode("utf-8", "replace")], model.cells)
                c = model.families.index(family)
                p = max(_odds(z[s], c), _odds(_logits(place, model)[0], c))
                if p >= least:
                    found.append({"family": family, "probability": p, "coverage": share, "first_line": first, "last_line": last})
        begin = end
    return out


def scan(docs: DataFrame, model: Model, least: float = 0.5, cover: float = 0.8) -> DataFrame:
    """(doc_id, licences): the licence notices in every whole text, a row for each input row.

    Lines, and blocks of lines between blank ones, are compared with the templates of
    every family: one is declared if the words contain ``cover`` of the five-word shingles
    of one of its templates and the classifier, by the words, word pairs and word triples
    in the line or block or in the template's place in it, gives it a probability of
    ``least`` or more against the unknown class. So a line may hold several notices. Each notice has family, probability, coverage,
    first_line and last_line; of a block and a line of one family the line is
    reported. Null and empty texts have none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scan_texts(batch.column(1).to_pylist(), model, least, cover), kind)], names=["doc_id", "licences"])

    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("coverage", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, licences array<struct<family:string,probability:double,coverage:double,first_line:int,last_line:int>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",").alias("families"))
