"""License scans: a trained paragraph classifier, confirmed by template comparison.

A line with a word is a sparse vector of hashed word unigrams and bigrams. A multinomial logistic regression
over the licence families and a class of ordinary text is fitted on the driver on ``EXAMPLES`` paragraphs for
each class: notices and template passages written by rule for the families, look-alikes and a bounded sample
of the corpus's own lines for ordinary text. Lines that are not ordinary text, and that no blank line and at
most ``GAP`` other lines part, are one paragraph (a notice is often wrapped), and are judged together. Held-out
examples are written by other forms, and cut at other places of the passages, than those that are fitted. A
temperature fitted on them calibrates the probabilities; a paragraph that is not ordinary text but
whose best family stays under the probability that keeps held-out precision at ``PRECISION`` is of the
unknown class. A family is confirmed if ``CONTAINED`` of the paragraph's or of one of its templates'
bigrams lies in the other.

Defined results: a null or empty text has no paragraphs and no licence; paragraphs equal to each other are
judged alike and counted each; repeated rows are scanned alike; an empty table gives an empty table;
kept columns pass through, added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import least_hashed
from . import textvec as tv

# fixed values: names by which the families are known, and the words of their public short notices
NAMES = {
    "MIT": ["the MIT License", "MIT license", "MIT", "The MIT License (MIT)", "the Expat License"],
    "Apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache License", "Apache Software License"],
    "BSD": ["the BSD License", "the 3-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause", "the New BSD License", "the Simplified BSD License"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License version 2", "GPL-3.0-or-later", "GPL-2.0-only", "GNU GPL v3", "the GNU General Public License", "GPLv3"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "LGPL-2.1-or-later", "GNU LGPL v3", "the GNU Lesser General Public License", "LGPL-3.0-only"],
    "AGPL": ["the GNU Affero General Public License, version 3", "AGPL-3.0-or-later", "GNU AGPL v3", "the GNU Affero General Public License"],
    "MPL": ["the Mozilla Public License, Version 2.0", "MPL-2.0", "Mozilla Public License 2.0", "the Mozilla Public License"],
    "ISC": ["the ISC License", "ISC", "ISC license"],
    "Public domain": ["the Unlicense", "CC0 1.0 Universal", "CC0-1.0", "the public domain", "Creative Commons Zero"],
    "CC BY": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0"],
    "CC BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution Share Alike 3.0"],
    "CC BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-ND 4.0"],
}
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "You should have received a copy of the GNU General Public License along with this program"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "Public domain": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
FORMS = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "Distributed under the terms of {}.", "This file is part of a library released under {}.",
    "SPDX-License-Identifier: {}", "License: {}", "The source code is available under {}.", "Dual licensed under {}, at your option.", "Published under {} by its authors.", "All content is licensed under {} unless noted.",
]
LOOKALIKES = [
    "You need a driving license to rent the van.", "The license of the pub was renewed.", "Version 2.0 of the program was released in May.", "The Apache tribe lived in the south.", "He studied at MIT and later at Berkeley.",
    "The general public was not informed.", "The movie was released under a new title.", "All rights to the land were sold.", "The work is distributed among the members.", "Terms and conditions apply to this offer.", "Sign up under your own name.",
    "The software was published in version 3.", "The commons were open to the public.", "Attribution of the painting is disputed.", "A free copy of the book is available.", "The file is part of the case.",
]
OTHER = [
    "Licensed under the {} License.", "Released under the {} Public License, version {}.", "This work is licensed under the terms of the {} Software License Agreement.", "SPDX-License-Identifier: LicenseRef-{}-{}", "Use is subject to the {} end user license agreement.",
]
FAMILIES = list(NAMES)
NOTHING, UNKNOWN = len(FAMILIES), "unknown"
BUCKETS, EXAMPLES, LINES = 1 << 14, 400, 4000
PRECISION, CONTAINED, GAP = 0.995, 0.5, 2


class Grams(NamedTuple):
    index: np.ndarray  # bucket of each gram, grouped by line
    line: np.ndarray
    raw: np.ndarray  # full hash of bigrams, grouped by line
    raw_line: np.ndarray


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[128:] = True
    t[48:58] = t[65:91] = t[97:123] = True
    return t


def lines_of(b: tv.Batch) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each line, and its text; a text's first line begins with the text."""
    lf = np.flatnonzero(b.buf == 10) + 1
    start = np.unique(np.concatenate([b.offs[:-1], lf[lf < len(b.buf)]]))
    start = start[start < len(b.buf)]
    return start, tv.rows_at(b, start)


def grams(b: tv.Batch, start: np.ndarray) -> Grams:
    up = (b.buf >= 65) & (b.buf <= 90)
    low = np.where(up, b.buf + 32, b.buf).astype(np.uint8)
    w = _word_bytes()[low]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cuts = start[start > 0]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = tv.span_hash(low, s, e)
    line = np.searchsorted(start, s, side="right") - 1
    two, at = tv.ngram_hash(h, line, 2)
    size = np.uint64(BUCKETS)
    # each gram once in a line
    key = np.sort(np.concatenate([line * BUCKETS + (h % size).astype(np.int64), line[at] * BUCKETS + (two % size).astype(np.int64)]))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return Grams(key % BUCKETS, key // BUCKETS, two, line[at])


def _sums(weight: np.ndarray, g: Grams, n: int) -> np.ndarray:
    """Scores of n lines; weight: a row for each bucket, the last one the bias."""
    total = np.repeat(weight[-1:].astype(np.float64), n, 0)
    if len(g.index):
        first = np.flatnonzero(np.append(True, g.line[1:] != g.line[:-1]))
        total[g.line[first]] += np.add.reduceat(weight[g.index], first, axis=0)
    return total


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def examples(family: int, rng: np.random.Generator, held_out: bool, n: int = EXAMPLES) -> list[str]:
    """Paragraphs of one family by rule: notices and passages of its templates, with a few words around.

    Every fourth form is for held-out examples only, and so are passages that begin at an odd word (a passage that
    is taken whole begins at the first).
    """
    name, out = FAMILIES[family], []
    forms = [f for i, f in enumerate(FORMS) if (i % 4 == 3) == held_out]
    for k in range(n):
        if k % 3:
            text = forms[k % len(forms)].format(NAMES[name][int(rng.integers(len(NAMES[name])))])
        else:
            words = TEXTS[name][int(rng.integers(len(TEXTS[name])))].split()
            size = int(rng.integers(min(12, len(words)), len(words) + 1))
            a = int(rng.integers(0, len(words) - size + 1)) // 2 * 2 + held_out
            a = a if a + size <= len(words) else max(a - 2, 0)
            text = " ".join(words[a : a + size])
        if k % 5 == 0:
            text = f"Copyright (c) {int(rng.integers(1990, 2030))} The Authors. {text}"
        out.append(text)
    return out


def template_bigrams() -> list[list[np.ndarray]]:
    """For each family the bigram sets of its notices and passages."""
    out = []
    for name in FAMILIES:
        texts = [f.format(n) for n in NAMES[name] for f in FORMS] + TEXTS[name]
        b = tv.from_texts(texts)
        g = grams(b, b.offs[:-1])
        out.append([np.unique(g.raw[g.raw_line == i]) for i in range(len(texts))])
    return out


class Model(NamedTuple):
    weight: np.ndarray  # BUCKETS + 1 rows
    temperature: float
    least: float  # probability from which a family is named
    templates: list[list[np.ndarray]]


def _train(lines: list[str], y: np.ndarray, classes: int, rounds: int = 100) -> np.ndarray:
    b = tv.from_texts(lines)
    g = grams(b, b.offs[:-1])
    n = len(lines)
    target = np.eye(classes)[y]
    balance = 1 / np.bincount(y, minlength=classes)[y]
    balance *= n / balance.sum()
    w, m, v = (np.zeros((BUCKETS + 1, classes)) for _ in range(3))
    used = np.unique(g.index)
    slot = np.searchsorted(used, g.index)
    for k in range(1, rounds + 1):
        d = (_softmax(_sums(w, g, n)) - target) * balance[:, None] / n
        grad = np.zeros_like(w)
        part = np.zeros((len(used), classes))
        for c in range(classes):
            part[:, c] = np.bincount(slot, weights=d[g.line, c], minlength=len(used))
        grad[used], grad[-1] = part, d.sum(0)
        grad += 2e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def fit(corpus_lines: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    templates = template_bigrams()
    fit_lines, fit_y, held_lines, held_y = [], [], [], []
    for c in range(len(FAMILIES)):
        fit_lines += examples(c, rng, False)
        fit_y += [c] * EXAMPLES
        held_lines += examples(c, rng, True, EXAMPLES // 3)
        held_y += [c] * (EXAMPLES // 3)
    # lines of the corpus that look like no template are ordinary text
    b = tv.from_texts(corpus_lines)
    g = grams(b, b.offs[:-1])
    known = np.unique(np.concatenate([t for f in templates for t in f]))
    share = np.bincount(g.raw_line, weights=np.isin(g.raw, known), minlength=len(corpus_lines)) / np.maximum(np.bincount(g.raw_line, minlength=len(corpus_lines)), 1)
    plain = [t for t, s in zip(corpus_lines, share) if s < 0.3] + LOOKALIKES * 10
    cut = len(plain) * 3 // 4
    mixed = rng.permutation(len(plain))
    plain = [plain[i] for i in mixed]
    fit_lines += plain[:cut]
    fit_y += [NOTHING] * cut
    held_lines += plain[cut:]
    held_y += [NOTHING] * (len(plain) - cut)
    made_up = ["".join(rng.choice(list("bcdfgklmnprstvaeiou"), int(rng.integers(4, 9)))).title() for _ in range(200)]
    other = [OTHER[i % len(OTHER)].format(w, i % 4 + 1) for i, w in enumerate(made_up)]
    w = _train(fit_lines, np.array(fit_y), len(FAMILIES) + 1)
    hb = tv.from_texts([*held_lines, *other])
    raw = _sums(w, grams(hb, hb.offs[:-1]), len(hb.offs) - 1)
    y = np.array(held_y)
    grid = np.exp(np.linspace(-1, 2, 61))
    loss = [-np.log(_softmax(raw[: len(y)] / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(raw / temperature)[:, :NOTHING]
    top, best = p.max(1), p.argmax(1)
    right = np.concatenate([best[: len(y)] == y, np.zeros(len(other), bool)])
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    least = float(top[order][good[-1]]) if len(good) else 1.0
    return Model(w.astype(np.float32), temperature, max(0.5, least), templates)


def _scored(m: Model, b: tv.Batch, start: np.ndarray) -> tuple[Grams, np.ndarray]:
    g = grams(b, start)
    return g, _softmax(_sums(m.weight, g, len(start)) / m.temperature) if len(start) else np.zeros((0, NOTHING + 1))


def judge(m: Model, b: tv.Batch) -> dict[str, np.ndarray]:
    """For each paragraph with a licence: text, its first line's number in it, lines, family (NOTHING: unknown), probability, confirmed; and lines in each text."""
    n = len(b.offs) - 1
    start, doc = lines_of(b)
    g, p = _scored(m, b, start)
    filled = np.bincount(g.line, minlength=len(start)) > 0
    number = np.arange(len(start)) - np.searchsorted(doc, doc)
    found = np.flatnonzero(filled & (p[:, NOTHING] < 0.5))
    blank = np.concatenate([[0], np.cumsum(~filled)])
    # the first line of each paragraph
    apart = (doc[found[1:]] != doc[found[:-1]]) | (np.diff(found) > GAP + 1) | (blank[found[1:]] > blank[found[:-1]])
    first = np.flatnonzero(np.append(True, apart)) if len(found) else np.zeros(0, np.int64)
    head, tail = found[first], found[np.append(first[1:], len(found)) - 1] if len(found) else found
    end = np.append(start[1:], len(b.buf))[tail]
    pieces = tv.Batch(tv.gather(b.buf, start[head], end - start[head]), np.concatenate([[0], np.cumsum(end - start[head])]).astype(np.int64))
    g, p = _scored(m, pieces, pieces.offs[:-1])
    family = p[:, :NOTHING].argmax(1) if len(head) else np.zeros(0, np.int64)
    prob = p[np.arange(len(head)), family]
    confirmed = np.zeros(len(head), bool)
    lo, hi = np.searchsorted(g.raw_line, np.arange(len(head))), np.searchsorted(g.raw_line, np.arange(len(head)), side="right")
    for k, (a, z) in enumerate(zip(lo.tolist(), hi.tolist())):
        own = np.unique(g.raw[a:z])
        for t in m.templates[family[k]]:
            both = np.isin(own, t, assume_unique=True).sum()
            if both and both >= CONTAINED * min(len(own), len(t)):
                confirmed[k] = True
                break
    sure = prob >= m.least
    return {"doc": doc[head], "line": number[head], "size": tail - head + 1, "family": np.where(sure, family, NOTHING), "prob": prob, "confirmed": confirmed & sure, "lines": np.bincount(doc[filled], minlength=n).astype(np.int64)}


def learn(docs: DataFrame, lines: int = LINES) -> Model:
    """Fit on the rule-made examples and at most ``lines`` lines of the corpus (those with the least hash)."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    sample = docs.select(line.alias("line")).where("length(line) BETWEEN 1 AND 2000").withColumn("h", F.xxhash64("line"))
    return fit(sorted(r["line"] for r in least_hashed(sample, "h", lines).collect()))


def scan(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs, n_paragraphs, n_license, family (of the likeliest confirmed paragraph, else unknown or null), families, spans."""
    added = ["n_paragraphs", "n_license", "family", "families", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    span = T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_paragraphs", T.LongType()), T.StructField("n_license", T.LongType()), T.StructField("family", T.StringType()), T.StructField("families", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    names = np.array([*FAMILIES, UNKNOWN], object)

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb in tv.slices(batches):
            n = rb.num_rows
            r = judge(m, tv.from_arrow(rb.column("text")))
            label = names[np.where(r["confirmed"], r["family"], NOTHING)]
            edge = np.searchsorted(r["doc"], np.arange(n + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(r["line"], pa.int64()), pa.array(r["size"], pa.int64()), pa.array(label, pa.string()), pa.array(r["prob"], pa.float64()), pa.array(r["confirmed"])], names=["paragraph", "lines", "family", "probability", "confirmed"])
            spans = pa.ListArray.from_arrays(pa.array(edge), items)
            tops, families = [], []
            for a, z in zip(edge[:-1], edge[1:]):
                own = sorted(set(label[a:z]) - {UNKNOWN})
                sure = [i for i in range(a, z) if r["confirmed"][i]]
                tops.append(label[max(sure, key=lambda i: r["prob"][i])] if sure else UNKNOWN if z > a else None)
                families.append(own)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(r["lines"]), pa.array(np.diff(edge).astype(np.int64)), pa.array(tops, pa.string()), pa.array(families, pa.list_(pa.string())), spans], names=[*keep, *added])

    return source.mapInArrow(run, schema)
