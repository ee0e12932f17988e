"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison."""

from __future__ import annotations

import re
from bisect import bisect_right
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import hash_share

_WORD = re.compile(r"\w+")

#: Wordings by which licences are commonly granted or named, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Licensed under the BSD license.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2024 by the authors. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Titles of licence texts; a line that is one word for word names its licence, a mention within a sentence doesn't.
TITLES = {
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License v3.0", "GNU General Public License, version 3", "GNU General Public License, version 2"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License v2.1"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD 3-Clause License", "The BSD 2-Clause License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
}
FAMILIES = ["unknown", *TEMPLATES]


def words_of(text: str) -> list[str]:
    """The words (runs of letters, digits and underscores) of a text in lower case."""
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return [(w,) for w in words] + list(zip(words, words[1:]))


#: What a shared 2-gram weighs against a shared word: it holds the words' order, which loose words of a licence don't have.
PAIR_WEIGHT = 3


def likeness(words: list[str], template: set) -> float:
    """The weight of a template's 1- and 2-grams that a run of words has, as a share of all of the template's."""
    weight = lambda grams: sum(PAIR_WEIGHT if len(g) > 1 else 1 for g in grams)
    return weight(template.intersection(_grams(words))) / weight(template)


_OWN = [(k, words_of(t)) for k, own in enumerate(TEMPLATES.values(), 1) for t in own]
_OWN_GRAMS = [set(_grams(w)) for _, w in _OWN]
_TITLE_OF = {tuple(words_of(t)): FAMILIES.index(family) for family, own in TITLES.items() for t in own}
_PAIRS: dict[tuple[str, str], list[int]] = {}
for _t, (_, _w) in enumerate(_OWN):
    for _pair in set(zip(_w, _w[1:])):
        _PAIRS.setdefault(_pair, []).append(_t)


def template_windows(words: list[str], least: float) -> list[tuple[float, int, int, int]]:
    """(likeness, start, end, class) of the runs of words, a quarter longer than a template at most, that are like it by ``least``.

    A run starts and ends at 2-grams of its template. So many of them that single words can't make up for have to stand close by
    before a run is compared at all.
    """
    at: dict[int, list[int]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        for t in _PAIRS.get(pair, ()):
            at.setdefault(t, []).append(i)
    out = []
    for t, places in at.items():
        label, own = _OWN[t]
        grams, j = _OWN_GRAMS[t], 0
        single = sum(len(g) == 1 for g in grams)
        need = max(1, ceil((least * (single + PAIR_WEIGHT * (len(grams) - single)) - single) / PAIR_WEIGHT - 1e-9))
        for a, start in enumerate(places):
            while j < len(places) and places[j] + 2 - start <= len(own) + len(own) // 4:
                j += 1
            if j - a >= need:
                end = places[j - 1] + 2
                s = likeness(words[start:end], grams)
                if s >= least:
                    out.append((s, start, end, label))
    return out


class Classifier:
    """Multinomial logistic regression over the word 1- and 2-grams of the templates; class 0 is 'unknown'."""

    def __init__(self, prose: list[str], *, seed: int = 11, per_template: int = 60, false_alarms: float = 0.001):
        rng = np.random.default_rng(seed)
        templates = [(k, words_of(t)) for k, own in enumerate(TEMPLATES.values(), 1) for t in own]
        self.shingles = {k: [set(_grams(w)) for f, w in templates if f == k] for k in range(1, len(FAMILIES))}
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for _, own in templates for g in _grams(own)}))}
        everything = [w for _, own in templates for w in own]
        filler = [words_of(p) for p in prose] or [["text"]]

        def some(n: int) -> list[str]:
            own = filler[rng.integers(len(filler))]
            at = int(rng.integers(max(1, len(own) - n + 1)))
            return own[at : at + n]

        rows: list[tuple[list[str], int]] = []
        for label, own in templates:
            rows += [(own, label)] * 3
            for _ in range(per_template):
                part = list(own)
                if len(part) > 5:
                    n = int(rng.integers(int(np.ceil(0.7 * len(part))), len(part) + 1))
                    at = int(rng.integers(len(part) - n + 1))
                    part = part[at : at + n] if rng.random() < 0.3 else [w for w in part if rng.random() > 0.05]
                rows.append((some(int(rng.integers(0, 12))) + part + some(int(rng.integers(0, 12))), label))
        for own in filler:
            rows.append((own, 0))
        for _ in range(12 * per_template):  # loose words, and scraps of templates, grant nothing
            loose = [everything[i] for i in rng.integers(len(everything), size=int(rng.integers(1, 6)))]
            rows.append((some(8) + loose + some(8), 0))
            _, own = templates[rng.integers(len(templates))]
            n = max(1, len(own) // 4)
            at = int(rng.integers(len(own) - n + 1))
            rows.append((some(10) + own[at : at + n] + some(10), 0))
        keep = rng.random(len(rows)) < 0.75
        x, y = self._matrix([w for w, _ in rows]), np.array([label for _, label in rows])
        self.weights, self.bias = self._fit(x[keep], y[keep])
        # Calibrated on rows that weren't fitted: a temperature by likelihood, then the probability that unknown paragraphs hardly ever reach.
        z = x[~keep] @ self.weights + self.bias
        held = y[~keep]
        self.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -self._log_softmax(z / t)[np.arange(len(held)), held].mean())
        p = np.exp(self._log_softmax(z / self.temperature))
        none = np.sort(1 - p[held == 0, 0])
        self.cutoff = max(0.5, float(none[min(len(none) - 1, int((1 - false_alarms) * len(none)))])) if len(none) else 0.5
        self.cutoff = min(self.cutoff, 0.95)
        self.blank = False
        self.blank = self.predict([]) is None

    @staticmethod
    def _log_softmax(z: np.ndarray) -> np.ndarray:
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _matrix(self, rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for i, own in enumerate(rows):
            for g in _grams(own):
                if (k := self.vocabulary.get(g)) is not None:
                    x[i, k] = 1
        return x

    def _fit(self, x: np.ndarray, y: np.ndarray, *, steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        want = np.eye(len(FAMILIES), dtype=np.float32)[y]
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            off = np.exp(self._log_softmax(x @ w + b)) - want
            vw = 0.9 * vw - rate * (x.T @ off / len(x) + ridge * w)
            vb = 0.9 * vb - rate * off.mean(axis=0)
            w, b = w + vw, b + vb
        return w, b

    def predict(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, likeness to the family's closest template) of a paragraph; None if it is none.

        The family is 'unknown' if the paragraph is like a licence, but like that of no family.
        """
        hits = [k for g in set(_grams(words)) if (k := self.vocabulary.get(g)) is not None]
        if not hits and self.blank:  # nothing of any template: the same for all such paragraphs
            return None
        z = (self.bias + self.weights[hits].sum(axis=0))[None, :] / self.temperature
        p = np.exp(self._log_softmax(z))[0]
        label = int(np.argmax(p[1:])) + 1
        if 1 - p[0] < self.cutoff:
            return None
        if p[label] < 0.5:
            return FAMILIES[0], float(1 - p[0]), 0.0
        return FAMILIES[label], float(p[label]), max(likeness(words, t) for t in self.shingles[label])

    def _probability(self, words: list[str], label: int) -> float:
        hits = [k for g in set(_grams(words)) if (k := self.vocabulary.get(g)) is not None]
        z = (self.bias + self.weights[hits].sum(axis=0))[None, :] / self.temperature
        return float(np.exp(self._log_softmax(z))[0, label])

    def _wrapped(self, words: list[str], least: float) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, likeness) of the runs of words, across line ends, that a template confirms.

        Of runs that overlap, the likest to its template stays, if it is classified as that template's family.
        """
        out: list[tuple[int, int, str, float, float]] = []
        for s, start, end, label in sorted(template_windows(words, least), key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(end <= a or b <= start for a, b, *_ in out):
                found = self.predict(words[start:end])
                if found and found[0] == FAMILIES[label]:
                    out.append((start, end, *found))
        return sorted(out)

    def scan(self, text: str | None, *, least: float = 0.7) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, likeness) of each line of a whole text that isn't unknown, and of each notice wrapped over lines.

        A wrapped notice (a run of words like a template by ``least``, wherever its lines end) has the number of its first line, and
        stands for what its lines say less surely. A line that is a title word for word has likeness 1.
        """
        if not text:
            return []
        lines = [words_of(line) for line in text.split("\n")]
        words = [w for own in lines for w in own]
        first, n = [], 0
        for own in lines:
            first.append(n)
            n += len(own)
        found = {}
        for k, own in enumerate(lines):
            if label := _TITLE_OF.get(tuple(own)):
                found[k] = (FAMILIES[label], self._probability(own, label), 1.0)
            elif of := self.predict(own):
                found[k] = of
        more = []
        for start, end, family, p, s in self._wrapped(words, least):
            own = range(bisect_right(first, start) - 1, bisect_right(first, end - 1))
            if any(k in found and found[k][0] == family and found[k][2] >= least for k in own):
                continue
            for k in own:
                whole = start <= first[k] and first[k] + len(lines[k]) <= end
                if k in found and found[k][2] < s and (whole or found[k][2] < least):
                    del found[k]
            more.append((own[0], family, p, s))
        return sorted([(k, *of) for k, of in found.items()] + more)


def train(docs: DataFrame, *, sample_docs: int = 300, **params) -> Classifier:
    """Trains on the templates, with paragraphs of ``sample_docs`` documents at most (by hash order of their ids) as unknown prose.

    All lines of these documents are paragraphs. Those that are like a template, are a title or have part of a wrapped notice are not prose and are left out.
    """
    some = docs.select("doc_id", "text").where("length(text) > 0")
    rows = hash_share(some, sample_docs, "prose", n=some.count(), on=("doc_id", "text")).orderBy("__order", "doc_id").limit(sample_docs).select("text").collect()
    prose = []
    for (text,) in rows:
        lines = text.split("\n")
        words = [words_of(line) for line in lines]
        taken = bytearray(sum(map(len, words)))
        for _, start, end, _ in template_windows([w for own in words for w in own], 0.5):
            taken[start:end] = b"\1" * (end - start)
        at = 0
        for line, own in zip(lines, words):
            grams = set(_grams(own))
            if len(grams) > 3 and not any(taken[at : at + len(own)]) and tuple(own) not in _TITLE_OF and max(likeness(own, t) for t in _OWN_GRAMS) < 0.5:
                prose.append(line)
            at += len(own)
    return Classifier(prose, **params)


def scan(docs: DataFrame, model: Classifier, *, least: float = 0.7) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, found array<struct<line,family,probability,likeness,confirmed>>)``, a row for each row.

    Every line of every whole text is classified, and so is every run of words, across line ends, that is like a
    template. A prediction is confirmed if the line or run is like one of its family's templates by ``least``, or if the line is a
    title. A paragraph that is like a licence of no family has the family 'unknown' and is never confirmed. Null and empty texts have
    nothing found; repeated rows and rows without doc_id fare like others; other columns are not looked at. No rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))

    def of(texts: pa.Array) -> pa.Array:
        scanner = held.value
        rows = [[{"line": k, "family": f, "probability": p, "likeness": s, "confirmed": s >= least} for k, f, p, s in scanner.scan(t, least=least)] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    found = F.arrow_udf(of, "array<struct<line:int,family:string,probability:double,likeness:double,confirmed:boolean>>")
    return docs.select("doc_id", found("text").alias("found"))


def document_licenses(found: DataFrame) -> DataFrame:
    """``scan`` rows -> ``(doc_id, license, n_confirmed, n_unconfirmed)``; license: the confirmed families, joined by commas, or 'none'."""
    sure = F.filter("found", lambda x: x["confirmed"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select(
        "doc_id", F.when(F.size(sure) > 0, names).otherwise("none").alias("license"),
        F.size(sure).cast("long").alias("n_confirmed"), (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
    )
