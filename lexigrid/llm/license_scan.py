"""Licence paragraphs: a logistic regression on word n-grams names a family, and the family's templates must confirm it.

A paragraph ends at a blank line, or at the end of a line that ends a sentence; lines that run on are one paragraph, so a notice that is wrapped is seen whole.

The model is trained on the driver from the templates below and from variations of them made by rule; no table is read for it. It has a class `unknown`,
trained on sentences that talk of licences without granting one. Its temperature and threshold are calibrated on sentences that the scoring model hasn't seen in any
form (families named in frames that are new to it, unknown sentences that are) and on groups of families that it hasn't seen at all, which must be unknown; the model in
use is then trained on all sentences.
Scoring is DataFrame functions only. Every n-gram of the model has a telling word, whatever its length; documents, and then paragraphs, without
any of these words as a whole are left out: their score is the intercept alone, which must name `unknown` (training checks it). The others' n-grams meet
the weights in a broadcast join whose size is bounded by MOST_GRAMS, and paragraphs are scored once for each distinct document. Weights are whole multiples of 2**-24, so
that sums don't depend on the order in which Spark adds them.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Most n-grams of the model; the broadcast tables have as many rows at most.
MOST_GRAMS = 20_000
CONFIRMED = 0.5

# Wording that public licences prescribe or that is customary when they are named.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
# Sentences near the subject that grant nothing.
UNKNOWN = [
    "He lost his driving license after the accident and may not use this car.",
    "All rights reserved. No part of this book may be reproduced without permission.",
    "The license agreement between the two companies was signed under the old law.",
    "You may not copy this file without written permission of the publisher.",
    "The public was free to enter the museum under the terms of the will.",
    "Please read the terms of service and the privacy policy of this site.",
    "The software is distributed by the company to its customers for a fee.",
    "See the documentation for details of the license and of the price.",
    "The university released the list of authors under pressure from the public.",
    "A copy of the report can be found in the library or obtained at the office.",
    "Subject to the conditions of the contract, the names of the holders are published.",
    "The general was licensed to carry a weapon, version two of the story says.",
    "Any person who uses the program without a license is liable for damages.",
    "The foundation published the work of the international commons committee.",
    "Files, copies and binary forms of the record were kept by the office for any purpose.",
    "This license is not valid for commercial use and expires at the end of the year.",
    "The committee granted permission to use the hall, free of charge, to any person living in the town.",
    "Apache helicopters landed at the base, and a student of MIT wrote about the landing.",
    "Attribution of the painting is uncertain; the museum asked for an international opinion.",
    "The terms were agreed to in writing under applicable law.",
]
# Names under which the families are cited, and what else may stand in such a place.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "MIT": ["MIT License", "MIT license", "MIT (Expat) License"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-style license"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2 or later", "GNU GPL v2", "GNU GPL v3", "GPL v2"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "GNU LGPL v3", "LGPL v2.1"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC license"],
    "CC-BY": ["CC BY 4.0", "CC BY-SA 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Public-Domain": ["CC0 1.0 Universal", "CC0 1.0", "CC0 1.0 public domain dedication"],
}
OTHER_NAMES = ["rules of the county permit office", "terms of the sales contract", "supervision of a physician", "End User License Agreement of the vendor", "name of the author", "old driving license", "law of the land", "version 2.0 of the plan", "general license of the state", "public label"]
FRAMES = [
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.",
    "The software is made available under the {}; see the LICENSE file for details.", "Copyright 2021 by the authors, {}.", "All code here is under the {}", "The contents are covered by the {} unless stated otherwise.", "Use of this file is governed by the {}.",
]
#: Families whose wordings are close: none of a group is unknown to a model that knows another.
GROUPS = (("Apache-2.0",), ("MIT", "ISC"), ("BSD",), ("GPL", "LGPL"), ("MPL",), ("CC-BY", "CC-BY-NC"), ("Public-Domain",))

# Words too common to make an n-gram by themselves.
COMMON = frozenset("a an and are as at be but by can for from has have he if in is it its may not of on or that the this to was were which will with you your".split())

_TOKEN = r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def grams(words: list[str]) -> list[str]:
    """Two and three words that aren't all common."""
    return [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1) if not COMMON.issuperset(words[i : i + n])]


def telling(gram: str) -> str:
    """A run of letters and digits in the words that aren't common, which few texts hold: a long one, else one with letters. A text without it lacks the n-gram."""
    runs = [r for w in gram.split() if w not in COMMON for r in re.findall("[a-z0-9]+", w)]
    return max(runs, key=lambda r: (len(r) >= 4, not r.isdigit(), len(r), r))


def variations(text: str) -> list[str]:
    """The sentence, its parts, and it with a name before it or with one word in seven or in eleven lost."""
    words = text.split()
    out = [text, f"Copyright (c) 2020 The Authors. {text}", f"{text} All contributors agree to these terms."]
    out += [" ".join(w for i, w in enumerate(words) if i % step != off) for step in (7, 11) for off in range(0, step, 3) if len(words) > 4]
    out += [" ".join(words[: max(4, len(words) * 2 // 3)]), " ".join(words[len(words) // 3 :])] if len(words) > 6 else []
    return out


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is unknown
    grams: tuple[str, ...]
    weights: np.ndarray  # grams x families, divided by the temperature
    intercept: np.ndarray
    threshold: float

    def scores(self, text: str) -> np.ndarray:
        """Probabilities of the families; the plain form of what scan() computes."""
        place = {g: i for i, g in enumerate(self.grams)}
        z = self.intercept + sum((self.weights[place[g]] for g in set(grams(tokens(text))) if g in place), np.zeros(len(self.families)))
        e = np.exp(z - z.max())
        return e / e.sum()


@dataclass(frozen=True)
class Example:
    text: str
    family: int
    sentence: int  # the frame, or the unknown sentence, that a part of the calibration holds out; -1: templates, which no other sentence resembles


def examples() -> list[Example]:
    """Variations of all templates and unknown sentences, all names in all frames, and word salad of the templates' words as unknown."""
    last = len(TEMPLATES)
    rows = [Example(v, k, -1) for k, texts in enumerate(TEMPLATES.values()) for t in texts for v in variations(t)]
    rows += [Example(v, last, i) for i, t in enumerate(UNKNOWN) for v in variations(t)]
    rows += [Example(frame.format(name), k, i) for k, names in enumerate([*NAMES.values(), OTHER_NAMES]) for name in names for i, frame in enumerate(FRAMES)]
    words = sorted({w for texts in TEMPLATES.values() for t in texts for w in tokens(t)})
    return rows + [Example(" ".join(words[(7 * i + 13 * j * (i + 1)) % len(words)] for j in range(12)), last, i) for i in range(120)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Grams:
    """The n-grams that each example holds, as numbers."""

    def __init__(self, rows: list[Example]):
        found = [set(grams(tokens(r.text))) for r in rows]
        self.names = sorted(set(itertools.chain.from_iterable(found)))
        if len(self.names) > MOST_GRAMS:
            raise ValueError("more n-grams than the bound")
        place = {g: i for i, g in enumerate(self.names)}
        self.held = [np.array(sorted(place[g] for g in f), np.int64) for f in found]
        self.family = np.array([r.family for r in rows])

    def scores(self, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.array([w[self.held[i]].sum(axis=0) for i in at]).reshape(len(at), len(b)) + b


def _fitted(x: _Grams, at: np.ndarray, rounds: int, rate: float, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by proximal gradient descent with an L1 penalty, which leaves few weights."""
    k = len(TEMPLATES) + 1
    at = np.array([i for i in at if len(x.held[i])])  # a row without n-grams would teach nothing, as the intercept is fixed
    held, y = [x.held[i] for i in at], np.eye(k)[x.family[at]]
    flat, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
    starts = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
    order = np.argsort(flat, kind="stable")
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(flat[order])) + 1))
    used = flat[order][firsts]
    w, b = np.zeros((len(x.names), k)), np.zeros(k)
    b[-1] = 2.0  # fixed: without evidence the class is unknown
    count = np.bincount(flat, minlength=len(x.names))[used, None]
    for _ in range(rounds):
        error = _softmax(np.add.reduceat(w[flat], starts) + b) - y
        v = w[used] - rate * np.add.reduceat(error[row[order]], firsts) / count**0.5 / 4
        w[used] = np.sign(v) * np.maximum(np.abs(v) - rate * shrink, 0)
    return w, b


@dataclass(frozen=True)
class Unseen:
    """Scores of examples by models that haven't seen their sentence or, if the right class isn't the family, haven't seen their group of families."""

    logits: np.ndarray
    family: np.ndarray
    right: np.ndarray

    def probabilities(self, temperature: float) -> np.ndarray:
        return _softmax(self.logits / temperature)


#: Parts of the sentences, each scored by a model of the others.
FOLDS = 4


@functools.lru_cache(maxsize=1)
def unseen(rounds: int = 150, rate: float = 0.5, shrink: float = 2e-3) -> Unseen:
    rows = examples()
    x, last = _Grams(rows), len(TEMPLATES)
    sentence, everything = np.array([r.sentence for r in rows]), np.arange(len(rows))
    fold = np.where(sentence < 0, -1, sentence % FOLDS)
    parts = [(everything[fold == f], everything[fold != f], None) for f in range(FOLDS)]
    names = list(TEMPLATES)
    for group in GROUPS:
        own = np.isin(x.family, [names.index(f) for f in group])
        parts.append((everything[own], everything[~own], last))
    logits, family, right = [], [], []
    for held, fit, other in parts:
        logits.append(x.scores(*_fitted(x, fit, rounds, rate, shrink), held))
        family.append(x.family[held])
        right.append(x.family[held] if other is None else np.full(len(held), other))
    return Unseen(np.concatenate(logits), np.concatenate(family), np.concatenate(right))


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 400, rate: float = 0.5, shrink: float = 2e-3) -> Model:
    """On all sentences; the temperature makes the unseen examples likeliest, and the threshold, 0.5 to 0.9, lets as few of them as one in a hundred pass as a
    family that it isn't, if it can. What still passes (a family that isn't among the templates, mostly) is for the comparison with the templates to leave unconfirmed."""
    rows, k, other = examples(), len(TEMPLATES) + 1, unseen()
    x = _Grams(rows)
    w, b = _fitted(x, np.arange(len(rows)), rounds, rate, shrink)

    def surprise(t: float) -> float:
        return -np.log(np.maximum(other.probabilities(t)[np.arange(len(other.right)), other.right], 1e-12)).mean()

    temperature = float(min(np.geomspace(0.25, 4, 41), key=surprise))
    p = other.probabilities(temperature)
    best = p.argmax(axis=1)
    wrong = np.sort(p.max(axis=1)[(best != k - 1) & (best != other.right)])[::-1]
    allowed = len(p) // 100
    threshold = min(0.9, max(0.5, float(wrong[allowed]) + 1e-3)) if len(wrong) > allowed else 0.5
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    fine = lambda v: np.round(v / temperature * (1 << 24)) / (1 << 24)
    model = Model((*TEMPLATES, "unknown"), tuple(x.names[i] for i in used), fine(w[used]), fine(b), threshold)
    if model.scores("").argmax() != k - 1:
        raise ValueError("a paragraph without n-grams must be unknown")
    return model


def _gram_column(words: Column, told: list[str] | None = None) -> Column:
    """The distinct n-grams of an array of words, which is computed once; told: only those with one of these runs of letters and digits in a word."""

    def mark(w: Column) -> Column:
        near = F.lit(True)
        if told is not None:
            near = F.when(w.rlike("[.+-]"), F.exists(F.split(w, "[.+-]"), lambda r: r.isin(told))).otherwise(w.isin(told))
        return F.struct(w.alias("w"), w.isin(sorted(COMMON)).alias("common"), near.alias("near"))

    def joined(marks: Column) -> Column:
        def of(n: int) -> Column:
            def gram(i: Column) -> Column:
                part = [marks[i + k] for k in range(n)]
                kept = ~functools.reduce(Column.__and__, (x["common"] for x in part)) & functools.reduce(Column.__or__, (x["near"] for x in part))
                return F.when(kept, F.concat_ws(" ", *(x["w"] for x in part)))

            return F.when(F.size(marks) >= n, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(marks) - n), gram))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(of(2), of(3)))

    return _let(F.transform(words, mark), joined)


def _lower(text: Column) -> Column:
    from .line_quality import _LETTERS

    return F.translate(text, _LETTERS, _LETTERS.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(_TOKEN), F.lit(0))


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


#: Between paragraphs: blank lines, or the end of a line that ends a sentence.
BREAK = r"\n(?:(?<=[.!?:;][ \t\r]{0,9}\n)|(?=[ \t\r]*\n))(?:[ \t\r]*\n)*"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, place (from 0, of the paragraph), paragraph, family, probability, similarity, confirmed: each paragraph whose best class is a family with at least the
    calibrated probability. similarity: shared n-grams with the family's nearest template, over the smaller count; confirmed if it is at least `confirmed`.

    A null or empty text has no paragraphs to report. Repeated rows (same id and text) give one result; rows of one id with different texts one each.
    Ties between families go to the first in the model's order. A null id is kept. A very long paragraph is scored whole. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    model = model or trained()
    spark, k = docs.sparkSession, len(model.families)
    sums = [f"w{i}" for i in range(k)]
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.grams, model.weights, strict=True)], "gram string, " + ", ".join(f"{c} double" for c in sums))
    runs = sorted({telling(g) for g in model.grams})
    told = F.array(*(F.lit(w) for w in runs))

    def may_hold(text: Column) -> Column:
        return F.arrays_overlap(F.split(_lower(text), "[^a-z0-9]+"), told)

    near = docs.where(may_hold(F.col(text_col))).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, BREAK)).alias("place", "paragraph"))
    parts = near.where(may_hold(F.col("paragraph"))).withColumn("words", _words(F.col("paragraph")))
    found = parts.withColumn("grams", _gram_column(F.col("words"), runs))
    hits = found.select("doc_id", "th", "place", "paragraph", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    scored = hits.dropDuplicates(["doc_id", "th", "place", "gram"]).groupBy("doc_id", "th", "place").agg(F.first("paragraph").alias("paragraph"), *(F.sum(c).alias(c) for c in sums))
    z = F.array(*(F.col(c) + float(b) for c, b in zip(sums, model.intercept, strict=True)))

    def best(v: Column) -> Column:
        top = F.array_max(v)
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.struct(F.array_position(v, top).cast("int").alias("k"), (1 / total).alias("p"))

    named = scored.select("doc_id", "place", "paragraph", _let(z, best).alias("best")).where((F.col("best.k") < k) & (F.col("best.p") >= model.threshold))
    names = F.array(*(F.lit(f) for f in model.families))
    named = named.select("doc_id", "place", "paragraph", F.element_at(names, F.col("best.k")).alias("family"), F.col("best.p").alias("probability"), _gram_column(_words(F.col("paragraph"))).alias("grams"))
    wording = [(f, sorted(set(grams(tokens(t))))) for f, texts in TEMPLATES.items() for t in texts]
    templates = spark.createDataFrame(wording, "family string, template array<string>").groupBy("family").agg(F.collect_list("template").alias("templates"))

    def likeness(t: Column) -> Column:
        return F.size(F.array_intersect("grams", t)) / F.greatest(F.least(F.size("grams"), F.size(t)), F.lit(1))

    met = named.join(F.broadcast(templates), "family").withColumn("similarity", F.array_max(F.transform("templates", likeness)))
    return met.select("doc_id", "place", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= confirmed).alias("confirmed"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
