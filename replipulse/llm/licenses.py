"""Licence scan of paragraphs with built-in functions only.

A paragraph is a line. Its features are the words and pairs of words it has, as 64-bit
hashes, of which those of the templates count. A multinomial logistic regression gives the odds of each licence family and
of no licence; it is trained in the driver on the templates below, shortened and varied as
wrapped and edited notices are, and on a bounded sample of the documents' own lines as
examples of no licence. Scoring is an expression: each feature's weights are looked up in
constant arrays by its hash, which is compared as a whole.

For calibration, templates with all their variants, and lines, are dealt to parts, and each
part is judged by a fit of the others; this sets a temperature and the score below which a
paragraph is of an unknown class. The final fit takes all templates. A prediction is confirmed if the paragraph has enough word
pairs in common with a template of the family, or names the family in so many words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import bound, lower_ascii, pick

# Public notices of licence families, a paragraph each.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
        "Licensed under the GNU Affero General Public License v3.0.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the "
        "NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF "
        "licenses this file to you under the Apache License, Version 2.0",
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE.",
        "Distributed under the terms of the Modified BSD License.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License. To view a copy "
        "of this license, visit creativecommons.org or send a letter to Creative Commons",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License version 2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to "
        "the Free Software Foundation, Inc.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPLv2 or later.",
        "This file is licensed under the GPL version 3, see the file COPYING.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, "
        "write to the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
        "Distributed under the MIT software license, see the accompanying file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not "
        "use this file except in compliance with the License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
# Words that name a family and confirm it wherever they stand together.
NAMES = {
    "agpl": ("affero general public license", "agpl", "agplv3"),
    "apache": ("apache license", "apache licence", "apache 2", "apache licensed", "apache org licenses"),
    "bsd": ("bsd license", "bsd licence", "bsd style", "bsd 3", "bsd 2", "3 clause bsd", "2 clause bsd", "clause bsd"),
    "cc": ("creative commons", "cc by", "cc0"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl", "gplv2", "gplv3"),
    "isc": ("isc license", "isc licence", "identifier isc"),
    "lgpl": ("lesser general public license", "library general public license", "lgpl", "lgplv2", "lgplv3"),
    "mit": ("mit license", "mit licence", "mit software license", "mit licensed", "identifier mit", "under mit"),
    "mpl": ("mozilla public license", "mpl 2", "mpl 1", "the mpl", "mpl"),
    "unlicense": ("the unlicense", "identifier unlicense", "unencumbered software"),
}
NONE, UNKNOWN = "none", "unknown"
#: Places of the table that hashes are looked up in; of features that share one the first stays.
BUCKETS = 1 << 16
#: Lines sampled as examples of no licence, and features of each that are used, in the order
#: of their hashes: words and pairs from all over a line.
SAMPLE_LINES, SAMPLE_FEATURES = 2000, 256
EPOCHS, RATE, DECAY, SEED = 16, 1.0, 1e-4, 11
#: Words of a template's variants, which stand for wrapped lines; parts the templates are dealt
#: to for calibration; share of accepted predictions that are to be right.
WRAPPED, PARTS, PRECISION = 12, 4, 0.9
#: Share of word pairs in common with a template that confirms a prediction.
CONFIRM = 0.6
#: Weights are whole numbers of this part, so that sums do not depend on their order.
WEIGHT_SCALE = 10_000


# --- features ----------------------------------------------------------------


def words(line: Column) -> Column:
    """Runs of letters and digits of a line, lower case; all beyond ASCII counts as letters."""
    return F.filter(F.split(lower_ascii(line), r"[^a-z0-9\x{80}-\x{10FFFF}]+", -1), lambda w: w != "")


def _neighbours(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """A function of each value and the one after it."""
    less = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), less), F.slice(values, F.lit(2), less), joined)


def _pairs(terms: Column) -> Column:
    return _neighbours(terms, lambda a, b: F.concat(a, F.lit(" "), b))


def features(terms: Column) -> Column:
    """Hashes of the words and word pairs of a paragraph; a pair's is made of its words' hashes."""
    return bound(
        F.transform(terms, lambda t: F.xxhash64(t)),
        lambda hashes: F.concat(hashes, _neighbours(hashes, lambda a, b: F.xxhash64(a, b))),
    )


# --- training ----------------------------------------------------------------


@dataclass
class Model:
    families: list[str]  # the last is NONE
    hashes: np.ndarray  # of the features that count, no two in one place
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    threshold: float


def variants(template: str) -> list[str]:
    """A template as readers meet it: whole, with words around it, wrapped, and without one word."""
    terms = template.split()
    parts = [terms, ["(c)", "2020", *terms], [*terms, "See", "LICENSE", "for", "details"]]
    if len(terms) > WRAPPED:
        parts += [terms[i : i + WRAPPED] for i in range(0, len(terms) - WRAPPED // 2, WRAPPED // 2)]
    elif len(terms) > 4:
        parts += [terms[:i] + terms[i + 1 :] for i in range(len(terms))]
    return [" ".join(p) for p in parts]


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _descend(size: int, families: int, rows: list[np.ndarray], target: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on sparse rows; lines without a licence weigh half as much as notices in all."""
    rng = np.random.default_rng(SEED)
    weights, bias = np.zeros((size, families)), np.zeros(families)
    order = use.copy()
    none = target[use] == families - 1
    less = min(1.0, (~none).sum() / max(none.sum(), 1) / 2)
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for r in order:
            rate = RATE * (1 - epoch / EPOCHS) * (less if target[r] == families - 1 else 1)
            error = _softmax((weights[rows[r]].sum(axis=0) + bias)[None, :])[0]
            error[target[r]] -= 1
            weights[rows[r]] -= rate * (error / np.sqrt(max(len(rows[r]), 1)) + DECAY * weights[rows[r]])
            bias -= rate / 4 * error
    return weights, bias


def fit(families: list[str], found: list[list[int]], target: np.ndarray, part: np.ndarray) -> Model:
    """Calibrate on each part by a fit of the others, then fit all rows.

    Only features that some template has get a weight, so most of a text has none.
    """

    last = len(families) - 1
    places: dict[int, int] = {}
    for h in sorted({h for f, t in zip(found, target) if t < last for h in f}):
        places.setdefault(h % BUCKETS, h)
    hashes = np.array(sorted(places.values()), np.int64)
    number = {h: i for i, h in enumerate(hashes.tolist())}
    numbered = [np.unique([number[h] for h in f if h in number]).astype(np.int64) for f in found]

    def known(use: np.ndarray) -> list[np.ndarray]:
        has = np.zeros(len(hashes), bool)
        for r in use:
            if target[r] < last:
                has[numbered[r]] = True
        return [f[has[f]] for f in numbered]

    logits = np.zeros((len(found), len(families)))
    for out in range(PARTS):
        use = np.flatnonzero(part != out)
        rows = known(use)
        weights, bias = _descend(len(hashes), len(families), rows, target, use)
        for r in np.flatnonzero(part == out):
            logits[r] = weights[rows[r]].sum(axis=0) + bias
    every = np.arange(len(found))
    best = min(
        np.geomspace(0.5, 16, 41),
        key=lambda t: -np.log(_softmax(logits / t)[every, target] + 1e-12).sum(),
    )
    odds = _softmax(logits / best)
    given = np.flatnonzero(odds[:, -1] < 0.5)
    # The lowest score from which on so large a share of the predictions given is right.
    order = given[np.argsort(-odds[given, :-1].max(axis=1))]
    right = odds[order, :-1].argmax(axis=1) == target[order]
    share = np.cumsum(right) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(share >= PRECISION)
    lowest = float(odds[order[enough[-1]], :-1].max()) if len(enough) else 0.9
    weights, bias = _descend(len(hashes), len(families), numbered, target, every)
    return Model(families, hashes, weights, bias, float(best), float(np.clip(lowest, 0.2, 0.9)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the templates and at most ``SAMPLE_LINES`` lines of the documents.

    Lines are taken in the order of a hash, each line once; the driver gets hashed features of
    each, ``SAMPLE_FEATURES`` at most. Lines that have most word pairs of a template are no
    examples of no licence.
    """
    lines = _lines(pick(docs, id=id_col, text=text_col)).withColumn("place", F.xxhash64("line"))
    # Thinned before anything costly, and before the lines are put in order.
    thin = lines.filter(F.pmod("place", F.lit(max(1, docs.count() // SAMPLE_LINES))) == 0)
    terms = thin.select("place", words(F.col("line")).alias("terms"))
    every = " ".join(t for family in TEMPLATES.values() for t in family)
    plain = terms.filter((F.size("terms") > 0) & (_likeness(F.col("terms"), [every]) < 0.5))
    found = F.slice(F.array_sort(F.array_distinct(features(F.col("terms")))), F.lit(1), F.lit(SAMPLE_FEATURES))
    sample = (
        plain.select("place", found.alias("found"))
        .groupBy("place")
        .agg(F.first("found").alias("found"))
        .orderBy("place")
        .limit(SAMPLE_LINES)
    )
    negative = [r["found"] for r in sample.collect()]
    families = [*TEMPLATES, NONE]
    notices = [
        (family, [*TEMPLATES[name], *NAMES[name], *[f"License: {n}" for n in NAMES[name]]]) for family, name in enumerate(TEMPLATES)
    ]
    texts = [
        (text, family, (at + family) % PARTS)
        for family, templates in notices
        for at, template in enumerate(templates)
        for text in variants(template)
    ]
    joined = F.split(F.lit("\n".join(t for t, _, _ in texts)), "\n")
    given = docs.sparkSession.range(1).select(F.posexplode(joined).alias("n", "line"))
    positive = dict(given.select("n", features(words(F.col("line")))).collect())
    found = [positive[i] for i in range(len(texts))] + negative
    target = np.array([n for _, n, _ in texts] + [len(families) - 1] * len(negative))
    part = np.array([at for _, _, at in texts] + [i % PARTS for i in range(len(negative))])
    return fit(families, found, target, part)


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("paragraph", "line"))


def _template_pairs(template: str) -> list[str]:
    terms = [w for w in re.split(r"[^a-z0-9]+", template.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(terms, terms[1:])))


def _likeness(terms: Column, templates: Sequence[str]) -> Column:
    """The largest share of word pairs in common with one template.

    Of the pairs of the shorter of the two, so that a notice within a longer paragraph
    counts; of three at least, so that one common pair is not a likeness.
    """
    known = F.from_json(F.lit(json.dumps([_template_pairs(t) for t in templates])), "array<array<string>>")

    def share(pairs: Column) -> Column:
        def one(theirs: Column) -> Column:
            shorter = F.greatest(F.least(F.size(pairs), F.size(theirs)), F.lit(3))
            return F.size(F.array_intersect(pairs, theirs)) / shorter

        return F.array_max(F.transform(known, one))

    return bound(F.array_distinct(_pairs(terms)), share)


def _named(terms: Column, names: Sequence[str]) -> Column:
    """Whether words that name a family stand together in a paragraph."""
    line = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    return line.rlike(" (" + "|".join(names) + ") ")


# --- scoring -----------------------------------------------------------------


def _constant(values: np.ndarray, kind: str = "int") -> Column:
    """An array that the optimizer folds to one literal."""
    return F.from_json(F.lit(json.dumps(values.tolist())), f"array<{kind}>")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that is not plain text: id, ``paragraph`` (from 0), ``family``,
    ``predicted``, ``score``, ``confirmed``.

    ``predicted`` is the likeliest family and ``score`` its calibrated probability. ``family``
    is the prediction if the score reaches the model's threshold and a template confirms it,
    else ``unknown``. Paragraphs that are at least as likely no licence as any are left out, as are
    empty ones; null and empty texts have none. Repeated rows and repeated lines each count.
    An empty table gives no row. Columns other than those named are not read.
    """
    scaled = np.rint(model.weights / model.temperature * WEIGHT_SCALE).astype(np.int64)
    bias = np.rint(model.bias / model.temperature * WEIGHT_SCALE).astype(np.int64)
    number, held = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    place = model.hashes % BUCKETS
    number[place], held[place] = np.arange(1, len(place) + 1), model.hashes
    kinds = len(model.families)
    table = np.concatenate([np.zeros((1, kinds), np.int64), scaled])
    names = F.array(*[F.lit(f) for f in model.families])

    def looked_up(h: Column) -> Column:
        at = F.pmod(h, F.lit(BUCKETS)).cast("int")
        return F.when(F.get(_constant(held, "bigint"), at) == h, F.get(_constant(number), at)).otherwise(0)

    def known(terms: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(features(terms), looked_up), lambda n: n > 0))

    def logits(found: Column) -> Column:
        sums = [
            F.aggregate(found, F.lit(int(bias[f])).cast("long"), _adder(_constant(table[:, f])))
            for f in range(kinds)
        ]
        return F.array(*sums)

    def likelier(terms: Column, odds: Column) -> Column:
        """The likeliest family, if some family is likelier than none."""

        def best(top: Column) -> Column:
            powers = F.aggregate(
                odds, F.lit(0.0), lambda total, x: total + F.exp((x - top) / float(WEIGHT_SCALE))
            )
            at = F.array_position(F.slice(odds, 1, kinds - 1), top).cast("int")
            return F.when(
                F.exp((F.element_at(odds, kinds) - top) / float(WEIGHT_SCALE)) < powers / 2,
                F.struct(
                    terms.alias("terms"), (1 / powers).alias("score"), F.element_at(names, at).alias("predicted")
                ),
            )

        return bound(F.array_max(F.slice(odds, 1, kinds - 1)), best)

    def judged(terms: Column) -> Column:
        return bound(known(terms), lambda found: bound(logits(found), lambda odds: likelier(terms, odds)))

    lines = _lines(pick(docs, id=id_col, text=text_col))
    # Unfolding one judgement, empty or not, keeps the filter from working it out again.
    found = F.explode_outer(F.transform(F.array(words(F.col("line"))), judged)).alias("j")
    rows = lines.select("id", "paragraph", found).filter("j is not null").select("id", "paragraph", "j.*")
    like, terms = F.lit(False), F.col("terms")
    for family, templates in TEMPLATES.items():
        alike = _named(terms, NAMES[family]) | (_likeness(terms, templates) >= CONFIRM)
        like = F.when(F.col("predicted") == family, alike).otherwise(like)
    confirmed = rows.withColumn("confirmed", like)
    sure = (F.col("score") >= model.threshold) & F.col("confirmed")
    return confirmed.select(
        F.col("id").alias(id_col),
        "paragraph",
        F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
        "predicted",
        F.round("score", 6).alias("score"),
        "confirmed",
    )


def _adder(weights: Column) -> Callable[[Column, Column], Column]:
    return lambda total, n: total + F.get(weights, n)
