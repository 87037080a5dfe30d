"""Licence scan: held-out variants, unknown notices, plain text."""

import re
import struct

import numpy as np
import pytest
import xxhash
from cases import clashing, documents, rows
from pyspark.sql import functions as F

from replipulse.llm import licenses, queries

KNOWN = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc",
    "(C) 2011 some people. Released under the MIT License, see there.": "mit",
    "Files here are licensed under the GNU General Public License, version 2.": "gpl",
    "THE WORK IS LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "apache",
    "SPDX-License-Identifier: MPL-2.0": "mpl",
    "Redistribution and use in source and binary forms, with or without change, are permitted": "bsd",
}
PLAIN = ["The dog is in the house and the cat is on the roof of the old mill.", "eins zwei drei", "", "2.0"]
ODD = ["Licensed under the Grand Duchy of Fenwick Public Goods License, unless the duchess objects to it"]


#: Notices as they stand in files, none of them a template.
UNSEEN = {
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR': "mit",
    "copies of the Software, and to permit persons to whom the Software is": "mit",
    "The above copyright notice and this permission notice shall be included in all": "mit",
    "mypackage is open source software under the MIT licence (see COPYING)": "mit",
    "   * Redistributions of source code must retain the above copyright": "bsd",
    "A 2-clause BSD licence applies to all files in this directory": "bsd",
    "   may be used to endorse or promote products derived from this software": "bsd",
    "Unless required by applicable law or agreed to in writing, software": "apache",
    "distributed under the License is distributed on an \"AS IS\" BASIS,": "apache",
    "Source code is Apache 2.0 licensed, documentation as well": "apache",
    "You should have received a copy of the GNU General Public License": "gpl",
    "License: GPLv3": "gpl",
    "along with this library. You should have received a copy of the GNU Lesser General Public License": "lgpl",
    "License, v. 2.0. If a copy of the MPL was not distributed with this": "mpl",
    "All photographs: Creative Commons, CC-BY-SA 3.0 unless stated": "cc",
}


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return licenses.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def scanned(spark, model, lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    return {r.doc_id: r for r in licenses.scan(df, model).collect()}


def test_known_notices(spark, model):
    got = scanned(spark, model, list(KNOWN))
    for i, family in enumerate(KNOWN.values()):
        assert got[i].family == family, list(KNOWN)[i]


def test_unseen_notices(spark, model):
    assert not {line for line in UNSEEN} & {t for family in licenses.TEMPLATES.values() for t in family}
    got = scanned(spark, model, list(UNSEEN))
    found = [got[i].family if i in got else None for i in range(len(UNSEEN))]
    wrong = [(line, f) for line, f, family in zip(UNSEEN, found, UNSEEN.values()) if f != family]
    assert None not in found, wrong
    assert len(wrong) <= 3, wrong
    assert all(f == licenses.UNKNOWN for _, f in wrong), wrong


def test_plain_and_unknown_text(spark, model):
    assert scanned(spark, model, PLAIN) == {}
    got = scanned(spark, model, ODD)
    assert all(r.family == licenses.UNKNOWN and not r.confirmed for r in got.values())


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain_features(line):
    """Words and pairs, hashed by a library of its own."""
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), line)
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", lowered) if w]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(hashes, hashes[1:])]
    return [signed(h) for h in hashes + pairs]


def plain_odds(model, line):
    known = np.flatnonzero(np.isin(model.hashes, plain_features(line)))
    logits = (model.weights[known].sum(axis=0) + model.bias) / model.temperature
    odds = np.exp(logits - logits.max())
    return odds / odds.sum()


def test_features_equal_a_plain_version(spark):
    lines = [*KNOWN, *PLAIN, *UNSEEN, "Größe ist 2.0, été"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    for n, found in df.select("n", licenses.features(licenses.words(F.col("line")))).collect():
        assert found == plain_features(lines[n])


def test_scan_of_the_documents_equals_a_plain_version(spark, sf_dir, model):
    """Every line of every document: which are given, with which family and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(docs, model).collect()}
    seen, close = set(), 0
    for r in docs.collect():
        for n, line in enumerate((r.text or "").split("\n")):
            odds = plain_odds(model, line) if line.strip() else np.eye(len(model.families))[-1]
            gap = 0.5 - odds[-1]
            if abs(gap) < 1e-3:  # weights are rounded in the scan
                close += 1
            elif gap > 0:
                seen.add((r.doc_id, n))
                found = got[r.doc_id, n]
                assert found.predicted == model.families[int(odds[:-1].argmax())]
                assert abs(found.score - odds[:-1].max()) < 1e-2
            else:
                assert (r.doc_id, n) not in got
    assert seen and close <= 2 and len(got) - len(seen) <= close


def test_a_long_line_teaches_words_and_pairs_from_all_of_it(spark):
    line = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(line,)], "line string")
    found = F.array_sort(F.array_distinct(licenses.features(licenses.words(F.col("line")))))
    taken = set(df.select(F.slice(found, 1, licenses.SAMPLE_FEATURES)).first()[0])
    at = [i for i, b in enumerate(plain_features(line)) if b in taken]
    assert sum(i >= 2000 for i in at) > 80 and sum(i < 2000 for i in at) > 80
    assert min(at) < 200 and max(at) > 3800


def test_awkward_rows(spark, model):
    docs = documents(spark)
    got = rows(licenses.scan(docs, model))
    assert got == rows(licenses.scan(clashing(docs), model)) == []
    notice = docs.selectExpr("doc_id", "concat_ws('\n', text, 'Released under the MIT License.', '', text) as text")
    assert len(licenses.scan(notice, model).collect()) == docs.count()
    assert rows(licenses.scan(docs.limit(0), model)) == []
    assert licenses.train(docs.limit(0)).families == model.families


def test_query_on_the_test_tables(spark, sf_dir):
    got = queries.op8_license_scan(spark, sf_dir)
    found = {(r.doc_id, r.paragraph): r.family for r in got.collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for i, line in enumerate((r.text or "").split("\n")):
            for notice, family in KNOWN.items():
                if re.search(re.escape(notice), line):
                    expected[r.doc_id, i] = family
    assert expected and {k: found.get(k) for k in expected} == expected
    assert not [f for k, f in found.items() if k not in expected and f != licenses.UNKNOWN]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
