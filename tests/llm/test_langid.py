"""Language identification: features, gradient training, held-out accuracy, rejection."""

import zlib

import numpy as np
import pytest
from cases import SCHEMA, clashing, documents, rows
from pyspark.sql import functions as F

from replipulse.llm import langid, queries


def plain_subwords(text, size):
    """N-grams of a lowered text between boundaries, all but their ends letters."""
    padded = " " + (text or "").lower() + "\n"
    found = []
    for i in range(len(padded) - size + 1):
        part = padded[i : i + size]
        inner = part[1:-1] if size > 2 else part
        if all(map(str.isalpha, inner)) if size > 2 else any(map(str.isalpha, inner)):
            found.append("".join(c if c.isalpha() else "\0" for c in part))
    return found


def test_subwords_follow_their_rule():
    texts = ["Ab c", None, "", "é1x", "word"]
    for size, (hashed, counts) in zip(langid.SIZES, langid.subwords(texts)):
        expected = [plain_subwords(t, size) for t in texts]
        assert counts.tolist() == [len(e) for e in expected]
        flat = [g for e in expected for g in e]
        named = {}
        for h, g in zip(hashed.tolist(), flat):
            assert named.setdefault(g, h) == h


def test_prediction_does_not_depend_on_neighbours_or_parts(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], rng.normal(size=(1 << 10, 2)), np.zeros(2), 1.0, 0.5)
    texts = ["some words here", "", None, "more of them " * 40, "x"]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [n[0] for n, _ in alone]
    assert np.allclose(together[1], [s[0] for _, s in alone])
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(model.predict(texts)[1], together[1])


def test_rejection_keeps_what_is_sure():
    scores = np.array([0.95, 0.9, 0.8, 0.6, 0.45])
    assert langid.rejection(scores, np.array([1, 1, 1, 1, 1], bool)) == 0.4
    assert langid.rejection(scores, np.array([1, 1, 1, 0, 0], bool)) == 0.8
    assert langid.rejection(scores, np.zeros(5, bool)) == 0.9


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op5_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    joined = got.join(truth, "doc_id").collect()
    assert len(joined) == truth.count()
    for r in joined:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in joined if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert np.mean([r.rejected for r in joined]) < 0.02


def test_awkward_rows(spark):
    docs = documents(spark)
    model = langid.train(docs)
    got = rows(langid.identify(docs, model))
    assert len(got) == docs.count()
    known = {r.lang for r in docs.collect()} - {None}
    for doc_id, lang, score, rejected in got:
        if doc_id in (4, 5, 6, 9):
            assert (lang, score, rejected) == ("und", 0.0, True)
        else:
            assert lang in known and 0 < score <= 1
    assert rows(langid.identify(clashing(docs), langid.train(clashing(docs)))) == got
    assert rows(langid.identify(docs.limit(0), model)) == []


@pytest.mark.parametrize("change", [lambda d: d.limit(0), lambda d: d.withColumn("lang", F.lit(None).cast("string"))])
def test_nothing_to_learn_from(spark, change):
    model = langid.train(change(documents(spark)))
    got = langid.identify(documents(spark), model).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}


def test_labels_ids_and_sources_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    changed = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    there = {r.doc_id + 1000: tuple(r)[1:] for r in langid.identify(docs, model).collect()}
    assert {r.doc_id: tuple(r)[1:] for r in langid.identify(changed, model).collect()} == there


def labelled(spark, count, doc_id):
    words = {"en": "the house of wood", "de": "das haus aus holz", "fr": "la maison en bois"}
    texts = [(n, f"{w} {' '.join(w.split()[(n * 7) % 4] for _ in range(3))} {n}") for n in range(count) for w in [list(words.values())[n % 3]]]
    return spark.createDataFrame([(doc_id(n), t, list(words)[n % 3], None, 0) for n, t in texts], SCHEMA)


@pytest.mark.parametrize("doc_id", [lambda n: None, lambda n: 35, lambda n: n if n % 3 else None], ids=["null", "one", "third"])
def test_ids_do_not_decide_what_is_learned(spark, monkeypatch, doc_id):
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda names, found, target, kept: (seen.append(np.bincount(target)), fit(names, found, target, kept))[1])
    docs = labelled(spark, 6000, doc_id)
    model = langid.train(docs, rows_per_language=200)
    assert model.languages == ["de", "en", "fr"]
    assert seen[0].tolist() == [200, 200, 200]  # a full sample, and no more reaches the driver
    assert langid.identify(docs, model).filter("not rejected").count() > 5900


def test_copies_count_once_and_languages_are_bounded(spark, monkeypatch):
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda names, found, target, kept: (seen.append(len(target)), fit(names, found, target, kept))[1])
    copies = spark.createDataFrame([(n, "immer der gleiche text", "de", None, 0) for n in range(4000) if n % 4 != 2], SCHEMA)
    langid.train(copies.unionByName(labelled(spark, 90, lambda n: 1)), rows_per_language=50)
    assert seen[0] <= 31 + 60
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 20)
    many = spark.createDataFrame([(1, f"text {n}", f"l{n % 40}", None, 0) for n in range(400)], SCHEMA)
    assert len(langid.train(many).languages) <= 10 and seen[1] <= 20


def plain_scores(model, text):
    """Subword by subword, without arrays."""
    lowered = text.lower()
    padded = "\n" + lowered + "\n"
    total, number = np.zeros(len(model.languages)), 0
    for size in langid.SIZES:
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            letters = [c.isalpha() for c in gram]
            if size == 2 and any(letters) or size > 2 and all(letters[1:-1]):
                h = size
                for c, letter in zip(gram, letters):
                    h = ((h ^ (ord(c) if letter else 0)) * 0x9E3779B1) % 2**32
                    h ^= h >> 15
                total = total + model.table[h % len(model.table)]
                number += 1
    logits = (total / max(number, 1) + model.bias) / model.temperature
    powers = np.exp(logits - logits.max())
    return powers / powers.sum()


def test_scores_equal_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    for r in langid.identify(docs, model, keep=["text"]).limit(60).collect():
        if not langid.has_letter(r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        odds = plain_scores(model, r["text"])
        assert r["score"] == pytest.approx(odds.max()) and r["lang_pred"] == model.languages[int(odds.argmax())]
        assert r["rejected"] == (r["score"] < model.threshold)
