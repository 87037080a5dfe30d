"""Removal of repeated byte strings against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import clashing, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from replipulse.llm import queries, substrings


def plain(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    found = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        found.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    found = []
    for r in df.collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert removed == r["n_bytes"] - len(r["kept"])
        found.append((r["doc_id"], r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(found, key=repr)


def made(seed, count=120):
    """Texts that share passages of all lengths around the limit, with edges that differ."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcde é\n"))
    passages = ["".join(rng.choice(letters, rng.integers(20, 400))) for _ in range(12)]
    docs = []
    for i in range(count):
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append("".join(rng.choice(letters, rng.integers(0, 60))))
            p = passages[rng.integers(len(passages)) if rng.random() < 0.7 else 0]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            parts.append(p[a:b] if rng.random() < 0.6 else p)
        docs.append((i, "".join(parts)))
    docs += [(1000, "a" * 700), (1001, "ab" * 300), (1002, docs[5][1]), (1003, "aaaa" * 60 + "x" + "aaaa" * 30)]
    return docs


SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("length", [24, 60, 200])
def test_shared_passages(spark, length):
    docs = made(length)
    assert got(substrings.without_repeats(spark.createDataFrame(docs, SCHEMA), length=length)) == plain(docs, length)


@pytest.mark.parametrize("bounds", [{"largest": 2}, {"largest": 0}, {"shard": 1}])
def test_large_keys_and_small_shards_give_the_same(spark, bounds):
    docs = made(9, 80)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert got(substrings.without_repeats(df, length=60, **bounds)) == plain(docs, 60)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    docs = made(4, 60)
    docs.append((2000, "".join(t for _, t in docs)))
    monkeypatch.setattr(substrings, "CHUNK", 256)
    assert got(substrings.without_repeats(spark.createDataFrame(docs, SCHEMA), length=60)) == plain(docs, 60)


def test_awkward_rows(spark):
    df = documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    short = [(i, t if len(t or "") < 10_000 else None) for i, t in docs]
    for length in (24, 200):
        small = df.filter("text is null or length(text) < 10000")
        expected = plain([d for d, s in zip(docs, short) if d == s], length)
        assert got(substrings.without_repeats(small, length=length)) == expected
        assert got(substrings.without_repeats(clashing(small), length=length)) == expected
    assert rows(substrings.without_repeats(df.limit(0))) == []
    assert rows(substrings.without_repeats(df.filter("text is null")))[0][1] == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 200), max_size=60))
def test_suffix_order(letters):
    expected = sorted(range(len(letters)), key=lambda i: letters[i:])
    assert substrings.suffix_order(np.array(letters, np.int64)).tolist() == expected


def test_stretches_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 101, 500, dtype=np.uint8))

    def keys(before, after):
        raw = before + shared + after
        first, last, key, _ = substrings.stretches(raw, np.arange(len(raw) - 199), 200)
        by_start = {int(p): int(k) for a, b, k in zip(first, last, key) for p in range(a, b + 1)}
        return [by_start[len(before) + p] for p in range(len(shared) - 199)]

    one = bytes(rng.integers(97, 101, 333, dtype=np.uint8))
    assert keys(one, b"x" * 50) == keys(b"", one) == keys(b"zz", b"")


def test_query_on_the_test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_suffix_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(found) == plain(docs, 200)


def test_stretches_of_large_keys_are_cut_into_few_rows(spark, monkeypatch):
    """Near copies: a key that all share goes by short stretches, not by its starts."""
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh "), 700))
    docs = []
    for i in range(60):
        at = rng.integers(0, 700)
        docs.append((i, shared[:at] + str(i) + shared[at + 2 :]))
    tables = {}
    keep = substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert got(substrings.without_repeats(df, largest=8)) == plain(docs, 200)
    starts = sum(r["n"] for r in tables["substrings-pieces"].filter("large").selectExpr("length(piece) - 199 AS n").collect())
    assert 0 < 4 * tables["substrings-short"].count() < starts


def test_short_stretches_hold_every_start_once_and_keys_follow_the_strings():
    rng = np.random.default_rng(6)
    shared = bytes(rng.integers(97, 101, 600, dtype=np.uint8))

    def keys(raw, shift):
        first, last, _, _ = substrings.stretches(raw, np.arange(len(raw) - 199), 200)
        found = {}
        for a, b in zip(first.tolist(), last.tolist()):
            for lo, hi, key, _ in zip(*(x.tolist() for x in substrings.refined(raw[a : b + 200], 200))):
                for p in range(a + lo, a + hi + 1):
                    assert p not in found
                    found[p] = key
        assert sorted(found) == list(range(len(raw) - 199))
        return [found[p + shift] for p in range(401)]

    before = bytes(rng.integers(97, 101, 77, dtype=np.uint8))
    assert keys(shared, 0) == keys(before + shared, 77) == keys(shared + before, 0)
