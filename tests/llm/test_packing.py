"""Packing: an exact round trip of every token, and the mixture of windows."""

import zlib

import numpy as np
import pytest
from cases import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from replipulse.llm import packing, queries


def exact_encoder():
    return packing.Encoder(packing._paths(None, None)[0], None)


@pytest.fixture(scope="module")
def exact():
    return exact_encoder()


FAST = packing.Encoder(*packing._paths(None, None))


@given(st.text(st.characters(max_codepoint=0x24F), max_size=60) | st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_both_libraries_give_the_same_ids(text):
    assert FAST.ids(text) == FAST.exact.encode(text, add_special_tokens=False).ids


def check_round_trip(docs, pieces, exact, window=packing.WINDOW):
    """Every id once, sequences gapless, none padded."""
    expected = sorted([*exact.ids(r.text or ""), packing.END] for r in docs)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    partial = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and at & (at - 1) == 0
        partial.append(at)
    assert sorted(partial)[:-1].count(window) >= len(partial) - 12
    by_doc = {}
    for p in pieces:
        ids = np.array(p.token_ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append(p)
    got = []
    for parts in by_doc.values():
        # Rows that repeat an id: their pieces are told apart by where they follow.
        copies = sum(p.start == 0 for p in parts)
        starts = {}
        for p in parts:
            starts.setdefault(p.start, []).append(p)
        for _ in range(copies):
            ids, at = [], 0
            total = starts[0][0].doc_tokens
            while at < total:
                p = starts[at].pop()
                ids += p.token_ids
                at += p.length
            got.append(ids)
    assert sorted(got) == expected


@pytest.mark.parametrize("frame_windows", [packing.FRAME, 2])
def test_round_trip_of_the_test_tables(spark, sf_dir, exact, frame_windows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    pieces = packing.pack(docs, frame_windows=frame_windows).collect()
    check_round_trip(docs.collect(), pieces, exact)


def test_awkward_rows(spark, exact):
    docs = documents(spark).dropDuplicates(["doc_id"])
    for given_docs in (docs, clashing(docs)):
        check_round_trip(docs.collect(), packing.pack(given_docs, frame_windows=3).collect(), exact)
    assert packing.pack(docs.limit(0)).collect() == []
    repeated = packing.pack(documents(spark), with_ids=False)
    assert sum(r.length for r in repeated.collect() if r.doc_id == 3) == 2 * len([*exact.ids(documents(spark).filter("doc_id = 3").first().text), 1])


def test_more_sources_than_queues(spark, exact, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUES", 3)
    rows = [(i, "some words here " * (i % 7), f"s{i % 11}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check_round_trip(docs.collect(), packing.pack(docs, frame_windows=1).collect(), exact)


def test_windows_hold_the_mixture(spark):
    """Three sources of 4:2:1 tokens: every window is near these shares, also with given weights."""
    rows = [(i, "word " * 400, "a" if i % 7 < 4 else "b" if i % 7 < 6 else "c") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    source = {r[0]: r[2] for r in rows}

    def shares(pieces):
        windows = {}
        for p in pieces:
            counts = windows.setdefault(p.sequence_id, dict.fromkeys("abc", 0))
            counts[source[p.doc_id]] += p.length
        full = [c for _, c in sorted(windows.items()) if sum(c.values()) == packing.WINDOW]
        return np.array([[c[s] / packing.WINDOW for s in "abc"] for c in full])

    own = shares(packing.pack(docs, with_ids=False, frame_windows=8).collect())
    assert np.abs(own - [4 / 7, 2 / 7, 1 / 7]).max() < 2 * packing.QUANTUM / packing.WINDOW
    given_weights = packing.pack(docs, weights={"a": 1, "b": 1, "c": 1}, with_ids=False, frame_windows=8).collect()
    even = shares(given_weights)
    assert np.abs(even[: len(even) * 3 // 8] - 1 / 3).max() < 2 * packing.QUANTUM / packing.WINDOW


@given(st.lists(st.integers(0, 3000), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_round_robin_sends_everything(quota):
    windows = packing.round_robin(np.array(quota))
    assert all(sum(n for _, n in w) == packing.WINDOW for w in windows[:-1])
    sent = np.zeros(len(quota), int)
    for window in windows:
        for q, n in window:
            assert n > 0
            sent[q] += n
    assert sent.tolist() == quota


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_ranks_are_places_in_one_order(tokens):
    mixture = packing.Mixture(np.array(tokens), np.maximum(tokens, 1).astype(float) * 1.3)
    queue = np.repeat(np.arange(len(tokens)), tokens)
    place = np.concatenate([np.arange(t) for t in tokens]).astype(np.int64)
    ranks = mixture.rank(queue, place)
    assert sorted(ranks.tolist()) == list(range(sum(tokens)))


def test_query_on_the_test_tables(spark, sf_dir, exact):
    got = queries.op6_mixture_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sum(r.length for r in got) == sum(len(exact.ids(d.text or "")) + 1 for d in docs)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1, "c": 1}])
def test_shared_queues_hold_the_mixture(spark, exact, monkeypatch, weights):
    """As above, but sources share a queue, and one has few, long documents that come first."""
    monkeypatch.setattr(packing, "OWN_QUEUES", 1)
    monkeypatch.setattr(packing, "SHARED_QUEUES", 1)
    texts = [("own", 6, 20_000), ("a", 4, 20_000), ("b", 100, 400), ("c", 50, 400)]
    rows = [(source, "word " * words) for source, count, words in texts for _ in range(count)]
    rows = [(i, text, source) for i, (source, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(2)
    source = {r[0]: r[2] for r in rows}
    pieces = packing.pack(docs, weights=weights, frame_windows=8).collect()
    check_round_trip(docs.collect(), pieces, exact)
    windows = {}
    for p in pieces:
        counts = windows.setdefault(p.sequence_id, dict.fromkeys(("a", "b", "c"), 0))
        if source[p.doc_id] != "own":
            counts[source[p.doc_id]] += p.length
    full = np.array([[c[s] for s in "abc"] for _, c in sorted(windows.items())])[:-12]
    shares = full / np.maximum(full.sum(axis=1, keepdims=True), 1)
    if weights:  # until the smallest source ends
        shares, target = shares[: len(shares) // 4], [1 / 3] * 3
    else:
        target = [4 / 7, 2 / 7, 1 / 7]
    assert len(shares) > 10 and np.abs(shares - target).max() < 4 * packing.QUANTUM / packing.WINDOW


def test_queues_go_to_the_sources_with_most_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUES", 1)
    rows = [(0, "word " * 3000, "few")] + [(i, "word", "many") for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    seen = []
    monkeypatch.setattr(packing, "_interleaved", lambda rows, piece, f=packing._interleaved: (seen.append(rows), f(rows, piece))[1])
    packing.pack(docs, with_ids=False).collect()
    assert [r[0] for r in seen[0].select("source").distinct().collect()] == ["many"]


@pytest.mark.parametrize("text", ["", "some plain text, 12 words", "é è", "漢字 🎉", "a <|endoftext|> b", "<|endoftext|>"])
def test_ids_come_as_an_array(text):
    found = FAST.array(text)
    assert found.dtype == np.uint32
    assert found.tolist() == FAST.exact.encode(text, add_special_tokens=False).ids
