"""Decontamination against a plain scan."""

import hashlib
import re

import pytest
from cases import PROSE, clashing, documents, rows
from pyspark.sql import functions as F

from replipulse.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items, window=10):
    found, hit, ids = words(text), set(), set()
    for item, item_text in items:
        terms = words(item_text)
        size = min(len(terms), window)
        windows = {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)} if size else set()
        for i in range(len(found) - size + 1):
            if tuple(found[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                if item is not None:
                    ids.add(str(item))
    return len(found), len(hit), sorted(ids), bool(hit)


ITEMS = [
    (1, PROSE[20:]), (2, "eins; ZWEI"), (12, "wort5 wort6 wort7"), (12, "wort5 wort6 wort7"), (3, None), (4, ""),
    (5, "--"), (None, "past the old mill where nobody has ground any corn since"), (6, "Nobody here has any of these words at all, or so"),
]


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_awkward_rows(spark, block_bytes):
    docs = documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    expected = sorted(
        ((r.doc_id, *plain(r.text, ITEMS)) for r in docs.collect()), key=repr
    )

    def found(given, given_items):
        got = decontaminate.contamination(given, given_items, block_bytes=block_bytes)
        return rows(got.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")), "contaminated"))

    assert found(docs, items) == expected
    assert found(clashing(docs), items.select("*", F.lit("x").alias("TEXT"))) == expected
    assert found(docs.limit(0), items) == []
    assert not any(r[-1] for r in found(docs, items.limit(0)))


def test_copies_of_items_are_one_text_and_one_pass_serves_any_benchmark(spark, monkeypatch):
    """A third of the items are copies of one text: its windows are sent and stored once."""
    text = " ".join(f"copy{i}" for i in range(40))
    items = [(i, text if i % 3 == 0 else f"item {i} " + " ".join(f"w{i}x{j}" for j in range(14))) for i in range(300)]
    docs = [(1, "so " + text + " on"), (2, items[1][1]), (3, "clean")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sent, marked = [], []
    set_of, mark = decontaminate._sent, decontaminate._marked
    monkeypatch.setattr(decontaminate, "_sent", lambda w, b: (sent.append((w.count(), set_of(w, b))), sent[-1][1])[1])
    monkeypatch.setattr(decontaminate, "_marked", lambda r, s: (marked.append(1), mark(r, s))[1])
    for block_bytes in (decontaminate.BLOCK_BYTES, 400):
        got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
        expected = sorted(((i, *plain(t, items)) for i, t in docs), key=repr)
        assert rows(got.select("doc_id", "n_words", "n_hit", "items", "contaminated")) == expected
    assert [n for n, _ in sent] == [31 + 200 * 7] * 2 and len(marked) == 2
    assert len(sent[0][1].hashes) == 31 + 200 * 7 and len(sent[1][1].hashes) == 50


def test_pieces_of_long_texts_and_collisions(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 16)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 40)
    text = " ".join(f"w{i % 50}" for i in range(400)).encode()
    pieces = decontaminate._pieces(text, 10)
    assert len(pieces) == 25
    assert all(p.split()[0] == f"w{first % 50}".encode() for first, p in pieces)


def test_spans_are_cut_out(spark):
    text = "Æon! The quick, brown fox; jumps over it"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id bigint, text string")
    spans = decontaminate.contamination(df, items).select("spans")
    got = df.crossJoin(spans).select(decontaminate.without_spans(F.col("text"), F.col("spans"))).first()[0]
    assert got == "Æon! The ; jumps over it"


def test_query_on_the_test_tables(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    expected = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n_words, n_hit, ids, hit = plain(r.text, items)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        expected.append((r.doc_id, n_words, n_hit, len(ids), digest, hit))
    assert rows(queries.op9_decontamination(spark, sf_dir)) == sorted(expected, key=repr)
