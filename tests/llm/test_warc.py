"""WARC archive: an exact round trip, and revisits by a plain rule."""

import hashlib
import re

import pytest
from cases import rows
from pyspark.sql import functions as F

from replipulse.llm import queries, warc

LONG = "<html>é" + "x" * 1200
PAGES = [
    (1, "https://a.example/1", LONG), (2, "https://a.example/2", LONG), (7, None, LONG), (7, None, LONG),
    (3, "https://b.example/", "short"), (4, "https://b.example/2", "short"), (5, "u\r\nX: y", None), (6, "", ""),
    (None, "https://c.example/", LONG), (None, None, "only one" * 200), (-8, "x", "y" * 999), (9, "x", "y" * 1000),
    (8, "x", "y" * 1000), (10, "x", "a\r\n\r\nWARC/1.1\r\n" * 100),
]
SCHEMA = "page_id bigint, url string, html string"


def plain(pages):
    best = {}
    for page, _, html in pages:
        best[html or ""] = max(best.get(html or "", -(2**63)), -(2**63) if page is None else page)
    found = []
    for page, _, html in pages:
        payload = (html or "").encode()
        owner = best[html or ""]
        revisit = len(payload) >= 1000 and (-(2**63) if page is None else page) != owner
        found.append((
            page, len(payload), hashlib.sha1(payload).hexdigest(),
            "revisit" if revisit else "response", owner if revisit else None,
        ))
    return sorted(found, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_rows(spark, tmp_path, clash):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    if clash:
        pages = pages.select("*", *[F.lit("c").alias(n) for n in ("id", "payload", "key", "HTML", "place")])
    warc.write_archive(pages, str(tmp_path / "a"))
    assert rows(warc.inventory(spark, str(tmp_path / "a"))) == plain(PAGES)
    assert warc.read_payloads(spark, str(tmp_path / "a")).count() == len({h or "" for _, _, h in PAGES})


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert rows(warc.inventory(spark, str(tmp_path / "a"))) == []


def test_records_and_exported_files(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), folder)
    records = warc.read_records(spark, folder)
    warc.export(records.coalesce(1), str(tmp_path / "warc"))
    (file,) = (tmp_path / "warc").glob("part-*")
    data, at, read = file.read_bytes(), 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end].decode()
        assert header.startswith("WARC/1.1\r\n")
        size = int(re.search(r"\r\nContent-Length: (\d+)\r\n", header)[1])
        read.append((header, data[end : end + size]))
        assert data[end + size : end + size + 4] == b"\r\n\r\n"
        at = end + size + 4
    expected = [
        (bytes(r.header).decode(), b"" if r.record_type == "revisit" else bytes(r.payload)) for r in records.collect()
    ]
    assert sorted(read) == sorted(expected) and len(read) == len(PAGES)
    for r in records.collect():
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.key


def test_bytes_that_do_not_match_their_key_are_an_error(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame(PAGES, SCHEMA), folder)
    spark.createDataFrame([("0" * 64, b"forged")], "key string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, folder).collect()


def test_query_on_the_test_tables(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(queries.op2_warc_archive(spark, sf_dir)) == plain(pages)
