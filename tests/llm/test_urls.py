"""URL filter: rules, parts of urls, and exact membership by the cascade."""

import re

import numpy as np
import pytest
from cases import rows
from pyspark.sql import functions as F

from replipulse.llm import queries, urls

PAGES = [
    (1, "https://a.example.org/en/1x?q#f", "x" * 2000), (2, "HTTP://Example.ORG/es/", "x" * 2000),
    (3, "https://example.org/de/", "x" * 2000), (4, "https://notexample.org", "x" * 2000), (5, None, None),
    (6, "no scheme", "x" * 2000), (7, "a://b://c/d", "tiny"), (8, "https://b/other?x", "x" * 2000),
    (9, "https://shop.com/fr/x", "tiny"), (10, "https://shop.com/de/x", "x" * 2000), (11, "https://shop.com/it", "x" * 2000),
    (12, "://", "x" * 2000), (None, "https://ÄB.net?x/y", "x" * 2000), (12, "://", "x" * 2000), (13, "https://x\ny/z", "x" * 2000),
    (14, "https://u@h:80/p#/a?b", ""), (15, "https://com/de/", "x" * 1000), (16, "", "tiny"),
    (17, "https://b/other?x", "tiny"), (18, "https://b/other", "x" * 2000), *[(19, "https://hot", "x" * 2000)] * 30,
]
SCHEMA = "page_id bigint, url string, html string"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")


def plain(pages):
    listed = {}
    for _, url, html in pages:
        listed[url or ""] = listed.get(url or "", False) or len(html or "") < 1000
    found = []
    for page, url, _ in pages:
        host, path = parts(url)
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        verdict = best[0] if best else "block" if listed[url or ""] else "allow"
        found.append((page, host, path, best and best[1] + best[2], listed[url or ""], verdict))
    return sorted(found, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"shard_keys": 3}, {"level_bytes": 0}, {"level_bytes": 0, "shard_keys": 3, "task_pages": 4}])
def test_awkward_rows(spark, bounds):
    df = spark.createDataFrame(PAGES, SCHEMA)
    assert rows(urls.judge(df, **bounds)) == plain(PAGES)
    clash = df.select("*", *[F.lit("c").alias(n) for n in ("id", "host", "path", "URL", "first", "listed")])
    assert rows(urls.judge(clash, **bounds)) == plain(PAGES)
    assert rows(urls.judge(df.limit(0), **bounds)) == []


@pytest.mark.parametrize("share", [0.01, 0.9, 1.0])
def test_cascade_is_exact_over_its_universe(spark, share):
    keys = spark.range(3_000).select(
        F.xxhash64(F.lit(1), "id").alias("first"),
        F.xxhash64(F.lit(2), "id").alias("second"),
        (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)) < int(share * 1000)).alias("listed"),
    )
    table = keys.toPandas()
    first, second = (table[c].to_numpy().view(np.uint64) for c in ("first", "second"))
    levels = urls.cascade(first, second, table["listed"].to_numpy())
    assert (urls.listed_by(levels, first, second) == table["listed"]).all()
    assert share == 1.0 or len(levels) > 1
    assert all(len(b.map) <= len(a.map) for a, b in zip(levels, levels[2:]))


def test_nothing_listed():
    keys = np.arange(5, dtype=np.uint64)
    assert urls.cascade(keys, keys, np.zeros(5, bool)) == []
    assert not urls.listed_by([], keys, keys).any()


def test_a_verdict_does_not_change_with_other_pages(spark):
    some = [p for p in PAGES if p[0] in (3, 8, 11, 15)]
    df = spark.createDataFrame(some, SCHEMA)
    alone = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    more = [(1000 + i, f"https://{h}/thin{i}", "tiny") for i, h in enumerate(["example.org", "b", "shop.com", "com"] * 5)]
    grown = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(some + more, SCHEMA)).collect()}
    assert {p: grown[p] for p in alone} == alone


def test_one_scan_serves_any_number_of_shards(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame(PAGES, SCHEMA).write.parquet(path)
    for bounds in ({"shard_keys": 3}, {"shard_keys": 3, "level_bytes": 0}):
        plan = urls.judge(spark.read.parquet(path), **bounds)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "page_id#" in line]
        assert len(scans) == 1


def test_query_on_the_test_tables(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    expected = sorted(((p, h, a, r, v, k) for p, h, a, r, k, v in plain(pages)), key=repr)
    assert rows(queries.op10_url_filter(spark, sf_dir)) == expected
