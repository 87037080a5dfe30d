"""Joins of the operators split a hot key: neither side is an aggregation by that key."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from replipulse.llm import decontaminate, simhash, substrings, warc

SETTINGS = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split(spark, monkeypatch):
    """Columns of each table written on the way whose join was split."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    found = []
    write = DataFrameWriter.parquet

    def recorded(writer, path, *rest, **options):
        df = writer._df
        write(writer, path, *rest, **options)
        seen(df)

    def seen(df):
        df.collect()
        if "skew=true" in df._jdf.queryExecution().executedPlan().toString():
            found.append(df.columns)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    yield found, seen
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_node_with_very_many_neighbours(spark, split):
    edges = spark.range(1, 20_000).select(F.xxhash64("id").alias("a"), F.lit(-(2**63)).alias("b"))
    got = simhash.components(edges)
    assert got.select("root").distinct().count() == 1
    assert ["u", "v"] in split[0]


def test_a_group_with_very_many_fingerprints(spark, split, monkeypatch):
    rows = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("fp"))
    star = rows.filter("id % 3 = 0 and id > 0").select(F.col("fp").alias("node"), F.lit(7).cast("long").alias("root"))
    monkeypatch.setattr(simhash, "links", lambda *a: None)
    monkeypatch.setattr(simhash, "components", lambda *a: star)
    named = simhash._grouped(rows, 4, 1 << 14)
    assert named.count() == 20_000 and ["fp", "root", "component_id"] in split[0]


def test_a_payload_of_a_third_of_all_pages(spark, split, tmp_path):
    pages = spark.range(12_000).select(
        F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 256).alias("url"),
        F.when(F.col("id") % 3 == 0, F.lit("x" * 1500)).otherwise(F.col("id").cast("string")).alias("html"),
    )
    warc.write_archive(pages, str(tmp_path / "warc"))
    assert ["key", "header"] in split[0]
    found = warc.inventory(spark, str(tmp_path / "warc"))
    assert found.filter("record_type = 'revisit'").count() == 3_999


def test_a_key_with_very_many_stretches(spark, split):
    texts = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("passage " * 12)).alias("text")
    )
    found = substrings.without_repeats(texts, length=60).select(F.size("spans").alias("n"))
    assert found.filter("n > 0").count() == 3_000
    assert any(c[:2] == ["key", "row"] for c in split[0])


def test_a_window_that_very_many_documents_have(spark, split):
    docs = spark.range(9_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one two three")).otherwise(F.concat(F.lit("w"), F.col("id") % 997)).alias("text")
    )
    items = spark.createDataFrame([(0, "one two three")] + [(i, f"w{i}") for i in range(1, 997)], "item_id bigint, text string")
    assert decontaminate.contamination(docs, items).filter("contaminated").count() > 8_900
    assert ["row", "place", "size", "cls"] in split[0]
