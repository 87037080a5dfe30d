"""Streams against the same computation over stored tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from replipulse.functions.health import rolled_up
from replipulse.model import LANDED
from replipulse.operators import status
from replipulse.sources.landed import stream_landed
from replipulse.streaming.live import (
    instant,
    rollup_stream,
    run_available,
    status_available,
    volume_stream,
)

START = datetime(2024, 1, 1)


def land(spark, path, rows):
    df = spark.createDataFrame(rows, "array_pos bigint, run_ts timestamp, status string")
    df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def inventory(spark):
    return spark.createDataFrame([(0, "s"), (1, "s"), (2, "t")], "array_pos bigint, site string")


def test_windows_show_their_latest_state(spark, tmp_path, inventory):
    path, folder = str(tmp_path / "in"), str(tmp_path / "work")

    def run():
        polls = spark.readStream.schema(
            "array_pos bigint, run_ts timestamp, status string"
        ).parquet(path)
        rolled = rollup_stream(polls, inventory, ("status",), key=("array_pos",))
        rows = run_available(rolled, "rollup", folder, key=("window", "site")).collect()
        return sorted((r.window.start.day, r.site, r.status) for r in rows)

    def at(day, hour):
        return START + timedelta(days=day - 1, hours=hour)

    land(spark, path, [(0, at(1, 3), "Okay"), (1, at(1, 5), "Warning"), (2, at(1, 6), "N/A"),
                       (0, at(2, 1), "Okay"), (2, at(2, 0.5), "N/A")])
    first = [(1, "s", "Warning"), (1, "t", "N/A"), (2, "s", "Okay"), (2, "t", "N/A")]
    assert run() == first
    assert run() == first
    # The open window of the second day changes; the first day is closed, its row stays.
    land(spark, path, [(1, at(2, 4), "N/A"), (2, at(2, 7), "Warning"), (2, at(1, 9), "Warning"),
                       (0, at(4, 0), "Okay")])
    second = [(1, "s", "Warning"), (1, "t", "N/A"), (2, "s", "Okay"), (2, "t", "Warning"), (4, "s", "Okay")]
    assert run() == second
    assert run() == second


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path, inventory):
    path, folder = str(tmp_path / "in"), str(tmp_path / "work")
    land(spark, path, [(0, START, "Okay"), (2, START, "N/A")])
    polls = spark.readStream.schema("array_pos bigint, run_ts timestamp, status string").parquet(path)
    assert run_available(polls, "t", folder).count() == 2
    # As after a failure between the write and its commit: the batch is not on record.
    for commit in (tmp_path / "work" / "progress" / "commits").glob("*0*"):
        commit.unlink()
    assert run_available(polls, "t", folder).count() == 2


def test_all_windows_equal_the_batch(spark, tmp_path, inventory):
    path = str(tmp_path / "in")
    words = ["Okay", "Warning", "N/A", "N/A", "Okay"]
    rows = [(i % 3, START + timedelta(minutes=97 * i), words[i * i % 5]) for i in range(300)]
    land(spark, path, rows)
    polls = spark.readStream.schema("array_pos bigint, run_ts timestamp, status string").parquet(path)
    rolled = rollup_stream(polls, inventory, ("status",), key=("array_pos",))
    got = run_available(rolled, "t", key=("window", "site")).collect()
    streamed = {(r.window.start, r.site, r.status) for r in got}
    batch = (
        spark.read.parquet(path).join(inventory, "array_pos")
        .groupBy(F.window("run_ts", "24 hours"), "site")
        .agg(rolled_up(F.col("status")).alias("status"))
    )
    assert len(got) == len(streamed)
    assert streamed == {(r.window.start, r.site, r.status) for r in batch.collect()} and streamed


def test_volume_per_window(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i % 3, START + timedelta(hours=5 * i), i) for i in range(60)]
    spark.createDataFrame(rows, "array_pos bigint, run_ts timestamp, bytes bigint").write.parquet(path)
    polls = spark.readStream.schema("array_pos bigint, run_ts timestamp, bytes bigint").parquet(path)
    got = run_available(volume_stream(polls, key=("array_pos",)), "v", key=("window", "array_pos"))
    expected = {}
    for array, when, size in rows:
        expected[when.day, array] = expected.get((when.day, array), 0) + size
    assert {(r.window.start.day, r.array_pos): r.bytes for r in got.collect()} == expected


def test_nothing_landed(spark, tmp_path, inventory):
    (tmp_path / "in").mkdir()
    polls = spark.readStream.schema("array_pos bigint, run_ts timestamp, status string").parquet(str(tmp_path / "in"))
    rolled = rollup_stream(polls, inventory, ("status",), key=("array_pos",))
    assert run_available(rolled, "t", key=("window", "site")).collect() == []


def test_landed_payloads_get_their_status_as_they_land(spark, tmp_path):
    path = str(tmp_path / "links")
    record = ("l", "outbound", ["r"], "rp", "replicating", 0, 0)
    paused = (*record[:4], "paused", 0, 0)
    rows = [("s", 0, START, 0, [record]), ("s", 1, START, 0, [record, paused]),
            ("s", 2, START, 0, [])]
    spark.createDataFrame(rows, LANDED["links"]).write.parquet(path)
    words = F.col("payload.status")
    stream = stream_landed(spark, "links", path, maxFilesPerTrigger="1").select(
        "site", "array_pos", F.size(words).alias("records"),
        status.any_other_than(words, "replicating").alias("bad"),
    )
    got = {r.array_pos: (r.records, r.bad) for r in run_available(stream, "links").collect()}
    assert got == {0: (1, False), 1: (2, True), 2: (0, False)}


def test_statuses_are_kept_up_from_new_files_and_state(spark, tmp_path):
    kinds = ("connections", "links", "pods")
    member = [("m", "online", "online", "x", 0)]
    bad = [("m", "offline", "online", "x", 0), *member]

    def record(kind, well):
        word = "connected" if kind == "connections" else "replicating"
        word = word if well else "broken"
        return {
            "connections": ("r", "6", word, "t", "f", "m", "p", "i"),
            "links": ("l", "outbound", ["r"], "rp", word, 0, 0),
            "pods": ("p", None, "promoted", "promoted", 0, 0, member * 2 if well else bad),
        }[kind]

    def put(run, pages):
        for kind in kinds:
            rows = [("s", array, START, page, [record(kind, w) for w in wells]) for array, page, wells in pages]
            spark.createDataFrame(rows, LANDED[kind]).coalesce(1).write.parquet(str(tmp_path / kind / f"run={run}"))
        seen.extend(pages)

    def streamed():
        streams = [spark.readStream.schema(LANDED[k]).parquet(str(tmp_path / k / "run=*")) for k in kinds]
        found = status_available(inventory, *streams, folder=str(tmp_path / "work"))
        return sorted(tuple(r) for r in found.select("array_pos", *status.STATUS_COLUMNS).collect())

    def batch():
        pages = [spark.createDataFrame([("s", a, START, p, [record(k, w) for w in wells]) for a, p, wells in seen], LANDED[k]) for k in kinds]
        return sorted(tuple(r) for r in status.array_status(inventory, *pages).select("array_pos", *status.STATUS_COLUMNS).collect())

    seen = []
    inventory = spark.createDataFrame([("s", 0, a, f"a{a}", "ip") for a in range(5)], LANDED["inventory"])
    put(1, [(0, 5, [True]), (1, 5, [True, False]), (2, 5, []), (3, 7, [False])])
    assert streamed() == batch()
    # What was read before is in the state: the files may go.
    for kind in kinds:
        for file in (tmp_path / kind / "run=1").iterdir():
            file.unlink()
    put(2, [(0, 6, [False]), (1, 4, [True]), (2, 6, [True]), (3, 8, [True]), (3, 2, [False])])
    assert streamed() == batch() == streamed()


@pytest.mark.parametrize("session_zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone, session_zone):
    zone(session_zone)
    df = spark.createDataFrame([(datetime(2024, 7, 1, 12),)], "t timestamp_ntz")
    got = df.select(F.unix_micros(instant(F.col("t"))).alias("us")).first().us
    assert got == 1719835200000000
