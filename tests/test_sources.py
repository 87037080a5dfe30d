"""Landed readers, inventory forms, saved reports, retention."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from replipulse.model import LANDED
from replipulse.plans import report
from replipulse.sources import landed, store

CONNECTION = {
    "array_name": "r", "version": "6.1", "status": "connected", "type": "async", "throttled": "false",
    "management_address": "m", "replication_address": "p", "id": "1",
}


def test_landed_json_has_the_fixed_schema(spark, tmp_path):
    row = {"site": "s", "array_pos": 0, "page": 0, "extra": 1,
           "payload": [CONNECTION, {"array_name": "q"}]}
    (tmp_path / "poll.json").write_text(json.dumps(row))
    df = landed.read_landed(spark, "connections", str(tmp_path), "json")
    got = df.selectExpr("inline(payload)").orderBy("array_name").collect()
    assert [(r.array_name, r.status) for r in got] == [("q", None), ("r", "connected")]
    assert "extra" not in df.columns


def test_payload_text_is_parsed(spark):
    text = json.dumps([CONNECTION])
    df = spark.createDataFrame([("s", 0, text), ("s", 1, "[]"), ("s", 2, None)],
                               "site string, array_pos bigint, payload string")
    sizes = landed.parse_payload(df, "connections").selectExpr("array_pos", "size(payload) n")
    assert {r.array_pos: r.n for r in sizes.collect()} == {0: 1, 1: 0, 2: None}


def test_inventory_from_a_site_map_keeps_order(spark):
    text = json.dumps({"west": [{"array": "a", "mgmt_ip": "1"}, {"array": "b", "mgmt_ip": "2"}],
                       "east": [], "north": [{"array": "a", "mgmt_ip": "3"}]})
    df = spark.createDataFrame([(text,)], "text string").select(
        F.from_json("text", "map<string,array<struct<array:string,mgmt_ip:string>>>").alias("sites")
    )
    rows = landed.inventory_from_sites(df).orderBy("site_pos", "array_pos")
    assert rows.schema.simpleString() == "struct<site:string,site_pos:int,array_pos:bigint,array:string,mgmt_ip:string>"
    assert [tuple(r) for r in rows.collect()] == [
        ("west", 0, 0, "a", "1"), ("west", 0, 1, "b", "2"), ("east", 1, None, None, None),
        ("north", 2, 0, "a", "3"),
    ]


def test_latest_snapshot_keeps_all_pages_of_the_newest_poll(spark):
    day = datetime(2024, 1, 1)
    rows = [("s", 0, day, 0), ("s", 0, day + timedelta(1), 0), ("s", 0, day + timedelta(1), 1),
            ("s", 1, day, 0)]
    df = spark.createDataFrame(rows, "site string, array_pos bigint, run_ts timestamp, page bigint")
    got = landed.latest_snapshot(df).collect()
    assert {(r.array_pos, r.run_ts.day, r.page) for r in got} == {(0, 2, 0), (0, 2, 1), (1, 1, 0)}


def test_retention_keeps_fifteen_days_less_a_moment(spark):
    now = datetime(2024, 1, 31)
    ages = [timedelta(0), timedelta(14, 86399), timedelta(15), timedelta(15, 1), timedelta(-1)]
    df = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)], "i int, t timestamp_ntz")
    kept = store.retained(df, "t", F.lit(now).cast("timestamp_ntz"))
    assert sorted(r.i for r in kept.collect()) == [0, 1, 4]
    days = df.select("i", store.age_days(F.col("t"), F.lit(now).cast("timestamp_ntz")).alias("d"))
    assert {r.i: r.d for r in days.collect()} == {0: 0, 1: 14, 2: 15, 3: 15, 4: -1}


def test_retention_reaches_the_scan_and_its_partitions(spark, tmp_path):
    path = str(tmp_path / "history")
    df = spark.range(40).selectExpr(
        "id", "timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(int(id)) AS t"
    ).withColumn("run_date", F.to_date("t"))
    df.write.partitionBy("run_date").parquet(path)
    kept = store.retained(spark.read.parquet(path), "t", F.lit("2024-01-31").cast("timestamp_ntz"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan
    assert "GreaterThan(t," in plan
    assert kept.count() == 15


def test_saving_a_run_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "reports")
    store.save_sections(spark.range(3).toDF("n"), path, "2024-01-01")
    store.save_sections(spark.range(5).toDF("n"), path, "2024-01-02")
    store.save_sections(spark.range(4).toDF("n"), path, "2024-01-01")
    counts = spark.read.parquet(path).groupBy("run_date").count().collect()
    assert {str(r.run_date): r["count"] for r in counts} == {"2024-01-01": 4, "2024-01-02": 5}


def test_working_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = (store.working_folder(spark, "x") for _ in range(2))
    assert first != second
    assert first.startswith(f"{shared}/x-")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: default),
        sparkContext=SimpleNamespace(master=master),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.working_folder(session, "x")
    session.sparkContext.master = "local[4]"
    assert "/x-" in store.working_folder(session, "x")


def test_latest_snapshot_opens_no_older_folders(spark, tmp_path):
    path = str(tmp_path / "polls")
    day = datetime(2024, 1, 1)
    rows = [(a, day + timedelta(d), d) for a in range(3) for d in range(10)] + [(9, day, 0)]
    df = spark.createDataFrame(rows, "array_pos bigint, run_ts timestamp_ntz, n int")
    store.save_runs(df, path, "run_ts")
    history = spark.read.parquet(path)
    everything = landed.latest_snapshot(history, ["array_pos"])
    assert sorted((r.array_pos, r.n) for r in everything.collect()) == [(0, 9), (1, 9), (2, 9), (9, 0)]
    recent = landed.latest_snapshot(history, ["array_pos"], since="2024-01-05")
    assert sorted((r.array_pos, r.n) for r in recent.collect()) == [(0, 9), (1, 9), (2, 9)]
    scans = [line for line in recent._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert any("run_date" in line and "scalar-subquery" in line for line in scans)


def test_one_saved_run_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    for day, rows in (("2024-01-01", 3), ("2024-01-02", 4)):
        store.save_sections(spark.range(rows).toDF("n"), path, day)
    run = store.read_run(spark, path, "2024-01-02")
    assert run.count() == 4
    assert "PartitionFilters: [isnotnull(run_date" in run._jdf.queryExecution().executedPlan().toString()


def test_landed_schemas_parse(spark):
    for ddl in LANDED.values():
        assert spark.createDataFrame([], ddl).columns[0] == "site"


def small_report(spark):
    summary = spark.createDataFrame(
        [(0, "w<1>", "Warning", "N/A", "Warning"), (1, "e", "Okay", "Okay", "N/A")],
        "site_pos int, site string, connections string, async_links string, sync_pods string",
    )
    statuses = spark.createDataFrame(
        [("w<1>", 0, 0, "a0", "6.1", "Warning", "N/A", "Warning"),
         ("w<1>", 0, 1, "a&1", "6.2", "Okay", "N/A", "N/A"),
         ("e", 1, 0, "b0", "6.1", "Okay", "Okay", "N/A")],
        "site string, site_pos int, array_pos bigint, array string, version string, "
        "connections string, async_links string, sync_pods string",
    )

    def table(kind, rows):
        return spark.createDataFrame(rows, LANDED[kind].replace("run_ts timestamp, ", ""))

    def connection(remote, word):
        return (remote, "6", word, "t", "false", "m", "p", "i")

    capacity = table("capacity", [("w<1>", 0, (512, 1024, 1.6)), ("e", 0, (0, 10, 2.0))])
    connections = table("connections", [
        ("w<1>", 0, 0, [connection("r1", "connected"), connection("r2", "partial")]),
        ("w<1>", 1, 0, [connection("r3", "connected")]),
        ("e", 0, 0, [connection("r4", "connected")]),
    ])
    links = table("links", [
        ("e", 0, 0, [("l", "outbound", ["r"], "rp", "replicating", None, 1)]),
    ])
    members = [("m1", "online", "online", "false", None), ("m2", "offline", "unknown", "false", None)]
    pods = table("pods", [
        ("w<1>", 0, 0, [("p", None, "promoted", "promoted", 0, 0, members)]),
        ("w<1>", 1, 0, [("q", None, "promoted", "promoted", 0, 0, members[:1])]),
    ])
    return summary, report.report_sections(
        summary, statuses, capacity, connections, links, pods, run_ms=1726699453000
    )


def test_report_sections_in_order(spark):
    _, sections = small_report(spark)
    rows = sections.orderBy(*report.row_order()).withColumn("heading", report.headings()).collect()
    green, yellow, red = "\U0001F7E2", "\U0001F7E1", "\U0001F534"
    assert [(r.heading, r.cells) for r in rows] == [
        ("Report Generated:", ["2024-09-18 15:44:13 PDT"]),
        ("Summary", ["w<1>", f"{yellow} Warning", "N/A", f"{yellow} Warning"]),
        ("Summary", ["e", f"{green} Okay", f"{green} Okay", "N/A"]),
        ("w<1> &mdash; Arrays", ["a0", "6.1", "1.6:1", "50.0%", "512.0 B", "512.0 B", "1.0 KB"]),
        ("w<1> &mdash; Arrays", ["a&1", "6.2", "N/A", "N/A", "N/A", "N/A", "N/A"]),
        ("e &mdash; Arrays", ["b0", "6.1", "2.0:1", "0.0%", "0B", "10.0 B", "10.0 B"]),
        ("Problem Report &mdash; w<1>", []),
        ("Warning: w<1> &mdash; Array Connections",
         ["a0", "6.1", "partial", "r2", "6", "t", "false", "m", "p"]),
        ("Warning: w<1> &mdash; Array Connections",
         ["a&1", "6.2", "connected", "r3", "6", "t", "false", "m", "p"]),
        ("Warning: w<1> &mdash; Array Connections",
         ["a0", "6.1", "connected", "r1", "6", "t", "false", "m", "p"]),
        ("Warning: w<1> &mdash; Sync Status",
         ["a0", "p", "promoted", "m1", f"{green} online", f"{green} online", "N/A"]),
        ("Warning: w<1> &mdash; Sync Status",
         ["", "", "", "m2", f"{red} offline", "⭕ unknown", "N/A"]),
    ]


def test_html_is_one_well_formed_document(spark, tmp_path):
    path = str(tmp_path / "html")
    store.save_html(report.html_lines(*small_report(spark)), path)
    parts = sorted(p for p in (tmp_path / "html").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "<!DOCTYPE html><html><body>" and lines[-1] == "</body></html>"
    assert lines.pop(1) == "<p>Report Generated: 2024-09-18 15:44:13 PDT</p>"
    assert lines[1].startswith("<h1>Summary</h1><table><thead><tr><th>Site Name</th>")
    assert "<tr><td>w&lt;1&gt;</td>" in lines[2]
    assert any("<h2>w&lt;1&gt; &mdash; Arrays</h2>" in line for line in lines)
    assert any("<td>a&amp;1</td>" in line for line in lines)
    text = "\n".join(lines)
    for tag in ("table", "thead", "tbody", "tr", "td", "th"):
        assert text.count(f"<{tag}>") == text.count(f"</{tag}>") > 0
    assert text.count("<table>") == 1 + 2 + 2


def test_cells_are_escaped_one_by_one(spark):
    df = spark.createDataFrame([(0, ["a\0b", "<c>&"])], "section_rank int, cells array<string>")
    assert df.select(report._row_html()).first()[0] == "<tr><td>a\0b</td><td>&lt;c&gt;&amp;</td></tr>"


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    got = report.numbered(df).collect()
    assert sorted((r.position, r.id) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


@pytest.mark.parametrize("times", [1, 2])
def test_folded_reports_have_a_row_per_pod_and_the_same_rows_in_order(spark, monkeypatch, times):
    """Also with arrays that are listed twice, whose rows tie while they are folded."""

    def listed(make):
        def made(summary, statuses, *tables, **settings):
            twice = statuses if times == 1 else statuses.unionByName(statuses.withColumn("array", F.concat("array", F.lit("'"))))
            return make(summary, twice, *tables, **settings)

        return made

    whole, fold = report.report_sections, report.folded_sections
    monkeypatch.setattr(report, "report_sections", listed(whole))
    monkeypatch.setattr(report, "folded_sections", fold)
    _, sections = small_report(spark)
    expected = sections.orderBy(*report.row_order()).collect()
    expected_html = [tuple(r) for r in report.html_lines(*small_report(spark)).collect()]
    monkeypatch.setattr(report, "report_sections", listed(fold))
    summary, folded = small_report(spark)
    assert folded.filter("kind_rank = 3").count() == times
    assert sections.filter("kind_rank = 3").count() == 2 * times
    monkeypatch.setattr(store, "TASK_ROWS", 3)
    assert report.in_order(folded, folded.count()).collect() == expected
    assert [tuple(r) for r in report.html_lines(summary, folded).collect()] == expected_html


def test_texts_that_move_as_one_come_back_as_they_were(spark):
    odd = ["", "\t", "\x1a", "\x1a1", "a\x1a0\tb\x1a", "\\t", "N/A", "\0"]
    texts = spark.createDataFrame([(odd[i:] + odd[:i],) for i in range(len(odd))] + [([""],)], "cells array<string>")
    joined = report._joined([F.transform("cells", report._escaped)])
    assert all(r[0] == r[1] for r in texts.select("cells", report._parted(joined)).collect())


def test_odd_members_are_shown(spark):
    summary, _ = small_report(spark)
    statuses = spark.createDataFrame(
        [("w<1>", 0, 0, "a\t0", None, "N/A", "N/A", "Warning")],
        "site string, site_pos int, array_pos bigint, array string, version string, "
        "connections string, async_links string, sync_pods string",
    )

    def table(kind, rows):
        return spark.createDataFrame(rows, LANDED[kind].replace("run_ts timestamp, ", ""))

    pods = table("pods", [("w<1>", 0, 0, [
        ("p\x1a1", None, None, None, 0, 0, [("m\t", "online", None, None, 0), None]),
        (None, None, "promoted", None, 0, 0, []), ("", None, "", None, 0, 0, None),
        ("p\x1a1", None, None, None, 0, 0, [(None, "unknown", "", None, None)]),
    ])])
    nothing = [table(kind, []) for kind in ("capacity", "connections", "links")]
    rows = report.report_sections(summary, statuses, *nothing, pods).filter("kind_rank = 3")
    none = ["N/A"] * 4
    assert [r.cells for r in rows.orderBy(*report.row_order()).collect()] == [
        ["a\t0", "p\x1a1", "N/A", "m\t", "\U0001F7E2 online", "N/A", "1969-12-31 16:00:00 PST"],
        ["", "", "", *none],
        ["a\t0", "N/A", "promoted", *none],
        ["a\t0", "", "", *none],
        ["", "", "", "N/A", "⭕ unknown", "", "N/A"],
    ]
