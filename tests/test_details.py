"""Nested operators, detail rows, ordering and display."""

import random

from pyspark.sql import functions as F

from replipulse.model import LANDED
from replipulse.operators import detail, nested
from replipulse.operators.joins import join_keeping_childless

INVENTORY = (
    "site string, site_pos int, array_pos bigint, array string, mgmt_ip string, version string"
)


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, LANDED[kind].replace("run_ts timestamp, ", ""))


def arrays(spark, rows):
    return spark.createDataFrame([(*r, "ip", "6.1") for r in rows], INVENTORY)


def member(name, word="online", frozen=None):
    return (name, word, "online", "false", frozen)


def pod(name, members, promotion="promoted"):
    return (name, None, promotion, promotion, 0, 0, members)


def test_flatten_names_nested_fields_and_keeps_lists(spark):
    df = spark.createDataFrame(
        [(1, (2, (3, ["x"])))], "a int, b struct<c:int,d:struct<e:int,f:array<string>>>"
    )
    flat = nested.flatten(df)
    assert flat.columns == ["a", "b.c", "b.d.e", "b.d.f"]
    assert [tuple(r) for r in flat.collect()] == [(1, 2, 3, ["x"])]
    assert nested.flatten(df, "_").columns == ["a", "b_c", "b_d_e", "b_d_f"]


def test_explode_keeps_empty_lists_on_demand(spark):
    df = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None)], "k int, payload array<int>")
    assert [tuple(r) for r in nested.explode_records(df).orderBy("k", "record_pos").collect()] == [
        (1, 0, 10), (1, 1, 20),
    ]
    kept = nested.explode_records(df, keep_empty=True).orderBy("k", "record_pos").collect()
    assert [tuple(r) for r in kept] == [(1, 0, 10), (1, 1, 20), (2, None, None), (3, None, None)]


def test_first_rows_of_repeated_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, l string").repartition(4)
    marked = {r.i: r.is_first for r in nested.mark_first(df, ["k", "l"], ["i"]).collect()}
    seen, expected = set(), {}
    for i, *key in rows:
        expected[i] = tuple(key) not in seen
        seen.add(tuple(key))
    assert marked == expected


def test_repeats_vector(spark):
    df = spark.createDataFrame(list(enumerate("aaba")), "i int, k string")
    blank = nested.blank_where(nested.mark_first(df, ["k"], ["i"]), ~F.col("is_first"), ["k"])
    assert [r.k for r in blank.orderBy("i").collect()] == ["a", "", "b", ""]


def test_connections_sort_descending_with_missing_last(spark):
    def record(status, remote):
        return (remote, "6", status, "t", "false", "m", "p", "i")

    pages = frame(spark, "connections", [
        ("s", 0, 0, [record("connected", "r1"), record(None, "r9"), record("connected", "r2")]),
        ("s", 0, 1, [record("partial", None), record("partial", "r0")]),
        ("s", 1, 0, []),
    ])
    rows = detail.connection_detail(arrays(spark, [("s", 0, 0, "a"), ("s", 0, 1, "b")]), pages)
    ordered = rows.orderBy("site_pos", *detail.connection_order()).collect()
    assert [(r.status, r.remote_array) for r in ordered] == [
        ("partial", "r0"), ("partial", None), ("connected", "r2"), ("connected", "r1"),
        (None, "r9"),
    ]
    assert {r.local_array for r in ordered} == {"a"}


def test_links_sort_by_pod_bytes_and_raw_direction(spark):
    def record(pod_name, direction, lag=1500):
        return (pod_name, direction, ["r"], "rp", "replicating", 1726699453000, lag)

    pages = frame(spark, "links", [("s", 0, 0, [
        record("pod", "outbound"), record("pod", "inbound"), record("Pod", "outbound"),
        record(None, "inbound", None),
    ])])
    rows = detail.link_detail(arrays(spark, [("s", 0, 0, "a")]), pages)
    ordered = rows.orderBy("site_pos", *detail.link_order()).collect()
    assert [(r.local_pod_name, r.direction) for r in ordered] == [
        ("Pod", "outbound"), ("pod", "inbound"), ("pod", "outbound"), (None, "inbound"),
    ]
    assert [r.lag for r in ordered] == [1.5, 1.5, 1.5, None]
    assert ordered[0].recovery_point == "2024-09-18 15:44:13 PDT"
    shown = detail.with_labels(detail.with_marks(rows.select("direction", "status", "lag")))
    assert shown.columns == ["Direction", "Status", "Lag (seconds)"]
    assert {tuple(r)[:2] for r in shown.collect()} == {
        ("→", "\U0001F7E2 Replicating"), ("←", "\U0001F7E2 Replicating"),
    }


def pod_pages(spark):
    return frame(spark, "pods", [
        ("s", 0, 0, [pod("p", [member("m1"), member("m2", "offline", 1678409220000)])]),
        ("s", 0, 1, [pod("q", []), pod("p", [member("m3")])]),
        ("t", 0, 0, [pod("p", [member("m4"), member("m5")])]),
    ])


def test_pod_rows_blank_repeats_per_site(spark):
    inventory = arrays(spark, [("s", 0, 0, "a"), ("t", 1, 0, "a")])
    rows = detail.pod_detail(inventory, pod_pages(spark), ordered=True).collect()
    assert [(r.site, r.local_array, r.pod_name, r.promotion_status, r.name) for r in rows] == [
        ("s", "a", "p", "promoted", "m1"),
        ("s", "", "", "", "m2"),
        ("s", "a", "q", "promoted", None),
        ("s", "", "", "", "m3"),
        ("t", "a", "p", "promoted", "m4"),
        ("t", "", "", "", "m5"),
    ]
    assert [r.frozen_at for r in rows][1] == "2023-03-09 16:47:00 PST"


def test_pod_rows_restricted_to_stretched(spark):
    inventory = arrays(spark, [("s", 0, 0, "a"), ("t", 1, 0, "a")])
    rows = detail.pod_detail(
        inventory, pod_pages(spark), blank_repeats=False, stretched_only=True, ordered=True
    )
    assert [(r.pod_name, r.name) for r in rows.collect()] == [
        ("p", "m1"), ("p", "m2"), ("p", "m4"), ("p", "m5"),
    ]


def test_marks_spare_other_columns_unless_asked(spark):
    df = spark.createDataFrame([("online", "online"), ("Online", "connected")], "array string, status string")
    green = "\U0001F7E2 online"
    assert [tuple(r) for r in detail.with_marks(df).collect()] == [
        ("online", green), ("Online", "connected"),
    ]
    assert [tuple(r) for r in detail.with_marks(df, columns=None).collect()] == [
        (green, green), ("Online", "connected"),
    ]


def test_capacity_edge_cases(spark):
    capacity = spark.createDataFrame(
        [("s", 0, (0, 1024, 1.0)), ("s", 1, (2048, 0, 1.65)), ("s", 2, (None, 10, None))],
        "site string, array_pos bigint, space struct<total:bigint,capacity:bigint,data_reduction:double>",
    )
    inventory = arrays(spark, [("s", 0, i, f"a{i}") for i in range(4)])
    rows = detail.capacity_detail(inventory, capacity).orderBy("array_pos").collect()
    assert [(r.drr, r.percent_full, r.space_used, r.space_remaining, r.total_usable) for r in rows] == [
        ("1.0:1", "0.0%", "0B", "1.0 KB", "1.0 KB"),
        ("1.6:1", "N/A", "2.0 KB", "-2.0 KB", "0B"),
        ("N/A", "N/A", "N/A", "N/A", "10.0 B"),
        ("N/A", "N/A", "N/A", "N/A", "N/A"),
    ]


def test_childless_parents_are_kept(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    children = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, c int")
    joined = join_keeping_childless(parents, children, ["k"])
    assert {tuple(r) for r in joined.collect()} == {(1, "a", 10), (1, "a", 11), (2, "b", None)}


def test_a_stored_inventory_is_broadcast_by_its_size(spark, tmp_path):
    path = str(tmp_path / "arrays")
    arrays(spark, [("s", 0, i, f"a{i}") for i in range(50)]).write.parquet(path)
    pages = spark.range(1000).selectExpr("'s' AS site", "id % 50 AS array_pos", "id AS page", "id AS x")
    joined = detail._of_arrays(spark.read.parquet(path), pages, ("site", "array_pos"))
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Limit" not in plan
    assert joined.count() == 1000
