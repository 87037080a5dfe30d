"""Physical plans: what scans read, what joins do with hot keys, what must not occur."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from replipulse.model import LANDED
from replipulse.operators import detail, nested, status
from replipulse.plans import report
from replipulse.plans.catalog import QUERIES
from replipulse.sources import store
from replipulse.sources.landed import read_landed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(df):
    """Read schemas of all scans, without the shortening of printed plans."""
    found = []

    def visit(node):
        if "FileSourceScanExec" in node.getClass().getName():
            found.append(node.requiredSchema().catalogString())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().sparkPlan())
    return found


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    def table(kind):
        path = str(tmp_path_factory.mktemp(kind))
        spark.createDataFrame([], LANDED[kind]).write.mode("overwrite").parquet(path)
        return read_landed(spark, kind, path)

    return table


def test_status_reads_only_the_status_field(landed):
    health = status.connection_health(landed("connections"))
    assert read_schemas(health) == [
        "struct<site:string,array_pos:bigint,payload:array<struct<status:string>>>"
    ]
    assert read_schemas(status.link_health(landed("links"))) == [
        "struct<site:string,array_pos:bigint,payload:array<struct<status:string>>>"
    ]
    (pods,) = read_schemas(status.pod_health(landed("pods")))
    assert "promotion_status" not in pods and "link_source_count" not in pods


def test_details_leave_bookkeeping_fields_unread(landed):
    arrays = landed("inventory").withColumn("version", F.lit("6"))
    schemas = read_schemas(detail.connection_detail(arrays, landed("connections")))
    assert any("replication_address" in s for s in schemas)
    assert not any(re.search(r"\bid:", s) for s in schemas)
    for schema in read_schemas(detail.pod_detail(arrays, landed("pods"))):
        assert "requested_promotion_state" not in schema and "source:" not in schema


@pytest.fixture
def stored(monkeypatch):
    """Every table that is written on the way, batches of streams included."""
    tables = []
    write = DataFrameWriter.parquet

    def recorded(writer, path, *rest, **options):
        tables.append(writer._df)
        return write(writer, path, *rest, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return tables


def test_blanking_reads_no_members_for_the_first_places(landed, stored):
    arrays = landed("inventory").withColumn("version", F.lit("6"))
    final = detail.pod_detail(arrays, landed("pods"))
    schemas = [s for df in (*stored, final) for s in read_schemas(df) if "payload" in s]
    assert sum("mediator_status" in s for s in schemas) == 1
    assert len(schemas) == 1  # payloads are worked out once, whatever reads the pods later
    lookups = [s for df in stored for s in read_schemas(df) if "record_pos" in s]
    assert lookups and not any("members" in s for s in lookups)


def test_sorted_details_work_their_payload_out_once(landed, stored):
    arrays = landed("inventory").withColumn("version", F.lit("6"))
    for rows in (detail.connection_detail, detail.link_detail, detail.pod_detail):
        stored.clear()
        final = rows(arrays, landed({"connection_detail": "connections", "link_detail": "links"}.get(rows.__name__, "pods")), ordered=True)
        assert not any("payload" in s for s in read_schemas(final))
        assert sum("payload" in s for df in stored for s in read_schemas(df)) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_distributed(spark, sf_dir, name, stored):
    final = QUERIES[name](spark, sf_dir)
    for df in (*stored, final):
        plan = plan_of(df)
        for operator in ("Python", "CartesianProduct", "NestedLoop", "Window [", "Window(",
                         "collect_list", "CollectLimit", "GlobalLimit", "SortAggregate"):
            assert operator not in plan, operator


@pytest.mark.parametrize("name", ["report_sections", "saved_report", "html_tables"])
def test_the_report_is_sorted_once(spark, sf_dir, name, stored):
    final = QUERIES[name](spark, sf_dir)
    assert sum(plan_of(df).count("rangepartitioning(") for df in (*stored, final)) == 1


def exchanges(df):
    """Kind and column names of every exchange in a plan."""
    found = []

    def visit(node):
        if "ShuffleExchangeExec" in node.getClass().getName():
            output = node.output()
            found.append((node.outputPartitioning().toString(), {output.apply(i).name() for i in range(output.size())}))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    visit(plan.initialPlan() if "AdaptiveSparkPlanExec" in plan.getClass().getName() else plan)
    return found


@pytest.fixture
def no_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["report_sections", "saved_report", "html_tables"])
def test_pages_stay_where_they_are_in_the_report(spark, sf_dir, name, stored, no_broadcasts):
    final = QUERIES[name](spark, sf_dir)
    assert not any("payload" in columns for df in (*stored, final) for _, columns in exchanges(df))


@pytest.mark.parametrize("name", ["report_sections", "saved_report", "html_tables"])
def test_members_are_stored_once_and_texts_move_as_one(spark, sf_dir, name, stored):
    final = QUERIES[name](spark, sf_dir)
    assert sum("mediator_status" in df.schema.simpleString() for df in stored) == 1
    (moved,) = [columns for df in (*stored, final) for kind, columns in exchanges(df) if "rangepartitioning" in kind]
    assert "text" in moved and not moved & {"cells", "members", "pod", "connection", "link", "_members"}


def test_numbering_stores_what_is_shown(spark, sf_dir, stored):
    final = QUERIES["saved_report"](spark, sf_dir)
    last = stored[-1].columns
    assert set(last) - {"_task"} == set(final.columns) - {"position"}


@pytest.fixture
def small_partitions(spark):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot_pages(spark):
    """Pages of 64 arrays; one of them holds a third of all pages."""
    return spark.range(0, 30000, 1, 6).selectExpr(
        "'s' AS site",
        "if(id % 3 = 0, 7L, id % 64) AS array_pos",
        "id AS page",
        "array(named_struct('name', 'p', 'promotion_status', string(id), 'arrays', "
        "array(named_struct('name', string(hash(id)), 'status', 'online', "
        "'mediator_status', 'online', 'frozen_at', 0L)))) AS payload",
    )


def test_a_hot_array_is_split_in_the_inventory_join(spark, small_partitions):
    arrays = spark.range(64).selectExpr(
        "'s' AS site", "0 AS site_pos", "id AS array_pos", "string(id) AS array", "'6' AS version"
    )
    rows = detail.pod_detail(arrays, hot_pages(spark), blank_repeats=False)
    assert len(rows.collect()) == 30000
    assert "skew=true" in plan_of(rows)


def test_a_hot_key_is_split_in_the_lookup_of_first_rows(spark, small_partitions):
    df = hot_pages(spark).select("array_pos", "page", F.sha2(F.col("page").cast("string"), 256).alias("x"))
    marked = nested.mark_first(df, ["array_pos"], ["page"])
    rows = marked.collect()
    assert "skew=true" in plan_of(marked)
    assert len(rows) == 30000
    firsts = [r for r in rows if r.is_first]
    assert len(firsts) == len({r.array_pos for r in firsts}) == 64


def test_packed_places_keep_their_order_and_refuse_what_does_not_fit(spark):
    rows = [(a, b) for a in (0, 1, 999) for b in (0, 7, 2**63 - 1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    place = nested.packed(["a", "b"], [3, 19], last=F.lit(1))
    got = [tuple(r) for r in df.orderBy(place).collect()]
    assert got == sorted(rows)
    for bad in ((1000, 0), (-1, 0), (0, -1)):
        wrong = spark.createDataFrame([bad], "a bigint, b bigint").select(place.alias("p"))
        with pytest.raises(Exception, match="whole number"):
            wrong.collect()
    with pytest.raises(ValueError):
        nested.packed(["a", "b"], [19, 20])


def test_first_rows_of_null_and_tied_keys(spark):
    rows = [(None, "x", 3, 1), (None, "x", 2, 9), (None, "x", 2, 4), ("", "x", 5, 0), ("1:", "", 1, 1),
            ("a", None, 1, 1), ("a", None, 1, 1), ("-", "-", 1, 1)]
    df = spark.createDataFrame(rows, "k string, l string, a bigint, b bigint")
    got = nested.mark_first(df, ["k", "l"], ["a", "b"])
    first = sorted((tuple(r)[:4] for r in got.collect() if r.is_first), key=repr)
    assert first == sorted([(None, "x", 2, 4), ("", "x", 5, 0), ("1:", "", 1, 1), ("a", None, 1, 1),
                            ("a", None, 1, 1), ("-", "-", 1, 1)], key=repr)
    assert got.count() == len(rows)


def test_rows_of_keys_that_occur_once_are_not_moved_for_the_lookup(spark, small_partitions, monkeypatch):
    rows = spark.range(4000).selectExpr("string(if(id % 500 = 3, 0, id)) AS k", "id AS a", "id AS b", "id AS c", "sha2(string(id), 256) AS x")
    marked = nested.mark_first(rows, ["k"], ["a", "b", "c"])
    plan = plan_of(marked)
    assert re.search(r"BroadcastHashJoin.*LeftAnti", plan) and re.search(r"BroadcastHashJoin.*LeftSemi", plan)
    got = sorted(tuple(r) for r in marked.collect())
    assert [r[1] for r in got if not r[-1]] == [3 + 500 * i for i in range(8)]
    monkeypatch.setattr(nested, "BROADCAST_HASHES", 0)
    looked_up = nested.mark_first(rows, ["k"], ["a", "b", "c"])
    assert "LeftAnti" not in plan_of(looked_up)
    assert sorted(tuple(r) for r in looked_up.collect()) == got


def test_numbering_moves_no_rows(spark):
    numbered = report.numbered(spark.range(1000).repartition(7).orderBy(F.desc("id")))
    assert "hashpartitioning" not in plan_of(numbered)
    assert {r.position + r.id for r in numbered.collect()} == {1000}


def test_large_sorts_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    df = spark.range(1000).repartition(3)
    dealt = store.in_ranges(df, [F.asc("id")], 1000).sortWithinPartitions("id")
    assert dealt.rdd.getNumPartitions() == 11
    assert [r.id for r in dealt.collect()] == list(range(1000))
