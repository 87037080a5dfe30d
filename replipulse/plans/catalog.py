"""Registered queries: every operator over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replipulse.functions import text
from replipulse.model import (
    CAPACITY_COLUMNS,
    CONNECTION_COLUMNS,
    LINK_COLUMNS,
    NOT_AVAILABLE,
    POD_COLUMNS,
    SUMMARY_COLUMNS,
)
from replipulse.operators import detail, nested, status
from replipulse.plans import report
from replipulse.plans.testbed import KEY, PAGE, POD_DIGITS, POD_PAGE, POD_PLACE, Testbed
from replipulse.sources import landed
from replipulse.sources.store import (
    age_days,
    kept,
    read_run,
    retained,
    save_runs,
    save_sections,
    working_folder,
)
from replipulse.streaming.live import (
    instant,
    rollup_stream,
    run_available,
    status_available,
    volume_stream,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RETENTION_NOW = "2024-01-31 00:00:00"
RUN_DATE, RUN_MS = "2024-01-31", 1_706_659_200_000


def registered(query: Callable[[Testbed], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Testbed(spark, sf_dir))

    run.__name__ = query.__name__
    QUERIES[query.__name__] = run
    return run


# --- sources -----------------------------------------------------------------


@registered
def inventory(bed: Testbed) -> DataFrame:
    return bed.inventory().select("site", "site_pos", "array_pos", "array", "mgmt_ip")


@registered
def version_per_array(bed: Testbed) -> DataFrame:
    arrays = bed.inventory().select("site", "array_pos", "array")
    return status.with_version(arrays, bed.identity(), KEY)


@registered
def version_last_in_site(bed: Testbed) -> DataFrame:
    arrays = bed.inventory().select("site", "array_pos", "array")
    return status.with_version(arrays, bed.identity(), KEY, "last_in_site")


@registered
def latest_snapshot(bed: Testbed) -> DataFrame:
    newest = landed.latest_snapshot(bed.history(), KEY)
    return newest.select(
        "array_pos", "event_id", text.epoch_micros(F.col("run_ts")).alias("run_us"), "status"
    )


@registered
def json_flatten(bed: Testbed) -> DataFrame:
    parsed = bed.history().select(
        "event_id", F.struct("array_pos", F.from_json("props", "k int").alias("props")).alias("poll")
    )
    return nested.flatten(parsed)


@registered
def nested_inventory(bed: Testbed) -> DataFrame:
    """Configurations as they are written: a map of sites, one of them without arrays."""
    entry = "named_struct('array', {}, 'mgmt_ip', concat_ws('.', '10.0', s_suppkey div 256 % 256, s_suppkey % 256))"
    configured = bed.table("supplier").join(bed.sites(), F.col("site_pos") == F.col("s_nationkey")).selectExpr(
        f"""map(site, array({entry.format("s_name")}, {entry.format("concat(s_name, '-b')")}),
                concat(site, ' spare ', s_suppkey), array()) AS sites"""
    )
    return landed.inventory_from_sites(configured)


@registered
def payload_from_json(bed: Testbed) -> DataFrame:
    """Connection pages that landed as JSON text."""
    pages = bed.connections().withColumn("payload", F.to_json("payload"))
    records = nested.explode_records(
        landed.parse_payload(pages, "connections"), fields=("array_name", "version", "status", "throttled", "id")
    )
    return records.select("array_pos", "page", "record.*")


# --- status ------------------------------------------------------------------


def _connections(bed: Testbed) -> DataFrame:
    return bed.connections(("status",))


def _links(bed: Testbed) -> DataFrame:
    return bed.links(("status",))


def _pods(bed: Testbed) -> DataFrame:
    return bed.pods(("arrays",), ("status",))


def _statuses(bed: Testbed, pod_rule: str = "last") -> DataFrame:
    return status.array_status(
        bed.arrays(), _connections(bed), _links(bed), _pods(bed), KEY, POD_PAGE, pod_rule,
        digits=POD_DIGITS,
    )


def _array_view(bed: Testbed, health: DataFrame) -> DataFrame:
    return status.with_status(bed.arrays(), health, KEY).select(
        "site", "array_pos", "array", *[c for c in health.columns if c not in KEY]
    )


@registered
def connection_status(bed: Testbed) -> DataFrame:
    return _array_view(bed, status.connection_health(_connections(bed), KEY))


@registered
def connection_status_empty_as_na(bed: Testbed) -> DataFrame:
    return _array_view(bed, status.connection_health(_connections(bed), KEY, empty_as_na=True))


@registered
def link_status(bed: Testbed) -> DataFrame:
    return _array_view(bed, status.link_health(_links(bed), KEY))


@registered
def stretched_pods(bed: Testbed) -> DataFrame:
    pages = bed.pods(("name", "arrays"), ("status",))
    return status.stretched_pods(pages, KEY, POD_PAGE, ("name",)).withColumnRenamed(
        "name", "pod_name"
    )


@registered
def pod_status_last(bed: Testbed) -> DataFrame:
    return _array_view(bed, status.pod_health(_pods(bed), KEY, POD_PAGE, "last", POD_DIGITS))


@registered
def pod_status_any(bed: Testbed) -> DataFrame:
    return _array_view(bed, status.pod_health(_pods(bed), KEY, POD_PAGE, "any"))


@registered
def site_summary(bed: Testbed) -> DataFrame:
    return status.site_summary(bed.sites(), _statuses(bed))


@registered
def site_summary_any_pod(bed: Testbed) -> DataFrame:
    return status.site_summary(bed.sites(), _statuses(bed, "any"))


@registered
def problem_sites(bed: Testbed) -> DataFrame:
    return status.problem_sites(status.site_summary(bed.sites(), _statuses(bed)))


@registered
def preset_fields(bed: Testbed) -> DataFrame:
    """Fields that the configuration sets show where nothing landed."""
    arrays = bed.preset_arrays()
    health = status.connection_health(_connections(bed), KEY)
    answered = bed.capacity().filter("array_pos % 3 <> 1")
    rows = detail.capacity_detail(arrays, answered, KEY)
    shown = status.with_status(arrays.select("array_pos", "connections"), health, KEY)
    return rows.join(shown, "array_pos").select("site", "array_pos", "array", "connections", *CAPACITY_COLUMNS[2:])


@registered
def summary_display(bed: Testbed) -> DataFrame:
    summary = status.site_summary(bed.sites(), _statuses(bed)).select(*SUMMARY_COLUMNS)
    return detail.with_labels(detail.with_marks(summary))


# --- capacity and details ----------------------------------------------------


@registered
def capacity_metrics(bed: Testbed) -> DataFrame:
    return detail.capacity_metrics(bed.capacity())


@registered
def capacity_display(bed: Testbed) -> DataFrame:
    rows = detail.capacity_detail(bed.arrays(), bed.capacity(), KEY)
    ordered = rows.orderBy("site_pos", "array_pos")
    return ordered.select("site", "array_pos", *CAPACITY_COLUMNS)


def _arrays(bed: Testbed) -> DataFrame:
    """The inventory, stored: of a stored table Spark knows the size."""
    return kept(bed.arrays(), "arrays")


def _connection_rows(bed: Testbed) -> DataFrame:
    return detail.connection_detail(_arrays(bed), bed.connections(), KEY, PAGE, ordered=True)


@registered
def connection_detail(bed: Testbed) -> DataFrame:
    return _connection_rows(bed).select("site", *CONNECTION_COLUMNS)


@registered
def connection_display(bed: Testbed) -> DataFrame:
    rows = _connection_rows(bed).select(*CONNECTION_COLUMNS)
    return detail.with_labels(detail.with_marks(rows))


def _link_rows(bed: Testbed) -> DataFrame:
    return detail.link_detail(_arrays(bed), bed.links(), KEY, PAGE, ordered=True)


@registered
def link_detail(bed: Testbed) -> DataFrame:
    return _link_rows(bed).select("site", *LINK_COLUMNS)


@registered
def link_display(bed: Testbed) -> DataFrame:
    rows = _link_rows(bed).withColumn("lag", text.number_text(F.col("lag"))).select(*LINK_COLUMNS)
    return detail.with_labels(detail.with_marks(rows))


def _pod_rows(bed: Testbed, blank: bool) -> DataFrame:
    health = status.pod_health(_pods(bed), KEY, POD_PAGE, digits=POD_DIGITS)
    listed = status.with_status(bed.arrays(), health, KEY)
    arrays = kept(listed.filter(F.col("sync_pods") != NOT_AVAILABLE), "arrays-with-pods")
    return detail.pod_detail(
        arrays, bed.pods(), KEY, POD_PLACE, blank_repeats=blank, ordered=True
    )


@registered
def pod_detail(bed: Testbed) -> DataFrame:
    return _pod_rows(bed, blank=False).select("site", *POD_COLUMNS)


@registered
def blank_repeats(bed: Testbed) -> DataFrame:
    return _pod_rows(bed, blank=True).select("site", "array_pos", "page", *POD_COLUMNS)


@registered
def pod_display(bed: Testbed) -> DataFrame:
    rows = _pod_rows(bed, blank=True).select(*POD_COLUMNS)
    return detail.with_labels(detail.with_marks(rows))


# --- report ------------------------------------------------------------------


def _report(bed: Testbed) -> tuple[DataFrame, DataFrame]:
    statuses = kept(_statuses(bed), "statuses")
    summary = kept(status.site_summary(bed.sites(), statuses), "summary")
    sections = report.folded_sections(
        summary, statuses, bed.capacity(), bed.connections(), bed.links(), bed.pods(),
        KEY, PAGE, POD_PLACE, RUN_MS,
    )
    # The saved report, pods folded: sorting it samples stored rows, not the whole computation.
    folder = working_folder(bed.spark, "reports")
    save_sections(sections, folder, RUN_DATE)
    return summary, read_run(bed.spark, folder, RUN_DATE)


@registered
def report_sections(bed: Testbed) -> DataFrame:
    _, sections = _report(bed)
    return report.in_order(sections, sections.count()).select(
        *report.TABLE_KEY, report.headings().alias("heading"), F.array_join("cells", " | ").alias("cells")
    )


@registered
def saved_report(bed: Testbed) -> DataFrame:
    """A saved run, read back: every row with its number in the report."""
    _, sections = _report(bed)
    rows = report.in_order(sections, sections.count())
    # Numbering stores the rows: only what is shown of them.
    shown = rows.select(
        F.col("run_date").cast("string").alias("run_date"),
        *report.TABLE_KEY,
        F.array_join("cells", " | ").alias("cells"),
    )
    return report.numbered(shown).select("run_date", "position", *report.TABLE_KEY, "cells")


@registered
def html_tables(bed: Testbed) -> DataFrame:
    """The saved report as HTML."""
    summary, sections = _report(bed)
    return report.html_lines(summary, sections.drop("run_date"))


@registered
def retention(bed: Testbed) -> DataFrame:
    """Saved runs of many dates; folders of dates that are too old are not opened."""
    now = F.lit(RETENTION_NOW).cast("timestamp_ntz")
    folder = working_folder(bed.spark, "runs")
    save_runs(bed.history().select("event_id", "run_ts"), folder, "run_ts")
    saved = retained(bed.spark.read.parquet(folder), "run_ts", now)
    run_us = text.epoch_micros(F.col("run_ts"))
    run_ms = F.floor(run_us / 1000)
    return saved.select(
        "event_id",
        run_us.alias("run_us"),
        age_days(F.col("run_ts"), now).alias("age_days"),
        text.report_time_text(run_ms).alias("report_time"),
        text.report_file_stamp(run_ms).alias("file_stamp"),
    )


# --- streams -----------------------------------------------------------------


def _landing(bed: Testbed) -> DataFrame:
    events = bed.table("events")
    stream = bed.spark.readStream.schema(events.schema).parquet(f"{bed.sf_dir}/events.parquet*")
    return bed.polls(stream)


def _streamed(bed: Testbed, pages: DataFrame, kind: str) -> DataFrame:
    """Pages that land as files, read as a stream of them."""
    folder = working_folder(bed.spark, f"landed-{kind}")
    pages.write.parquet(folder)
    return bed.spark.readStream.schema(pages.schema).parquet(folder)


@registered
def stream_status(bed: Testbed) -> DataFrame:
    """Statuses from landed payload pages, kept up as pages land."""
    found = status_available(
        bed.arrays(),
        _streamed(bed, _connections(bed), "connections"),
        _streamed(bed, _links(bed), "links"),
        _streamed(bed, _pods(bed), "pods"),
        key=KEY, order=POD_PAGE, digits=POD_DIGITS,
    )
    return found.select("site", "array_pos", "array", *status.STATUS_COLUMNS)


@registered
def stream_rollup(bed: Testbed) -> DataFrame:
    polls = _landing(bed).select("array_pos", instant(F.col("run_ts")).alias("run_ts"), "status")
    rolled = rollup_stream(polls, bed.arrays(), ("status",), key=KEY)
    windows = run_available(rolled, "stream-rollup", key=("window", "site"))
    return windows.select(F.unix_micros("window.start").alias("window_start_us"), "site", "status")


@registered
def stream_volume(bed: Testbed) -> DataFrame:
    """What each array replicated per day."""
    polls = _landing(bed).select("array_pos", instant(F.col("run_ts")).alias("run_ts"), "bytes")
    windows = run_available(volume_stream(polls, key=KEY), "stream-volume", key=("window", *KEY))
    return windows.select(F.unix_micros("window.start").alias("window_start_us"), *KEY, "bytes")
