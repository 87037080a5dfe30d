"""Landed polls: readers, inventory forms, and the current state of a history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replipulse.model import ARRAY_KEY, LANDED


def read_landed(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed table with its fixed schema; fields the files lack are NULL."""
    return spark.read.schema(LANDED[kind]).format(fmt).load(path)


def stream_landed(
    spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """The same table as a stream of newly landed files."""
    return spark.readStream.schema(LANDED[kind]).format(fmt).options(**options).load(path)


def parse_payload(df: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """Parse a payload that landed as JSON text into the typed list of its kind."""
    schema = T.StructType.fromDDL(LANDED[kind])["payload"].dataType
    return df.withColumn(column, F.from_json(column, schema))


def inventory_from_sites(df: DataFrame, column: str = "sites") -> DataFrame:
    """Unpack ``map<site, array<struct<array, mgmt_ip>>>`` into one row per array.

    Sites and arrays keep their configured order; a site with an empty list keeps
    one row without an array.
    """
    sites = df.select(F.posexplode(F.map_entries(column)).alias("site_pos", "entry"))
    arrays = sites.select(
        F.col("entry.key").alias("site"),
        "site_pos",
        F.posexplode_outer("entry.value").alias("array_pos", "item"),
    )
    return arrays.select(
        "site", "site_pos", F.col("array_pos").cast("bigint").alias("array_pos"),
        "item.array", "item.mgmt_ip",
    )


def latest_snapshot(
    history: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    when: str = "run_ts",
    since: str | None = None,
) -> DataFrame:
    """The newest poll of every array, with all of its pages.

    The newest time per key comes from a narrow aggregation that combines before
    the shuffle. No array needs anything older than the oldest of these times, so
    that bound goes to the scan, and payloads move at most once, in the semi join.
    Where polls are stored by ``run_date``, the bound holds for the folders too. An array
    that retired long ago lowers the bound to its last poll; ``since``, a date, leaves out
    what is older, and arrays without a poll since then.
    """
    if since is not None:
        history = history.filter(F.col(when) >= F.lit(since).cast("date"))
        if "run_date" in history.columns:
            history = history.filter(F.col("run_date") >= F.lit(since).cast("date"))
    newest = history.groupBy(*key).agg(F.max(when).alias(when))
    oldest_needed = newest.agg(F.min(when)).scalar()
    recent = history.filter(F.col(when) >= oldest_needed)
    if "run_date" in history.columns:
        oldest_day = newest.agg(F.min(F.col(when).cast("date"))).scalar()
        recent = recent.filter(F.col("run_date") >= oldest_day)
    return recent.join(newest, [*key, when], "left_semi")
