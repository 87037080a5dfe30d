"""Saved reports: writing, retention, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replipulse.functions.text import epoch_micros
from replipulse.model import RETENTION_DAYS


SHARED = "spark.checkpoint.dir"
#: Rows that a task gets to sort.
TASK_ROWS = 1 << 17


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    A cluster has to name one, as executors do not see each other's folders. A session
    within one process may leave it out and gets a temporary folder, which all its tasks see.
    """
    shared = spark.conf.get(SHARED, None)
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SHARED} to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="replipulse-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    For a result that several branches of one plan need: it is computed once, and
    a lost executor costs no more than reading it again.
    """
    path = working_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """Rows dealt to tasks by ranges of ``order``, so many tasks that a task can sort its rows in memory.

    ``rows`` tells how many there are. The order should end in a place, so that no range is one key.
    """
    return df.repartitionByRange(max(2, 1 + rows // TASK_ROWS), *order)


def save_sections(sections: DataFrame, path: str, run_date: str) -> None:
    """Store one run's report rows. Storing the same run again replaces it.

    Files are small, so that a task that reads and deals them holds few rows.
    """
    (
        sections.withColumn("run_date", F.lit(run_date).cast("date"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", TASK_ROWS)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def save_runs(history: DataFrame, path: str, when: str) -> None:
    """Store polls or reports of many runs, a folder for each date."""
    history.withColumn("run_date", F.col(when).cast("date")).write.partitionBy("run_date").parquet(path)


def read_run(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """One saved run; other dates' folders are not opened."""
    return spark.read.parquet(path).filter(F.col("run_date") == F.lit(run_date).cast("date"))


def save_html(lines: DataFrame, path: str) -> None:
    """Write ordered lines as text files; read in name order they are the document."""
    lines.select("html").write.mode("overwrite").text(path)


def age_days(moment_ntz: Column, now_ntz: Column) -> Column:
    """Whole days between two times, partial days cut."""
    micros = epoch_micros(now_ntz) - epoch_micros(moment_ntz)
    return F.floor(micros / 86_400_000_000)


def retained(
    history: DataFrame, when: str, now: Column, days: int = RETENTION_DAYS
) -> DataFrame:
    """Rows whose age in whole days does not exceed the limit.

    Written as a bound on the stored column, so it reaches the file scan; a
    ``run_date`` partition column is bounded too, so old folders are not opened.
    """
    bound = F.timestamp_add("DAY", F.lit(-(days + 1)), now)
    young = history.filter(F.col(when) > bound)
    if "run_date" in history.columns:
        young = young.filter(F.col("run_date") >= bound.cast("date"))
    return young
