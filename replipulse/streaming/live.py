"""Status and roll-up of polls as they land."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replipulse.functions.health import rolled_up
from replipulse.functions.text import epoch_micros
from replipulse.model import ARRAY_KEY, CONNECTION_HEALTHY, LINK_HEALTHY, PAGE_ORDER
from replipulse.operators import status
from replipulse.sources.store import working_folder


def instant(moment_ntz: Column) -> Column:
    """A UTC timestamp without zone as the instant that watermarks need."""
    return F.timestamp_micros(epoch_micros(moment_ntz))


def rollup_stream(
    polls: DataFrame,
    inventory: DataFrame,
    status: Sequence[str],
    when: str = "run_ts",
    window: str = "24 hours",
    late: str = "1 hour",
    key: Sequence[str] = ARRAY_KEY,
) -> DataFrame:
    """Site roll-up per poll window.

    State is one row per site and open window. ``when`` must be an instant.
    """
    sites = inventory.select(*[c for c in key if c != "site"], "site")
    return (
        polls.withWatermark(when, late)
        .join(sites, list(key))
        .groupBy(F.window(when, window), "site")
        .agg(*[rolled_up(F.col(c)).alias(c) for c in status])
    )


def volume_stream(
    polls: DataFrame,
    amount: str = "bytes",
    when: str = "run_ts",
    window: str = "24 hours",
    late: str = "1 hour",
    key: Sequence[str] = ARRAY_KEY,
) -> DataFrame:
    """Sum of what was replicated per array and window."""
    return (
        polls.withWatermark(when, late)
        .groupBy(F.window(when, window), *key)
        .agg(F.sum(amount).alias(amount))
    )


def status_available(
    inventory: DataFrame,
    connections: DataFrame,
    links: DataFrame,
    pods: DataFrame,
    folder: str | None = None,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    pod_rule: str = "last",
    empty_as_na: bool = False,
    digits: Sequence[int] = status.PLACE_DIGITS,
) -> DataFrame:
    """The inventory with the statuses of all pages that three streams have landed so far.

    State is one narrow row per array and kind: records and whether one is bad, or the last
    stretched pod's place and verdict as one number. Pages are reduced where they are read.
    Given the same ``folder`` again, a run reads the files that are new and its state.
    """
    folder = folder or working_folder(inventory.sparkSession, "stream-status")
    states = (
        status.list_health(status.page_verdicts(connections, CONNECTION_HEALTHY, key), key),
        status.list_health(status.page_verdicts(links, LINK_HEALTHY, key), key),
        status.pod_verdict(status.stretched_pods(pods, key, order), key, order, pod_rule, digits),
    )
    kinds = ("connections", "links", "pods")
    found = [run_available(s, kind, f"{folder}/{kind}", key) for s, kind in zip(states, kinds)]
    healths = (
        status.connection_words(found[0], key, empty_as_na),
        status.link_words(found[1], key),
        status.pod_words(found[2], key, pod_rule),
    )
    return status.with_statuses(inventory, healths, key)


def run_available(
    stream: DataFrame,
    purpose: str,
    folder: str | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Process everything landed so far into files of the shared folder and read them.

    Each batch writes a folder of its own over what an earlier try of it left, so that a
    lost executor or driver neither loses nor repeats rows. A stream that aggregates gives
    the ``key`` of its rows: it runs in update mode, a batch writes the rows it changed,
    windows still open included, and the row of the latest batch holds. The state is
    bounded by the watermark. Give the same ``folder`` again to go on from there.
    """
    folder = folder or working_folder(stream.sparkSession, purpose)
    rows = f"{folder}/rows"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    save(stream.sparkSession.createDataFrame([], stream.schema), -1)  # if nothing has landed
    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("update" if key else "append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = stream.sparkSession.read.schema(schema).parquet(rows)
    if not key:
        return written.drop("batch")
    latest = written.groupBy(*key).agg(F.max("batch").alias("batch"))
    return written.join(latest, [*key, "batch"], "left_semi").drop("batch")
