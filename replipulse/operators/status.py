"""Status per array and per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replipulse.functions.health import (
    any_other_than,
    empty_connections_word,
    list_status,
    rolled_up,
)
from replipulse.model import (
    ARRAY_KEY,
    CONNECTION_HEALTHY,
    LINK_HEALTHY,
    MEMBER_HEALTHY,
    NOT_AVAILABLE,
    OKAY,
    PAGE_ORDER,
    WARNING,
)
from replipulse.operators.nested import explode_records, packed

STATUS_COLUMNS = ("connections", "async_links", "sync_pods")
#: Digits of a page number and of a pod's place in its page.
PLACE_DIGITS = (19, 10)


def page_verdicts(pages: DataFrame, healthy: str, key: Sequence[str] = ARRAY_KEY) -> DataFrame:
    """Each page, stored or streamed, reduced where it is read: ``records`` and ``bad``.

    Only the status field of the payload is read.
    """
    words = F.col("payload.status")
    return pages.select(
        *key, F.size(words).alias("records"), any_other_than(words, healthy).alias("bad")
    )


def list_health(verdicts: DataFrame, key: Sequence[str] = ARRAY_KEY) -> DataFrame:
    """Key, ``records`` and ``bad`` of every array, from verdicts of stored or streamed pages.

    A combining aggregation: a hot array costs nothing. Of a stream, this is the state.
    """
    return verdicts.groupBy(*key).agg(F.sum("records").alias("records"), F.max("bad").alias("bad"))


def connection_words(
    health: DataFrame, key: Sequence[str] = ARRAY_KEY, empty_as_na: bool = False
) -> DataFrame:
    """Key and ``connections`` from the health of connection lists."""
    status = list_status(F.col("records"), F.col("bad"), empty_connections_word(empty_as_na))
    return health.select(*key, status.alias("connections"))


def link_words(health: DataFrame, key: Sequence[str] = ARRAY_KEY) -> DataFrame:
    """Key and ``async_links`` from the health of link lists."""
    status = list_status(F.col("records"), F.col("bad"), NOT_AVAILABLE)
    return health.select(*key, status.alias("async_links"))


def connection_health(
    pages: DataFrame, key: Sequence[str] = ARRAY_KEY, empty_as_na: bool = False
) -> DataFrame:
    """One row per array that landed connection pages: key and ``connections``."""
    return connection_words(list_health(page_verdicts(pages, CONNECTION_HEALTHY, key), key), key, empty_as_na)


def link_health(pages: DataFrame, key: Sequence[str] = ARRAY_KEY) -> DataFrame:
    """One row per array that landed link pages: key and ``async_links``."""
    return link_words(list_health(page_verdicts(pages, LINK_HEALTHY, key), key), key)


def pod_members(
    pages: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    fields: Sequence[str] = (),
) -> DataFrame:
    """One row per pod: how many members it has and whether one is not online.

    ``fields`` names further fields of the pod to keep.
    """
    pods = explode_records(
        pages.select(*key, *order, "payload"), "payload", "pod_pos", "pod", (*fields, "arrays")
    )
    words = F.col("pod.arrays.status")
    return pods.select(
        *key,
        *order,
        "pod_pos",
        *[f"pod.{field}" for field in fields],
        F.size(words).alias("members"),
        any_other_than(words, MEMBER_HEALTHY).alias("bad"),
    )


def stretched_pods(
    pages: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    fields: Sequence[str] = (),
) -> DataFrame:
    """Pods that live on more than one array."""
    return pod_members(pages, key, order, fields).filter("members > 1")


def pod_health(
    pages: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    rule: str = "last",
    digits: Sequence[int] = PLACE_DIGITS,
) -> DataFrame:
    """One row per array that landed stretched pods: key and ``sync_pods``."""
    return pod_status(stretched_pods(pages, key, order), key, order, rule, digits)


def pod_status(
    pods: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    rule: str = "last",
    digits: Sequence[int] = PLACE_DIGITS,
) -> DataFrame:
    """Key and ``sync_pods`` of every array with stretched pods; see ``pod_verdict``."""
    return pod_words(pod_verdict(pods, key, order, rule, digits), key, rule)


def pod_verdict(
    pods: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    rule: str = "last",
    digits: Sequence[int] = PLACE_DIGITS,
) -> DataFrame:
    """Key and ``verdict`` of every array, from its stretched pods, stored or streamed.

    ``rule='last'``: the last stretched pod decides (of pods at one and the same
    place, an unhealthy one does). ``rule='any'``: one unhealthy pod is enough.
    Place and verdict are one number, so the last one comes from a hash aggregation;
    ``digits`` are those of the order columns and of the pod's place in its page. Of a
    stream, the largest number is the state.
    """
    if rule not in ("last", "any"):
        raise ValueError(f"unknown pod rule: {rule}")
    place = packed([*order, "pod_pos"], digits, last=F.col("bad").cast("int")) if rule == "last" else F.col("bad")
    return pods.groupBy(*key).agg(F.max(place).alias("verdict"))


def pod_words(verdict: DataFrame, key: Sequence[str] = ARRAY_KEY, rule: str = "last") -> DataFrame:
    """Key and ``sync_pods`` from the verdicts of stretched pods."""
    warn = F.col("verdict") % 10 == 1 if rule == "last" else F.col("verdict")
    return verdict.select(*key, F.when(warn, F.lit(WARNING)).otherwise(F.lit(OKAY)).alias("sync_pods"))


def with_status(
    inventory: DataFrame, health: DataFrame, key: Sequence[str] = ARRAY_KEY
) -> DataFrame:
    """Attach statuses to the inventory; arrays without one show N/A.

    Where the inventory has a column of a status's name, what it sets shows instead of N/A.
    The right side is one narrow row per array, whatever the payloads held.
    """
    added = [c for c in health.columns if c not in key]
    seeds = {c: f"_set_{c}" for c in added if c in inventory.columns}
    joined = inventory.withColumnsRenamed(seeds).join(health, list(key), "left")
    shown = {
        c: F.coalesce(F.col(c), *[F.col(seeds[c])] if c in seeds else [], F.lit(NOT_AVAILABLE)) for c in added
    }
    return joined.withColumns(shown).drop(*seeds.values())


def array_status(
    inventory: DataFrame,
    connections: DataFrame,
    links: DataFrame,
    pods: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    order: Sequence[str] = PAGE_ORDER,
    pod_rule: str = "last",
    empty_as_na: bool = False,
    digits: Sequence[int] = PLACE_DIGITS,
) -> DataFrame:
    """The inventory with the three statuses of every array."""
    healths = (
        connection_health(connections, key, empty_as_na),
        link_health(links, key),
        pod_health(pods, key, order, pod_rule, digits),
    )
    return with_statuses(inventory, healths, key)


def with_statuses(
    inventory: DataFrame, healths: Sequence[DataFrame], key: Sequence[str] = ARRAY_KEY
) -> DataFrame:
    for health in healths:
        inventory = with_status(inventory, health, key)
    return inventory


def site_summary(sites: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per configured site; all three statuses roll up in one aggregation."""
    per_site = statuses.groupBy("site").agg(
        *[rolled_up(F.col(c)).alias(c) for c in STATUS_COLUMNS]
    )
    summary = sites.select("site_pos", "site").join(per_site, "site", "left")
    return summary.select(
        "site_pos",
        "site",
        *[F.coalesce(F.col(c), F.lit(NOT_AVAILABLE)).alias(c) for c in STATUS_COLUMNS],
    )


def problem_sites(summary: DataFrame) -> DataFrame:
    """Sites where any of the three statuses is Warning."""
    connections, links, pods = [F.col(c) == WARNING for c in STATUS_COLUMNS]
    return summary.filter(connections | links | pods)


def with_version(
    inventory: DataFrame,
    identity: DataFrame,
    key: Sequence[str] = ARRAY_KEY,
    rule: str = "per_array",
) -> DataFrame:
    """Attach the software version: each array's own, or its site's last array's.

    The site rule aggregates to one row per site and joins back, where a window
    would pull a whole site into one task.
    """
    if rule not in ("per_array", "last_in_site"):
        raise ValueError(f"unknown version rule: {rule}")
    own = inventory.join(identity.select(*key, "version"), list(key), "left")
    if rule == "per_array":
        return own
    last = own.groupBy("site").agg(F.max("array_pos").alias("array_pos"))
    versions = own.join(last, ["site", "array_pos"]).select("site", "version")
    return inventory.join(versions, "site", "left")
