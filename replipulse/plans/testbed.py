"""Landed tables derived from the TPC-H-like test tables.

Every row of a source table takes part. Nations are sites, suppliers are arrays.
Rows of the big tables become pages of polls, row by row and without a shuffle,
so the derived tables grow with their sources. Array numbers are quadratic
residues of a key modulo the number of suppliers: some arrays own several times
the average number of records and others none, as the status rules need.

``wanted`` fields leave out the rest of a record, as a scan of a landed table
would prune it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replipulse.operators.joins import join_keeping_childless

KEY = ("array_pos",)
PAGE = ("page",)
POD_PAGE = ("page", "part", "supp")
# Digits of these and of a pod's place in its page: up to scale 100,000 of the source.
POD_DIGITS = (13, 11, 10, 3)
# Rows of lineitem may repeat all of these; their place in the files settles ties.
POD_PLACE = (*POD_PAGE, "file", "file_row")

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _epoch_ms(moment: str) -> str:
    age = f"cast({moment} - {_EPOCH} AS interval second)"
    return f"bigint(cast({age} AS decimal(18, 3)) * 1000)"


def _record(fields: dict[str, str], wanted: Sequence[str] | None) -> str:
    pairs = ", ".join(f"'{name}', {fields[name]}" for name in wanted or fields)
    return f"named_struct({pairs})"


class Testbed:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def suppliers(self) -> int:
        return self.table("supplier").count()

    def array_number(self, key: str, shift: int) -> str:
        rest = f"({key} % {self.suppliers})"
        return f"({rest} * {rest} + {shift}) % {self.suppliers} AS array_pos"

    # F1
    def sites(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS site_pos", "n_name AS site")

    def identity(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS array_pos", "concat('6.', s_suppkey % 7) AS version"
        )

    def inventory(self) -> DataFrame:
        """One row per array; sites without arrays keep one row without an array."""
        arrays = self.table("supplier").selectExpr(
            "s_nationkey AS site_pos",
            "s_suppkey AS array_pos",
            "s_name AS array",
            "concat_ws('.', '10.0', s_suppkey div 256 % 256, s_suppkey % 256) AS mgmt_ip",
        )
        return join_keeping_childless(self.sites(), arrays, ["site_pos"])

    def arrays(self) -> DataFrame:
        """Configured arrays with their own version, without the empty sites."""
        arrays = self.table("supplier").selectExpr(
            "s_nationkey AS site_pos",
            "s_suppkey AS array_pos",
            "s_name AS array",
            "concat('6.', s_suppkey % 7) AS version",
        )
        return arrays.join(self.sites(), "site_pos")

    def preset_arrays(self) -> DataFrame:
        """Configured arrays, of which some set fields themselves."""
        return self.arrays().selectExpr(
            "*",
            "if(array_pos % 2 = 1, 'Okay', NULL) AS connections",
            "if(array_pos % 4 <> 2, '2.0:1', NULL) AS drr",
            "if(array_pos % 5 <> 3, '7.5%', NULL) AS percent_full",
        )

    # F2
    def capacity(self) -> DataFrame:
        per_array = (
            self.table("lineitem")
            .selectExpr(
                "l_suppkey AS array_pos",
                "bigint(l_quantity) AS size",
                "if(l_linestatus = 'F', bigint(l_quantity), 0L) AS used",
                "l_linenumber",
            )
            .groupBy("array_pos")
            .agg({"size": "sum", "used": "sum", "l_linenumber": "avg"})
        )
        unit = "CASE array_pos % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END"
        return per_array.selectExpr(
            "array_pos",
            f"""named_struct(
                'total', if(array_pos % 20 = 0, 0L, `sum(used)` * {unit}),
                'capacity', if(array_pos % 50 = 7, 0L, `sum(size)` * {unit}),
                'data_reduction', `avg(l_linenumber)`) AS space""",
        )

    # F3
    def connections(self, wanted: Sequence[str] | None = None) -> DataFrame:
        fields = {
            "array_name": "concat('remote-', l_partkey)",
            "version": "concat('6.', l_partkey % 7)",
            "status": """CASE
                WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 50
                     AND l_linenumber = 7 THEN 'partially_connected'
                WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity = 1
                     AND l_linenumber = 1 AND l_tax = 0 THEN NULL
                ELSE 'connected' END""",
            "type": "if(l_linestatus = 'F', 'async-replication', 'sync-replication')",
            "throttled": "if(l_tax > 0.05D, 'true', 'false')",
            "management_address": "concat('10.1.', l_partkey % 256)",
            "replication_address": "concat('10.2.', l_partkey % 256)",
            "id": "string(l_orderkey)",
        }
        record = _record(fields, wanted)
        pages = (
            self.table("lineitem")
            .selectExpr("*", self.array_number("l_suppkey", 0))
            .selectExpr("array_pos", "l_orderkey AS page", f"array({record}) AS payload")
        )
        # Of the arrays that own no page, every third answers, but knows no other array.
        suppliers = self.table("supplier")
        owners = suppliers.selectExpr(self.array_number("s_suppkey", 0)).distinct()
        silent = suppliers.selectExpr("s_suppkey AS array_pos").join(owners, "array_pos", "left_anti")
        nothing = F.array().cast(pages.schema["payload"].dataType).alias("payload")
        empty = silent.filter("array_pos % 3 = 0").select(
            "array_pos", F.lit(0).cast("bigint").alias("page"), nothing
        )
        return pages.unionByName(empty)

    # F4
    def links(self, wanted: Sequence[str] | None = None) -> DataFrame:
        def dated(phase: str, month: int, day: int) -> str:
            return (
                f"o_orderstatus = '{phase}' AND month(o_orderdate) = {month} "
                f"AND day(o_orderdate) = {day}"
            )

        def link(i: int) -> str:
            status = "'replicating'"
            if i == 4:
                status = f"""CASE WHEN {dated("P", 12, 31)} THEN 'unhealthy'
                    WHEN {dated("P", 7, 1)} THEN 'paused'
                    WHEN {dated("O", 1, 1)} THEN NULL ELSE 'replicating' END"""
            second = f", concat('remote-', o_custkey % 10 + {i})" if i >= 3 else ""
            stamp = f"{_epoch_ms('o_orderdate')} + o_orderkey % 86400000 + {i}"
            fields = {
                "local_pod_name": "concat('pod-', o_custkey)",
                "direction": "'inbound'" if i % 2 else "'outbound'",
                "remote_names": f"array(concat('remote-', o_custkey % 10){second})",
                "remote_pod_name": "concat('pod-', o_orderkey)",
                "status": status,
                "recovery_point": f"if(o_orderstatus = 'O', NULL, {stamp})" if i == 3 else stamp,
                "lag": f"o_orderkey % 100000 * 1730 + {i}",
            }
            return _record(fields, wanted)

        # The less urgent the order, the fewer links: four down to none.
        count = "5 - int(substring(o_orderpriority, 1, 1))"
        links = ", ".join(link(i) for i in range(1, 5))
        return self.table("orders").selectExpr(
            self.array_number("o_custkey", 1),
            "o_orderkey AS page",
            f"slice(array({links}), 1, {count}) AS payload",
        )

    # F5
    def pods(
        self,
        wanted: Sequence[str] | None = None,
        wanted_of_members: Sequence[str] | None = None,
    ) -> DataFrame:
        bad = "l_returnflag = 'R' AND array_pos % 3 <> 0"
        frozen = f"{_epoch_ms('l_shipdate')} + l_orderkey % 86400000"

        def member(i: int) -> str:
            troubled = {2: "offline", 3: "unknown"}.get(i)
            fields = {
                "name": f"concat('array-', l_suppkey + {i})",
                "status": f"if({bad}, '{troubled}', 'online')" if troubled else "'online'",
                "mediator_status": (
                    "CASE l_quantity WHEN 50 THEN 'unreachable' WHEN 49 THEN 'flummoxed' "
                    "ELSE 'online' END"
                ),
                "pre_elected": "'false'",
                "frozen_at": f"if({bad}, {frozen}, NULL)" if i == 2 else "bigint(NULL)",
            }
            return _record(fields, wanted_of_members)

        members = ", ".join(member(i) for i in range(1, 7))
        fields = {
            "name": "concat('pod-', l_orderkey)",
            "source": "string(NULL)",
            "promotion_status": "if(l_linestatus = 'F', 'promoted', 'demoted')",
            "requested_promotion_state": "'promoted'",
            "link_source_count": "0",
            "link_target_count": "0",
            "arrays": f"slice(array({members}), 1, l_linenumber - 1)",
        }
        return (
            self.table("lineitem")
            .selectExpr("*", self.array_number("l_suppkey", 2), "_metadata")
            .selectExpr(
                "array_pos",
                "l_orderkey * 8 + l_linenumber AS page",
                "l_partkey AS part",
                "l_suppkey AS supp",
                "shiftrightunsigned(xxhash64(_metadata.file_path), 1) AS file",
                "_metadata.row_index AS file_row",
                f"array({_record(fields, wanted)}) AS payload",
            )
        )

    # F6
    def history(self) -> DataFrame:
        return self.polls(self.table("events"))

    def polls(self, events: DataFrame) -> DataFrame:
        """Events, stored or streamed, as polls of arrays."""
        return events.selectExpr(
            "event_id",
            f"user_id % {self.suppliers} AS array_pos",
            "ts AS run_ts",
            "if(event_type = 'error', 'Warning', 'Okay') AS status",
            "bigint(round(value * 100)) AS bytes",
            "props",
        )
