"""Schemas of the landed tables, status words, and the texts of the report."""

from __future__ import annotations

# --- landed tables -----------------------------------------------------------
# One row is one page of a poll. An array's answer may be split over several
# pages, so no single row has to hold everything one array reports.

ARRAY_KEY = ("site", "array_pos")
PAGE_ORDER = ("page",)

LANDED = {
    "inventory": "site string, site_pos int, array_pos bigint, array string, mgmt_ip string",
    "identity": "site string, array_pos bigint, run_ts timestamp, version string",
    "capacity": (
        "site string, array_pos bigint, run_ts timestamp, "
        "space struct<total:bigint,capacity:bigint,data_reduction:double>"
    ),
    "connections": (
        "site string, array_pos bigint, run_ts timestamp, page bigint, "
        "payload array<struct<array_name:string,version:string,status:string,type:string,"
        "throttled:string,management_address:string,replication_address:string,id:string>>"
    ),
    "links": (
        "site string, array_pos bigint, run_ts timestamp, page bigint, "
        "payload array<struct<local_pod_name:string,direction:string,remote_names:array<string>,"
        "remote_pod_name:string,status:string,recovery_point:bigint,lag:bigint>>"
    ),
    "pods": (
        "site string, array_pos bigint, run_ts timestamp, page bigint, "
        "payload array<struct<name:string,source:string,promotion_status:string,"
        "requested_promotion_state:string,link_source_count:int,link_target_count:int,"
        "arrays:array<struct<name:string,status:string,mediator_status:string,"
        "pre_elected:string,frozen_at:bigint>>>>"
    ),
}

# --- fixed values ------------------------------------------------------------
# Words, units and display texts the report is defined by.

OKAY = "Okay"
WARNING = "Warning"
NOT_AVAILABLE = "N/A"
NONE_FOUND = "None found"

CONNECTION_HEALTHY = "connected"
LINK_HEALTHY = "replicating"
MEMBER_HEALTHY = "online"

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")

REPORT_ZONE = "America/Los_Angeles"
REPORT_ZONE_NAMES = {-8: "PST", -7: "PDT"}

RETENTION_DAYS = 14

REPORT_TIME_TITLE = "Report Generated:"
SUMMARY_TITLE = "Summary"
CAPACITY_TITLE = "{site} &mdash; Arrays"
PROBLEM_TITLE = "Problem Report &mdash; {site}"
DETAIL_TITLE = "Warning: {site} &mdash; {table}"
CONNECTIONS_TITLE = "Array Connections"
LINKS_TITLE = "Async Status"
PODS_TITLE = "Sync Status"

LABELS = {
    # summary
    "site": "Site Name",
    "connections": "Array Connections",
    "async_links": "Async Status",
    "sync_pods": "Sync Status",
    # capacity
    "array": "Array",
    "version": "OS Version",
    "drr": "DRR",
    "percent_full": "Percent Full",
    "space_used": "Used",
    "space_remaining": "Available",
    "total_usable": "Total Usable",
    # connections
    "local_array": "Local Array",
    "local_version": "Local OS Version",
    "status": "Status",
    "remote_array": "Remote Array",
    "remote_version": "Remote OS Version",
    "type": "Replication Type",
    "throttled": "Throttled",
    "management_address": "Management IP",
    "replication_address": "Replication IP",
    # links
    "local_pod_name": "Local Pod",
    "direction": "Direction",
    "remote_names": "Remote Array",
    "remote_pod_name": "Remote Pod",
    "recovery_point": "Recovery Point",
    "lag": "Lag (seconds)",
    # pods
    "pod_name": "Pod",
    "promotion_status": "Promotion Status",
    "name": "Member Arrays",
    "mediator_status": "Mediator Status",
    "frozen_at": "Frozen Since",
}

VALUE_LABELS = {
    "replicating": "\U0001F7E2 Replicating",
    "Okay": "\U0001F7E2 Okay",
    "outbound": "→",
    "inbound": "←",
    "Warning": "\U0001F7E1 Warning",
    "paused": "\U0001F7E1 Paused",
    "unhealthy": "\U0001F534 Unhealthy",
    "online": "\U0001F7E2 online",
    "unknown": "⭕ unknown",
    "offline": "\U0001F534 offline",
    "flummoxed": "\U0001F7E1 flummoxed",
    "unreachable": "\U0001F534 unreachable",
    "resyncing": "\U0001F535 resyncing",
}

# Columns of each table, in the order shown.
SUMMARY_COLUMNS = ("site", "connections", "async_links", "sync_pods")
CAPACITY_COLUMNS = (
    "array", "version", "drr", "percent_full", "space_used", "space_remaining", "total_usable",
)
CONNECTION_COLUMNS = (
    "local_array", "local_version", "status", "remote_array", "remote_version", "type",
    "throttled", "management_address", "replication_address",
)
LINK_COLUMNS = (
    "local_array", "local_pod_name", "direction", "remote_names", "remote_pod_name", "status",
    "recovery_point", "lag",
)
POD_COLUMNS = (
    "local_array", "pod_name", "promotion_status", "name", "status", "mediator_status",
    "frozen_at",
)

# Columns whose words carry a mark or an arrow when shown.
WORD_COLUMNS = (
    "connections", "async_links", "sync_pods", "status", "mediator_status", "direction",
)
