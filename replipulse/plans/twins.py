"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from replipulse.model import (
    CAPACITY_COLUMNS,
    CONNECTION_COLUMNS,
    LABELS,
    LINK_COLUMNS,
    POD_COLUMNS,
    REPORT_ZONE,
    SUMMARY_COLUMNS,
    VALUE_LABELS,
)

# --- text expressions --------------------------------------------------------


def _local(ms: str) -> str:
    return f"timezone('{REPORT_ZONE}', to_timestamp(({ms}) // 1000))"


def _zone_text(ms: str) -> str:
    utc = f"timezone('UTC', to_timestamp(({ms}) // 1000))"
    return (
        f"strftime({_local(ms)}, '%Y-%m-%d %H:%M:%S') || "
        f"CASE date_diff('hour', {utc}, {_local(ms)}) WHEN -8 THEN ' PST' WHEN -7 THEN ' PDT' END"
    )


def _two_places(value: str) -> str:
    return f"regexp_replace(printf('%.2f', {value}), '0$', '')"


def _size_text(size: str) -> str:
    text = f"CASE WHEN {size} = 0 THEN '0B' "
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        scaled = _two_places(f"CAST({size} AS DOUBLE) / {1024**power}")
        text += f"WHEN abs({size}) < {1024 ** (power + 1)} THEN {scaled} || ' {unit}' "
    scaled = _two_places(f"CAST({size} AS DOUBLE) / {1024**6}")
    return text + f"ELSE {scaled} || ' EB' END"


def _marked(column: str) -> str:
    cases = " ".join(f"WHEN '{word}' THEN '{shown}'" for word, shown in VALUE_LABELS.items())
    return f"CASE {column} {cases} ELSE {column} END"


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# --- derived tables ----------------------------------------------------------

_PARTS = {
    "ns": "SELECT count(*) AS n FROM supplier",
    "configured": """
        SELECT *, '10.0.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS ip
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sites": "SELECT n_nationkey AS site_pos, n_name AS site FROM nation",
    "arrays": """
        SELECT s_suppkey AS array_pos, s_name AS array, '6.' || (s_suppkey % 7) AS version,
               n_nationkey AS site_pos, n_name AS site
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "capacity": """
        SELECT array_pos,
               CASE WHEN array_pos % 20 = 0 THEN 0 ELSE total * unit END AS used,
               CASE WHEN array_pos % 50 = 7 THEN 0 ELSE capacity * unit END AS usable,
               CAST(lines AS DOUBLE) / n AS reduction
        FROM (
            SELECT l_suppkey AS array_pos,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS capacity,
                   CAST(coalesce(sum(CAST(l_quantity AS BIGINT))
                        FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS total,
                   sum(l_linenumber) AS lines, count(*) AS n,
                   CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS unit
            FROM lineitem GROUP BY l_suppkey)""",
    "capacity_texts": f"""
        SELECT array_pos,
               printf('%.1f', reduction) || ':1' AS drr,
               {_two_places("CAST(used AS DOUBLE) / nullif(usable, 0) * 100")} || '%'
                   AS percent_full,
               {_size_text("used")} AS space_used,
               {_size_text("(usable - used)")} AS space_remaining,
               {_size_text("usable")} AS total_usable
        FROM capacity""",
    "connection_pages": """
        SELECT (k * k) % n AS array_pos, l_orderkey AS page,
               'remote-' || l_partkey AS remote_array,
               '6.' || (l_partkey % 7) AS remote_version,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 50
                         AND l_linenumber = 7 THEN 'partially_connected'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity = 1
                         AND l_linenumber = 1 AND l_tax = 0 THEN NULL
                    ELSE 'connected' END AS status,
               CASE WHEN l_linestatus = 'F' THEN 'async-replication'
                    ELSE 'sync-replication' END AS type,
               CASE WHEN l_tax > 0.05::DOUBLE THEN 'true' ELSE 'false' END AS throttled,
               '10.1.' || (l_partkey % 256) AS management_address,
               '10.2.' || (l_partkey % 256) AS replication_address,
               CAST(l_orderkey AS VARCHAR) AS id, 1 AS records
        FROM (SELECT *, l_suppkey % n AS k FROM lineitem, ns)
        UNION ALL
        SELECT s_suppkey, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0
        FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey NOT IN (
            SELECT ((s_suppkey % n) * (s_suppkey % n)) % n FROM supplier, ns)""",
    "connection_records": "SELECT * FROM connection_pages WHERE records = 1",
    "link_pages": """
        SELECT *, (k * k + 1) % n AS array_pos,
               5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS records
        FROM (SELECT *, o_custkey % n AS k FROM orders, ns)""",
    "link_records": """
        SELECT array_pos, o_orderkey AS page, i,
               'pod-' || o_custkey AS local_pod_name,
               CASE WHEN i % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction,
               '[remote-' || (o_custkey % 10)
                   || CASE WHEN i >= 3 THEN ', remote-' || (o_custkey % 10 + i) ELSE '' END
                   || ']' AS remote_names,
               'pod-' || o_orderkey AS remote_pod_name,
               CASE WHEN i = 4 AND o_orderstatus = 'P' AND strftime(o_orderdate, '%m-%d') = '12-31'
                         THEN 'unhealthy'
                    WHEN i = 4 AND o_orderstatus = 'P' AND strftime(o_orderdate, '%m-%d') = '07-01'
                         THEN 'paused'
                    WHEN i = 4 AND o_orderstatus = 'O' AND strftime(o_orderdate, '%m-%d') = '01-01'
                         THEN NULL
                    ELSE 'replicating' END AS status,
               CASE WHEN o_orderstatus = 'O' AND i = 3 THEN NULL
                    ELSE epoch_ms(o_orderdate) + o_orderkey % 86400000 + i END AS recovery_ms,
               CAST(o_orderkey % 100000 * 1730 + i AS DOUBLE) / 1000 AS lag
        FROM (SELECT *, unnest(range(1, records + 1)) AS i FROM link_pages)""",
    "pods": """
        SELECT *, row_number() OVER () AS pod_id, (k * k + 2) % n AS array_pos,
               l_orderkey * 8 + l_linenumber AS page, l_partkey AS part, l_suppkey AS supp,
               'pod-' || l_orderkey AS pod_name,
               CASE WHEN l_linestatus = 'F' THEN 'promoted' ELSE 'demoted' END AS promotion_status
        FROM (SELECT *, l_suppkey % n AS k FROM lineitem, ns)""",
    "members": """
        SELECT pod_id, i, 'array-' || (l_suppkey + i) AS name,
               CASE WHEN l_returnflag = 'R' AND array_pos % 3 <> 0 AND i = 2 THEN 'offline'
                    WHEN l_returnflag = 'R' AND array_pos % 3 <> 0 AND i = 3 THEN 'unknown'
                    ELSE 'online' END AS status,
               CASE l_quantity WHEN 50 THEN 'unreachable' WHEN 49 THEN 'flummoxed'
                    ELSE 'online' END AS mediator_status,
               CASE WHEN l_returnflag = 'R' AND array_pos % 3 <> 0 AND i = 2
                    THEN epoch_ms(l_shipdate) + l_orderkey % 86400000 END AS frozen_ms
        FROM (SELECT *, unnest(range(1, l_linenumber)) AS i FROM pods)""",
    "stretched": """
        SELECT p.pod_id, p.array_pos, p.page, p.part, p.supp, p.pod_name,
               CAST(count(*) AS INTEGER) AS members, bool_or(m.status <> 'online') AS bad
        FROM pods p JOIN members m USING (pod_id)
        GROUP BY ALL HAVING count(*) > 1""",
    "connection_health": """
        SELECT array_pos,
               CASE WHEN sum(records) = 0 THEN 'None found'
                    WHEN bool_or(records = 1 AND coalesce(status <> 'connected', true))
                    THEN 'Warning' ELSE 'Okay' END AS connections
        FROM connection_pages GROUP BY array_pos""",
    "link_health": """
        SELECT p.array_pos,
               CASE WHEN max(p.records) = 0 THEN 'N/A'
                    WHEN bool_or(r.page IS NOT NULL AND coalesce(r.status <> 'replicating', true))
                    THEN 'Warning' ELSE 'Okay' END AS async_links
        FROM link_pages p LEFT JOIN link_records r ON r.page = p.o_orderkey
        GROUP BY p.array_pos""",
    "pod_health": """
        SELECT array_pos, CASE WHEN bad THEN 'Warning' ELSE 'Okay' END AS sync_pods
        FROM (SELECT *, row_number() OVER (PARTITION BY array_pos
                  ORDER BY page DESC, part DESC, supp DESC, bad DESC) AS rn FROM stretched)
        WHERE rn = 1""",
    "pod_health_any": """
        SELECT array_pos, CASE WHEN bool_or(bad) THEN 'Warning' ELSE 'Okay' END AS sync_pods
        FROM stretched GROUP BY array_pos""",
    "connection_rows": """
        SELECT a.site_pos, a.site, r.array_pos, r.page, a.array AS local_array,
               a.version AS local_version, r.status,
               r.remote_array, r.remote_version, r.type, r.throttled, r.management_address,
               r.replication_address
        FROM connection_records r JOIN arrays a USING (array_pos)""",
    "link_rows": f"""
        SELECT a.site_pos, a.site, r.array_pos, r.page, r.i, a.array AS local_array,
               r.local_pod_name, r.direction,
               r.remote_names, r.remote_pod_name, r.status,
               {_zone_text("r.recovery_ms")} AS recovery_point, r.lag
        FROM link_records r JOIN arrays a USING (array_pos)""",
    "pod_rows": f"""
        SELECT a.site_pos, a.site, a.array_pos, p.page, p.part, p.supp, p.pod_id, m.i,
               a.array AS local_array, p.pod_name,
               p.promotion_status, m.name, m.status, m.mediator_status,
               {_zone_text("m.frozen_ms")} AS frozen_at,
               row_number() OVER (
                   PARTITION BY a.site, a.array, a.version, p.pod_name, p.promotion_status
                   ORDER BY a.array_pos, p.page, p.part, p.supp, p.pod_id, m.i) AS nth
        FROM pods p JOIN arrays a USING (array_pos) LEFT JOIN members m USING (pod_id)
        WHERE a.array_pos IN (SELECT array_pos FROM stretched)""",
    "blanked_pod_rows": """
        SELECT site_pos, site, array_pos, page, part, supp, pod_id, i,
               CASE WHEN nth = 1 THEN local_array ELSE '' END AS local_array,
               CASE WHEN nth = 1 THEN pod_name ELSE '' END AS pod_name,
               CASE WHEN nth = 1 THEN promotion_status ELSE '' END AS promotion_status,
               name, status, mediator_status, frozen_at
        FROM pod_rows""",
    "history": """
        SELECT event_id, user_id % n AS array_pos, ts,
               CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Okay' END AS status,
               CAST(round(value * 100) AS BIGINT) AS bytes, props
        FROM events, ns""",
}


def _rolled_up(column: str) -> str:
    return (
        f"CASE WHEN bool_or({column} = 'Warning') THEN 'Warning' "
        f"WHEN coalesce(bool_and({column} = 'N/A'), true) THEN 'N/A' ELSE 'Okay' END AS {column}"
    )


def _summary(pod_health: str) -> str:
    return f"""
        SELECT s.site_pos, s.site, {_rolled_up("connections")}, {_rolled_up("async_links")},
               {_rolled_up("sync_pods")}
        FROM sites s LEFT JOIN (
            SELECT a.site, coalesce(c.connections, 'N/A') AS connections,
                   coalesce(l.async_links, 'N/A') AS async_links,
                   coalesce(p.sync_pods, 'N/A') AS sync_pods
            FROM arrays a LEFT JOIN connection_health c USING (array_pos)
            LEFT JOIN link_health l USING (array_pos)
            LEFT JOIN {pod_health} p USING (array_pos)) USING (site)
        GROUP BY s.site_pos, s.site"""


_PARTS["summary"] = _summary("pod_health")
_PARTS["summary_any"] = _summary("pod_health_any")

_MARKED = {"connections", "async_links", "sync_pods", "status", "mediator_status", "direction"}


def _cell(column: str) -> str:
    if column == "lag":
        shown = "format('{:,.2f}', lag)"
    else:
        shown = _marked(column) if column in _MARKED else f'"{column}"'
    return f"coalesce({shown}, 'N/A')"


def _display(source: str, columns: tuple[str, ...]) -> str:
    def shown(column: str) -> str:
        if column == "lag":
            return "format('{:,.2f}', lag)"
        return _marked(column) if column in _MARKED else column

    named = ", ".join(f'{shown(c)} AS "{LABELS[c]}"' for c in columns)
    return f"SELECT {named} FROM {source}"


_DETAILS = (
    (1, "connections", "Array Connections", "connection_rows", CONNECTION_COLUMNS),
    (2, "async_links", "Async Status", "link_rows", LINK_COLUMNS),
    (3, "sync_pods", "Sync Status", "blanked_pod_rows", POD_COLUMNS),
)
_CAPACITY_ROWS = """(
    SELECT a.site_pos, a.site, a.array_pos, a.array, a.version,
           t.drr, t.percent_full, t.space_used, t.space_remaining, t.total_usable
    FROM arrays a LEFT JOIN capacity_texts t USING (array_pos))"""


def _tables() -> list[tuple[int, str, int, str, tuple[str, ...], str]]:
    """Section, site number, kind, heading, columns and source of each kind of table."""
    tables = [
        (0, "-1", 0, "'Summary'", SUMMARY_COLUMNS, "summary"),
        (1, "site_pos", 0, "{site} || ' &mdash; Arrays'", CAPACITY_COLUMNS, _CAPACITY_ROWS),
    ]
    for kind, column, title, source, columns in _DETAILS:
        warned = f"(SELECT * FROM {source} WHERE site IN " \
                 f"(SELECT site FROM summary WHERE {column} = 'Warning'))"
        tables.append(
            (2, "site_pos", kind, f"'Warning: ' || {{site}} || ' &mdash; {title}'", columns, warned)
        )
    return tables


_PROBLEM = "connections = 'Warning' OR async_links = 'Warning' OR sync_pods = 'Warning'"


def _report_sections() -> str:
    parts = [
        f"SELECT 2 AS section_rank, site_pos, 0 AS kind_rank, "
        f"'Problem Report &mdash; ' || site AS heading, '' AS cells, "
        f"NULL AS d1, NULL AS d2, NULL AS a1, NULL AS a2, [CAST(site_pos AS BIGINT)] AS place, [''] AS cell_list "
        f"FROM summary WHERE {_PROBLEM}",
        f"SELECT -1, -1, 0, 'Report Generated:', '{_RUN_TIME}', NULL, NULL, NULL, NULL, [0], ['']",
    ]
    for section, site_pos, kind, heading, columns, source in _tables():
        cells = " || ' | ' || ".join(_cell(c) for c in columns)
        order = ", ".join([*_ORDERS[section, kind], f"[{', '.join(_cell(c) for c in columns)}]"])
        parts.append(
            f"SELECT {section}, {site_pos}, {kind}, {heading.format(site='site')}, {cells}, {order} "
            f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


_RUN_TIME = "2024-01-30 16:00:00 PST"
# Sort columns of each kind of table: two descending texts, two ascending ones, places.
_ORDERS = {
    (0, 0): ("NULL", "NULL", "NULL", "NULL", "[site_pos]"),
    (1, 0): ("NULL", "NULL", "NULL", "NULL", "[array_pos]"),
    (2, 1): ("status", "remote_array", "NULL", "NULL", "[array_pos, page]"),
    (2, 2): ("NULL", "NULL", "local_pod_name", "direction", "[array_pos, page, i]"),
    (2, 3): ("NULL", "NULL", "NULL", "NULL", "[array_pos, page, part, supp, pod_id, coalesce(i, 0)]"),
}


def _saved_report() -> str:
    return f"""
        SELECT '2024-01-31' AS run_date, section_rank, site_pos, kind_rank, cells,
               row_number() OVER (ORDER BY section_rank, site_pos, kind_rank, d1 DESC NULLS LAST,
                   d2 DESC NULLS LAST, a1 NULLS LAST, a2 NULLS LAST, place, cell_list) AS position
        FROM ({_report_sections()})"""


def _html_tables() -> str:
    site = _escaped("site")
    frame = "SELECT {} AS section_rank, -1 AS site_pos, 0 AS kind_rank, 0 AS part, '{}' AS html"
    parts = [
        frame.format(-1, "<!DOCTYPE html><html><body>"),
        f"SELECT -1, -1, 0, 2, '<p>Report Generated: {_RUN_TIME}</p>'",
        frame.format(3, "</body></html>"),
        f"SELECT 2, site_pos, 0, 1, '<br /><hr /><h1>Problem Report &mdash; ' || {site} || '</h1>' "
        f"FROM summary WHERE {_PROBLEM}",
    ]
    for section, site_pos, kind, heading, columns, source in _tables():
        level = {0: 1, 1: 2, 2: 3}[section]
        names = "".join(f"<th>{LABELS[c]}</th>" for c in columns)
        title = heading.format(site=site)
        where = {
            0: "FROM (SELECT 1)",
            1: "FROM summary",
            2: f"FROM summary WHERE {dict((d[0], d[1]) for d in _DETAILS).get(kind)} = 'Warning'",
        }[section]
        parts.append(
            f"SELECT {section}, {site_pos}, {kind}, 1, '<h{level}>' || {title} || "
            f"'</h{level}><table><thead><tr>{names}</tr></thead><tbody>' {where}"
        )
        cells = " || ".join(f"'<td>' || {_escaped(_cell(c))} || '</td>'" for c in columns)
        parts.append(
            f"SELECT {section}, {site_pos}, {kind}, 2, '<tr>' || {cells} || '</tr>' FROM {source}"
        )
        parts.append(
            f"SELECT {section}, {site_pos}, {kind}, 3, '</tbody></table><br />' {where}"
        )
    return " UNION ALL ".join(parts)


def _needed(sql: str) -> list[str]:
    """The derived tables a statement uses, in order of definition."""
    import re

    wanted: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & set(_PARTS) - wanted:
            wanted.add(name)
            todo.append(_PARTS[name])
    return [name for name in _PARTS if name in wanted]


def _with(sql: str) -> str:
    names = _needed(sql)
    if not names:
        return sql
    return "WITH " + ", ".join(f"{name} AS ({_PARTS[name]})" for name in names) + " " + sql


def _array_view(column: str, health: str) -> str:
    return (
        f"SELECT a.site, a.array_pos, a.array, coalesce(h.{column}, 'N/A') AS {column} "
        f"FROM arrays a LEFT JOIN {health} h USING (array_pos)"
    )


_SELECTS = {
    "inventory": """
        SELECT n_name AS site, n_nationkey AS site_pos, s_suppkey AS array_pos, s_name AS array,
               '10.0.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS mgmt_ip
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
    "version_per_array": """
        SELECT n_name AS site, s_suppkey AS array_pos, s_name AS array,
               '6.' || (s_suppkey % 7) AS version
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
    "version_last_in_site": """
        SELECT n_name AS site, s_suppkey AS array_pos, s_name AS array,
               last_value('6.' || (s_suppkey % 7)) OVER (PARTITION BY n_name ORDER BY s_suppkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS version
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
    "latest_snapshot": """
        SELECT array_pos, event_id, epoch_us(ts) AS run_us, status
        FROM (SELECT *, rank() OVER (PARTITION BY array_pos ORDER BY ts DESC) AS r FROM history)
        WHERE r = 1""",
    "json_flatten": """
        SELECT event_id, array_pos AS "poll.array_pos",
               CAST(json_extract(props, '$.k') AS INTEGER) AS "poll.props.k"
        FROM history""",
    "connection_status": _array_view("connections", "connection_health"),
    "connection_status_empty_as_na": """
        SELECT a.site, a.array_pos, a.array,
               coalesce(nullif(h.connections, 'None found'), 'N/A') AS connections
        FROM arrays a LEFT JOIN connection_health h USING (array_pos)""",
    "link_status": _array_view("async_links", "link_health"),
    "stretched_pods": """
        SELECT array_pos, page, part, supp, CAST(0 AS INTEGER) AS pod_pos, pod_name, members, bad
        FROM stretched""",
    "pod_status_last": _array_view("sync_pods", "pod_health"),
    "pod_status_any": _array_view("sync_pods", "pod_health_any"),
    "site_summary": "SELECT * FROM summary",
    "site_summary_any_pod": "SELECT * FROM summary_any",
    "problem_sites": f"SELECT * FROM summary WHERE {_PROBLEM}",
    "summary_display": _display("summary", SUMMARY_COLUMNS),
    "capacity_metrics": """
        SELECT array_pos, used, usable, usable - used AS remaining,
               CAST(used AS DOUBLE) / nullif(usable, 0) * 100 AS percent, reduction
        FROM capacity""",
    "capacity_display": """
        SELECT a.site, a.array_pos, a.array, a.version, coalesce(drr, 'N/A') AS drr,
               coalesce(percent_full, 'N/A') AS percent_full,
               coalesce(space_used, 'N/A') AS space_used,
               coalesce(space_remaining, 'N/A') AS space_remaining,
               coalesce(total_usable, 'N/A') AS total_usable
        FROM arrays a LEFT JOIN capacity_texts USING (array_pos)""",
    "preset_fields": """
        SELECT a.site, a.array_pos, a.array,
               coalesce(h.connections, CASE WHEN a.array_pos % 2 = 1 THEN 'Okay' END, 'N/A') AS connections,
               CASE WHEN c.array_pos IS NOT NULL THEN coalesce(drr, 'N/A')
                    WHEN a.array_pos % 4 <> 2 THEN '2.0:1' ELSE 'N/A' END AS drr,
               CASE WHEN c.array_pos IS NOT NULL THEN coalesce(percent_full, 'N/A')
                    WHEN a.array_pos % 5 <> 3 THEN '7.5%' ELSE 'N/A' END AS percent_full,
               coalesce(space_used, 'N/A') AS space_used, coalesce(space_remaining, 'N/A') AS space_remaining,
               coalesce(total_usable, 'N/A') AS total_usable
        FROM arrays a LEFT JOIN connection_health h USING (array_pos)
        LEFT JOIN (SELECT * FROM capacity_texts WHERE array_pos % 3 <> 1) c ON c.array_pos = a.array_pos""",
    "connection_detail": f"SELECT site, {', '.join(CONNECTION_COLUMNS)} FROM connection_rows",
    "connection_display": _display("connection_rows", CONNECTION_COLUMNS),
    "link_detail": f"SELECT site, {', '.join(LINK_COLUMNS)} FROM link_rows",
    "link_display": _display("link_rows", LINK_COLUMNS),
    "pod_detail": f"SELECT site, {', '.join(POD_COLUMNS)} FROM pod_rows",
    "blank_repeats": f"SELECT site, array_pos, page, {', '.join(POD_COLUMNS)} FROM blanked_pod_rows",
    "pod_display": _display("blanked_pod_rows", POD_COLUMNS),
    "report_sections": f"SELECT section_rank, site_pos, kind_rank, heading, cells FROM ({_report_sections()})",
    "saved_report": _saved_report(),
    "html_tables": _html_tables(),
    "retention": f"""
        SELECT event_id, epoch_us(ts) AS run_us,
               date_sub('day', ts, TIMESTAMP '2024-01-31 00:00:00') AS age_days,
               strftime({_local("epoch_us(ts) // 1000")}, '%Y-%m-%d %H:%M:%S') AS report_time,
               strftime({_local("epoch_us(ts) // 1000")}, '%Y-%m-%d_%H-%M') AS file_stamp
        FROM events
        WHERE date_sub('day', ts, TIMESTAMP '2024-01-31 00:00:00') <= 14""",
    "stream_status": """
        SELECT a.site, a.array_pos, a.array, coalesce(c.connections, 'N/A') AS connections,
               coalesce(l.async_links, 'N/A') AS async_links, coalesce(p.sync_pods, 'N/A') AS sync_pods
        FROM arrays a LEFT JOIN connection_health c USING (array_pos)
        LEFT JOIN link_health l USING (array_pos) LEFT JOIN pod_health p USING (array_pos)""",
    "stream_rollup": f"""
        SELECT epoch_us(day) AS window_start_us, site, {_rolled_up("status")}
        FROM (SELECT date_trunc('day', CAST(h.ts AS TIMESTAMP)) AS day, a.site, h.status
              FROM history h JOIN arrays a USING (array_pos))
        GROUP BY day, site""",
    "stream_volume": """
        SELECT epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) AS window_start_us, array_pos,
               CAST(sum(bytes) AS BIGINT) AS bytes
        FROM history GROUP BY 1, 2""",
    "nested_inventory": """
        SELECT n_name AS site, 0 AS site_pos, CAST(0 AS BIGINT) AS array_pos, s_name AS array, ip AS mgmt_ip
        FROM configured
        UNION ALL SELECT n_name, 0, 1, s_name || '-b', ip FROM configured
        UNION ALL SELECT n_name || ' spare ' || s_suppkey, 1, NULL, NULL, NULL FROM configured""",
    "payload_from_json": """
        SELECT array_pos, page, remote_array AS array_name, remote_version AS version, status, throttled, id
        FROM connection_records""",
}

TWINS = {name: _with(sql) for name, sql in _SELECTS.items()}
