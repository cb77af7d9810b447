"""DuckDB SQL for each registered query: the same log lines, parsed and summarised a second way."""

from __future__ import annotations

# Log lines from events, by the same rules as clftally/sources/event_lines.py.
_LINES = r"""
fields AS (
  SELECT event_id,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
    CASE WHEN user_id % 3 = 0 THEN 'u' || user_id ELSE '-' END AS usr,
    CASE event_id % 50 WHEN 17 THEN strftime(ts, '%-d/%b/%Y:%H:%M:%S')
         WHEN 19 THEN strftime(ts, '%-d/%b/%Y:%-H:%-M:%-S')
         ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') END
      || CASE event_id % 50 WHEN 7 THEN '' WHEN 9 THEN ' +0530' WHEN 13 THEN ' +05:30'
         WHEN 23 THEN ' Z' WHEN 29 THEN ' -053015' WHEN 31 THEN '  +20:45:07' ELSE ' +0000' END AS clock,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
    event_type,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '500'
         WHEN event_type = 'error' THEN '404'
         WHEN event_type = 'signup' THEN '302'
         WHEN event_type = 'purchase' THEN '201'
         ELSE '200' END AS status,
    CASE WHEN event_id % 10 = 0 THEN '-'
         WHEN event_id % 97 = 0 THEN '5000000000'
         WHEN event_id % 89 = 0 THEN 'abc'
         ELSE CAST(event_id * 37 % 4096 AS VARCHAR) END AS size
  FROM events
),
records AS (
  SELECT event_id,
    ip || ' - ' || usr || ' [' || CASE WHEN event_id % 50 = 11 THEN 'bad-stamp' ELSE clock END
      || '] "' || method || ' /' || event_type || '/' || (event_id % 20) || ' HTTP/1.1" '
      || status || ' ' || size AS record
  FROM fields
),
clf AS (
  SELECT event_id,
    CASE event_id % 100 WHEN 3 THEN '# comment ' || event_id
                        WHEN 53 THEN ''
                        WHEN 77 THEN '# ' || record
                        ELSE record END AS value
  FROM records
)"""

# Fixed value: the line pattern.
_PATTERN = r'(\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d{3}) (\S+)'


def _parsed(anchored: bool) -> str:
    pattern = ("^" if anchored else "") + _PATTERN
    return f"""{_LINES},
matched AS (
  SELECT event_id, value, coalesce(regexp_matches(value, '{pattern}'), false) AS ok,
    regexp_extract(value, '{pattern}',
      ['ip', 'client', 'user', 'ts_raw', 'request', 'status', 'size']) AS m
  FROM clf
),
log AS (
  SELECT event_id, value, ok, coalesce(m.ip, '') AS ip, coalesce(m.client, '') AS client,
    coalesce(m."user", '') AS "user", coalesce(m.ts_raw, '') AS ts_raw,
    try_strptime(string_split(m.ts_raw, ' ')[1], '%d/%b/%Y:%H:%M:%S')
      - to_seconds(CASE WHEN regexp_matches(m.ts_raw, '[+-][0-9:]+$') THEN
          CASE WHEN contains(m.ts_raw, ' -') THEN -1 ELSE 1 END * list_dot_product(
            list_resize(list_transform(regexp_extract_all(replace(regexp_extract(m.ts_raw, '[+-]([0-9:]+)$', 1), ':', ''), '..'),
              lambda part: CAST(part AS DOUBLE)), 3, 0.0), [3600.0, 60.0, 1.0]) ELSE 0 END) AS ts,
    coalesce(m.request, '') AS request,
    try_cast(m.status AS INTEGER) AS status,
    CASE WHEN m.size = '-' THEN 0
         WHEN regexp_full_match(m.size, '[0-9]+') THEN try_cast(m.size AS BIGINT) END AS size
  FROM matched
)"""


def _on_lines(select: str) -> str:
    return f"WITH {_LINES}\n{select}"


def _on_log(select: str, anchored: bool = True, extra: str = "") -> str:
    return f"WITH {_parsed(anchored)}{extra}\n{select}"


_COLUMNS = 'event_id, ip, client, "user", ts_raw, ts, request, status, size, ok'


def _counts(key: str, where: str = "ok", anchored: bool = True, top: int | None = None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return _on_log(
        f'SELECT {key}, count(*) AS "count" FROM log WHERE {where} GROUP BY {key} '
        f"ORDER BY count(*) DESC, {key}{limit}",
        anchored,
    )


def _mean_size(where: str, anchored: bool = True) -> str:
    return _on_log(
        "SELECT status, avg(size) AS average_response_size FROM log "
        f"WHERE {where} GROUP BY status ORDER BY 2 DESC, 1",
        anchored,
    )


def _share(where: str) -> str:
    counts = f""",
counted AS (SELECT status, count(*) AS n FROM log WHERE status IS NOT NULL AND {where} GROUP BY status),
shares AS (
  SELECT status, n, CAST(n AS DOUBLE) / CAST((SELECT sum(n) FROM counted) AS DOUBLE) * 100 AS percent
  FROM counted
)"""
    return _on_log(
        'SELECT status, CAST(status AS VARCHAR) AS status_label, n AS "count", percent, '
        "printf('%.1f%%', percent) AS percent_label, "
        "percent / (SELECT max(percent) FROM shares) AS scale FROM shares ORDER BY status",
        extra=counts,
    )


def _hourly(where: str, anchored: bool = True) -> str:
    return _on_log(
        "SELECT date_trunc('hour', ts) AS hour, "
        "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_str, "
        f'count(*) AS "count" FROM log WHERE {where} GROUP BY 1, 2 ORDER BY 1',
        anchored,
    )


def _volume(interval: str, where: str = "ts IS NOT NULL") -> str:
    filled = f""",
counted AS (
  SELECT time_bucket(INTERVAL '{interval}', ts) AS bucket, count(*) AS requests
  FROM log WHERE {where} GROUP BY 1
),
series AS (
  SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL '{interval}')) AS bucket FROM counted
)"""
    return _on_log(
        "SELECT bucket, coalesce(requests, 0) AS requests FROM series LEFT JOIN counted USING (bucket) "
        "ORDER BY bucket",
        extra=filled,
    )


def _sections(where: str, anchored: bool, top: int | None, keys=("status", "ip", "request")) -> str:
    counted = ",\ncounted AS (" + " UNION ALL ".join(
        f"SELECT '{key}' AS section, CAST({key} AS VARCHAR) AS key, count(*) AS \"count\" "
        f"FROM log WHERE {where} GROUP BY {key}"
        for key in keys
    ) + ")"
    if top is None:
        return _on_log('SELECT section, key, "count" FROM counted', anchored, counted)
    return _on_log(
        'SELECT section, key, "count" FROM counted '
        "QUALIFY section = 'status' "
        f'OR row_number() OVER (PARTITION BY section ORDER BY "count" DESC, key) <= {top}',
        anchored,
        counted,
    )


def _closed_volume(lateness: str) -> str:
    filled = f""",
latest AS (SELECT max(ts) - INTERVAL '{lateness}' AS mark FROM log),
counted AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n FROM log WHERE ts IS NOT NULL GROUP BY 1
),
series AS (
  SELECT unnest(generate_series((SELECT min(bucket) FROM counted), mark, INTERVAL 5 MINUTE)) AS bucket, mark FROM latest
)"""
    return _on_log(
        "SELECT bucket, coalesce(n, 0) AS requests FROM series LEFT JOIN counted USING (bucket) "
        "WHERE bucket + INTERVAL 5 MINUTE <= mark",
        anchored=False,
        extra=filled,
    )


def _by_first(key: str, top: int) -> str:
    return _on_log(
        f'SELECT {key}, count(*) AS "count" FROM log WHERE ok GROUP BY {key} '
        f"ORDER BY count(*) DESC, min(event_id), {key} LIMIT {top}"
    )


def _report_by_first(top: int) -> str:
    counted = ",\ncounted AS (" + " UNION ALL ".join(
        f"SELECT '{key}' AS section, CAST({key} AS VARCHAR) AS key, count(*) AS \"count\", min(event_id) AS first "
        f"FROM log WHERE ok GROUP BY {key}"
        for key in ("status", "ip", "request")
    ) + ")"
    return _on_log(
        'SELECT section, key, "count", first FROM counted QUALIFY section = \'status\' '
        f'OR row_number() OVER (PARTITION BY section ORDER BY "count" DESC, first, key) <= {top}',
        extra=counted,
    )


def _summary(where: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, count(*) AS \"count\", "
        f"{mean} AS average_response_size FROM log WHERE {where} GROUP BY {key}"
        for section, key, mean in (
            ("status_counts", "status", "CAST(NULL AS DOUBLE)"),
            ("ip_counts", "ip", "CAST(NULL AS DOUBLE)"),
            ("avg_sizes", "status", "CAST(sum(size) AS DOUBLE) / count(size)"),
        )
    )
    return _on_log(rows)


def _closed_hours(lateness: str) -> str:
    hours = """,
hours AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM log WHERE ts IS NOT NULL GROUP BY 1)"""
    return _on_log(
        f'SELECT hour, n AS "count" FROM hours '
        f"WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL '{lateness}'",
        anchored=False,
        extra=hours,
    )


def build(slice_start: str, slice_end: str, lateness: str, lines_per_chunk: int) -> dict[str, str]:
    """SQL text per query name; the slice bounds are UTC times, both included."""
    within = f"ts BETWEEN TIMESTAMP '{slice_start}' AND TIMESTAMP '{slice_end}'"
    quality = (
        "SELECT count(*) AS total_lines, count(*) FILTER (WHERE ok) AS parsed_lines, "
        "count(ts) AS with_timestamp, count(status) AS with_status, count(size) AS with_size FROM log"
    )
    days_and_statuses = _on_log(
        "SELECT event_day AS day, status, count(*) AS \"count\", min(ts) AS first_ts, max(ts) AS last_ts "
        "FROM (SELECT *, CAST(ts AS DATE) AS event_day FROM log) GROUP BY 1, 2"
    )
    status_any = _counts("status", "true", anchored=False)
    return {
        "scan_lines": _on_lines("SELECT value FROM clf"),
        "chunk_lines": _on_lines("SELECT value FROM clf"),
        "chunk_lines_in_order": _on_lines(
            f"SELECT n AS line_number, n // {lines_per_chunk} AS file_number, n % {lines_per_chunk} AS line_in_file, value "
            "FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, value FROM clf)"
        ),
        "parse_access_log": _on_log(f"SELECT {_COLUMNS} FROM log"),
        "parse_access_log_find": _on_log(f"SELECT {_COLUMNS} FROM log", anchored=False),
        "parsed_table": days_and_statuses,
        "parse_timestamps": _on_log("SELECT event_id, ts_raw, ts FROM log WHERE ok"),
        "valid_lines": _on_log("SELECT event_id, value FROM log WHERE ok"),
        "time_slice": _on_log(f"SELECT {_COLUMNS} FROM log WHERE {within}"),
        "parse_quality": _on_log(quality),
        "parse_quality_find": _on_log(quality, anchored=False),
        "status_counts": _counts("status"),
        "status_counts_raw": status_any,
        "status_share": _share("true"),
        "ip_counts": _counts("ip"),
        "ip_counts_raw": _counts("ip", "true", anchored=False),
        "request_counts": _counts("request"),
        "request_counts_raw": _counts("request", "true", anchored=False),
        "top_ips": _counts("ip", top=10),
        "top_requests": _counts("request", top=10),
        "top_ips_by_first": _by_first("ip", 10),
        "top_requests_by_first": _by_first("request", 50),
        "avg_size_by_status": _mean_size("ok"),
        "avg_size_by_status_raw": _mean_size("true", anchored=False),
        "time_bounds": _on_log("SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM log"),
        "hourly_volume": _hourly("ts IS NOT NULL"),
        "hourly_volume_raw": _hourly("true", anchored=False),
        "volume_1m": _volume("1 minute"),
        "volume_5m": _volume("5 minutes"),
        "volume_15m": _volume("15 minutes"),
        "volume_1h": _volume("1 hour"),
        "access_report": _sections("ok", True, 10),
        "access_report_by_first": _report_by_first(25),
        "summary_report": _summary("ok"),
        "slice_volume": _volume("5 minutes", within),
        "rollup_volume": _volume("5 minutes", within),
        "slice_status_share": _share(within),
        "rollup_status_share": _share(within),
        "slice_top_ips": _counts("ip", within, top=10),
        "rollup_top_ips": _counts("ip", within, top=10),
        "slice_top_requests": _counts("request", within, top=10),
        "rollup_top_requests": _counts("request", within, top=10),
        "sql_top_ips": _counts("ip", top=10),
        "stream_status_counts": status_any,
        "stream_ip_counts": _counts("ip", "true", anchored=False),
        "stream_top_ips": _counts("ip", "true", anchored=False, top=10),
        "stream_request_counts": _counts("request", "true", anchored=False),
        "stream_top_requests": _counts("request", "true", anchored=False, top=10),
        "stream_avg_size": _mean_size("status IS NOT NULL", anchored=False),
        "stream_hourly_volume": _hourly("true", anchored=False),
        "stream_closed_hours": _closed_hours(lateness),
        "stream_closed_volume": _closed_volume(lateness),
        "stream_parsed_table": days_and_statuses,
        "stream_sql_top_ips": _counts("ip", "true", anchored=False, top=10),
        "stream_top_lists": _sections("true", False, 10, ("ip", "request")),
        "stream_access_report": _sections("true", False, 10),
    }
