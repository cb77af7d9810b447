"""Access-log analytics as Spark jobs."""

from clftally.operators.counts import (
    avg_size_by_status,
    ip_counts,
    parse_quality,
    request_counts,
    status_counts,
    status_share,
    top_ips,
    top_requests,
)
from clftally.operators.parse import parse_access_log, parse_timestamps, valid_lines
from clftally.operators.volume import hourly_volume, time_bounds, time_slice, volume
from clftally.session import configure, get_session
from clftally.sources.parsed import read_parsed, write_parsed
from clftally.sources.text import chunk_lines, chunk_lines_in_order, number_lines, scan_lines, stream_lines

__all__ = [
    "avg_size_by_status",
    "chunk_lines",
    "chunk_lines_in_order",
    "configure",
    "get_session",
    "hourly_volume",
    "ip_counts",
    "number_lines",
    "parse_access_log",
    "parse_quality",
    "parse_timestamps",
    "read_parsed",
    "request_counts",
    "scan_lines",
    "status_counts",
    "status_share",
    "stream_lines",
    "time_bounds",
    "time_slice",
    "top_ips",
    "top_requests",
    "valid_lines",
    "volume",
    "write_parsed",
]
