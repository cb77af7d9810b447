"""Registered queries, each with the DuckDB SQL that must give the same rows.

``entry`` is the flagship query; ``queries`` maps a name to a function of (session, folder of tables).
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
from clftally import configure  # noqa: E402
from clftally.operators import counts, parse, volume  # noqa: E402
from clftally.plans import report, rollup  # noqa: E402
from clftally.sources import event_lines, parsed as parsed_table, shared, text  # noqa: E402
from clftally.streaming import jobs, results, tables  # noqa: E402

try:
    from clftally.llm import registry as llm  # noqa: E402
except ImportError:
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# The range used by the time-slice queries, in UTC, both ends included.
SLICE = ("2024-01-08 06:30:00", "2024-01-22 18:45:00")

# Lines in a file of the feed, files that one micro-batch takes, and how long a stream may run, in seconds.
LINES_PER_FILE = 1_000_000
FILES_PER_BATCH = 1000
# Lines in a file of the ordered chunks.
LINES_PER_CHUNK = 1000
STREAM_TIMEOUT = 4 * 3600

# How late a line may come and still be counted in its hour.
LATENESS = "2 hours"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole events table as log lines."""
    return event_lines.as_log_lines(event_lines.read_events(configure(spark), sf_dir))


def _on_lines(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_lines(spark, sf_dir))


def _on_log(
    operator: Callable[[DataFrame], DataFrame], anchored: bool = True, with_time: bool = False
) -> Query:
    """An operator over the parsed log."""
    return lambda spark, sf_dir: operator(
        parse.parse_access_log(_lines(spark, sf_dir), anchored, with_time)
    )


def _on_times(operator: Callable[[DataFrame], DataFrame], anchored: bool = True) -> Query:
    """An operator over the parsed log with its instants."""
    return _on_log(operator, anchored, with_time=True)


def _on_stream(
    build: Callable[[DataFrame], DataFrame],
    read: Callable[[DataFrame], DataFrame],
    with_time: bool = False,
) -> Query:
    """A running result over the events table read as a stream, read once all of it has been seen."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        running = build(_parsed_stream(spark, sf_dir, with_time))
        return read(jobs.run(spark, running, shared.fresh_folder(spark, "stream"), STREAM_TIMEOUT))

    return query


def _on_stream_counts(
    build: Callable[[DataFrame], DataFrame], keys: list[str], read: Callable[[DataFrame], DataFrame]
) -> Query:
    """Like `_on_stream`, for a result with many keys, of which each micro-batch writes those it changed."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        running = build(_parsed_stream(spark, sf_dir))
        folder = shared.fresh_folder(spark, "stream")
        return read(jobs.run_counts(spark, running, folder, keys, STREAM_TIMEOUT))

    return query


def _stream_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that no line in time can still change, once all of the events table has been seen."""
    hours = results.closed_hours(_parsed_stream(spark, sf_dir, with_time=True), LATENESS)
    return jobs.run_appending(spark, hours, shared.fresh_folder(spark, "stream"), STREAM_TIMEOUT)


def _stream_closed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of 5 minutes, with the empty ones, that no line in time can still change."""
    filled = results.closed_volume(_parsed_stream(spark, sf_dir, with_time=True), LATENESS)
    return jobs.run_appending(spark, filled, shared.fresh_folder(spark, "stream"), STREAM_TIMEOUT)


def _stream_parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day and status of the table that a stream of text files fills."""
    feed, folder = _write_chunks(configure(spark), sf_dir), shared.fresh_folder(spark, "table")
    try:
        stream = text.stream_lines(spark, feed, max_files_per_trigger=FILES_PER_BATCH)
        query = tables.start_parsed_table(parse.parse_access_log(stream), folder)
        if not jobs.await_and_stop([query], STREAM_TIMEOUT):
            raise TimeoutError("the stream did not finish")
    finally:
        shared.remove_folder(spark, feed)
    return _days_and_statuses(tables.read_table(spark, folder))


def _stream_sql_top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text on the view of a running result."""
    running = results.running_ip_counts(_parsed_stream(spark, sf_dir))
    query = jobs.start_running_counts(running, shared.fresh_folder(spark, "stream"), ["ip"], view="running_ips")
    if not jobs.await_and_stop([query], STREAM_TIMEOUT):
        raise TimeoutError("the stream did not finish")
    return spark.sql("SELECT ip, count FROM running_ips ORDER BY count DESC, ip LIMIT 10")


def _parsed_stream(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    lines = event_lines.as_log_lines(event_lines.stream_events(configure(spark), sf_dir))
    return parse.parse_access_log(lines, anchored=False, with_time=with_time)


def _largest_first(measure: str, key: str) -> Callable[[DataFrame], DataFrame]:
    return lambda table: table.orderBy(F.desc(measure), key)


def _without_zone(rows: DataFrame) -> DataFrame:
    """Instants as UTC times without a zone, the type the tables themselves use."""
    instants = [name for name, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in instants})


def _write_chunks(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as text files of `LINES_PER_FILE` in a new shared folder."""
    folder = shared.fresh_folder(spark, "lines")
    text.chunk_lines(_lines(spark, sf_dir), folder, LINES_PER_FILE)
    return folder


def _scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh_folder(spark, "lines")
    _lines(spark, sf_dir).select("value").write.text(folder)
    return text.scan_lines(spark, folder)


def _chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.scan_lines(spark, _write_chunks(spark, sf_dir))


def _chunk_lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in order of its ids, cut into files, as these are read back: file, line in it, text."""
    folder = shared.fresh_folder(spark, "chunks")
    text.chunk_lines_in_order(_lines(spark, sf_dir), folder, LINES_PER_CHUNK, order=["event_id"])
    return text.number_lines(spark, folder).select("line_number", "file_number", "line_in_file", "value")


def _parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day and status, from the parsed log stored as a table."""
    folder = shared.fresh_folder(spark, "table")
    parsed_table.write_parsed(parse.parse_access_log(_lines(spark, sf_dir)), folder)
    return _days_and_statuses(parsed_table.read_parsed(spark, folder))


def _days_and_statuses(table: DataFrame) -> DataFrame:
    grouped = table.groupBy("day", "status")
    return _without_zone(
        grouped.agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def _sql_top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    report.register_view(parse.parse_access_log(_lines(spark, sf_dir), with_time=False), "access_log")
    return spark.sql(
        "SELECT ip, count(*) AS count FROM access_log WHERE ok "
        "GROUP BY ip ORDER BY count DESC, ip LIMIT 10"
    )


def _stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running status counts over a folder of text files."""
    feed = _write_chunks(configure(spark), sf_dir)
    try:
        stream = text.stream_lines(spark, feed, max_files_per_trigger=FILES_PER_BATCH)
        running = results.running_status_counts(parse.parse_access_log(stream, anchored=False, with_time=False))
        return jobs.run(spark, running, shared.fresh_folder(spark, "stream"), STREAM_TIMEOUT)
    finally:
        shared.remove_folder(spark, feed)


def _stream_top(build: Callable[[DataFrame], DataFrame]) -> Query:
    """Top 10 of a running count. The query keeps its result table down to these rows."""
    return _on_stream(lambda log: results.top_rows(build(log)), results.top_rows)


def _stream_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 10 addresses and request lines, by two queries that run at once."""
    parsed = _parsed_stream(spark, sf_dir)
    running = {
        "ip": results.top_rows(results.running_ip_counts(parsed)),
        "request": results.top_rows(results.running_request_counts(parsed)),
    }
    tables = jobs.run_together(spark, running, shared.fresh_folder(spark, "stream"), STREAM_TIMEOUT)
    ips, requests = (
        results.top_rows(table).select(
            F.lit(name).alias("section"), F.col(name).alias("key"), "count"
        )
        for name, table in tables.items()
    )
    return ips.unionByName(requests)


def _slice(section: str) -> Query:
    """One table of the log viewer, for the time range."""
    return _on_times(
        lambda log: report.slice_report(log, *SLICE, sections=(section,))[section]
    )


def _rollup_slice(section: str) -> Query:
    """The same table, from counts per minute but for the first and the last one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, store = shared.fresh_folder(spark, "table"), shared.fresh_folder(spark, "rollup")
        parsed_table.write_parsed(parse.parse_access_log(_lines(spark, sf_dir)), table)
        rollup.refresh(spark, table, store)
        return rollup.slice_report(spark, table, store, *SLICE, sections=(section,))[section]

    return query


def entry(spark: SparkSession) -> DataFrame:
    """Share of each status in the log."""
    return queries()["status_share"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return log_queries() | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracle.build(*SLICE, LATENESS, LINES_PER_CHUNK) | (llm.oracle_sql() if llm else {})


def log_queries() -> dict[str, Query]:
    return {
        "scan_lines": _scan_lines,
        "chunk_lines": _chunk_lines,
        "chunk_lines_in_order": _chunk_lines_in_order,
        "parse_access_log": _on_times(_without_zone),
        "parse_access_log_find": _on_times(_without_zone, anchored=False),
        "parsed_table": _parsed_table,
        "parse_timestamps": _on_lines(lambda lines: _without_zone(parse.parse_timestamps(lines))),
        "valid_lines": _on_lines(parse.valid_lines),
        "time_slice": _on_times(lambda log: _without_zone(volume.time_slice(log, *SLICE))),
        "parse_quality": _on_times(counts.parse_quality),
        "parse_quality_find": _on_times(counts.parse_quality, anchored=False),
        "status_counts": _on_log(counts.status_counts),
        "status_counts_raw": _on_log(
            lambda log: counts.status_counts(log, keep_malformed=True, by_count=True),
            anchored=False,
        ),
        "status_share": _on_log(counts.status_share),
        "ip_counts": _on_log(counts.ip_counts),
        "ip_counts_raw": _on_log(
            lambda log: counts.ip_counts(log, keep_malformed=True), anchored=False
        ),
        "request_counts": _on_log(counts.request_counts),
        "request_counts_raw": _on_log(
            lambda log: counts.request_counts(log, keep_malformed=True), anchored=False
        ),
        "top_ips": _on_log(counts.top_ips),
        "top_requests": _on_log(counts.top_requests),
        "top_ips_by_first": _on_log(lambda log: counts.top_ips(log, position="event_id")),
        "top_requests_by_first": _on_log(lambda log: counts.top_requests(log, 50, position="event_id")),
        "avg_size_by_status": _on_log(counts.avg_size_by_status),
        "avg_size_by_status_raw": _on_log(
            lambda log: counts.avg_size_by_status(log, keep_malformed=True), anchored=False
        ),
        "time_bounds": _on_times(lambda log: _without_zone(volume.time_bounds(log))),
        "hourly_volume": _on_times(volume.hourly_volume),
        "hourly_volume_raw": _on_times(
            lambda log: volume.hourly_volume(log, keep_malformed=True), anchored=False
        ),
        "volume_1m": _on_times(lambda log: volume.volume(log, "1m")),
        "volume_5m": _on_times(lambda log: volume.volume(log, "5m")),
        "volume_15m": _on_times(lambda log: volume.volume(log, "15m")),
        "volume_1h": _on_times(lambda log: volume.volume(log, "1h")),
        "access_report": _on_log(report.report_table),
        "access_report_by_first": _on_log(lambda log: report.report_table(log, 25, position="event_id")),
        "summary_report": _on_log(report.summary_table),
        "slice_volume": _slice("volume"),
        "slice_status_share": _slice("status_share"),
        "slice_top_ips": _slice("top_ips"),
        "slice_top_requests": _slice("top_requests"),
        "rollup_volume": _rollup_slice("volume"),
        "rollup_status_share": _rollup_slice("status_share"),
        "rollup_top_ips": _rollup_slice("top_ips"),
        "rollup_top_requests": _rollup_slice("top_requests"),
        "sql_top_ips": _sql_top_ips,
        "stream_status_counts": _stream_status_counts,
        "stream_ip_counts": _on_stream_counts(
            results.running_ip_counts, ["ip"], _largest_first("count", "ip")
        ),
        "stream_top_ips": _stream_top(results.running_ip_counts),
        "stream_request_counts": _on_stream_counts(
            results.running_request_counts, ["request"], _largest_first("count", "request")
        ),
        "stream_top_requests": _stream_top(results.running_request_counts),
        "stream_avg_size": _on_stream(
            results.running_mean_size, _largest_first("average_response_size", "status")
        ),
        "stream_hourly_volume": _on_stream(
            results.running_hourly_volume, lambda hours: hours.orderBy("hour"), with_time=True
        ),
        "stream_top_lists": _stream_top_lists,
        "stream_closed_hours": _stream_closed_hours,
        "stream_closed_volume": _stream_closed_volume,
        "stream_parsed_table": _stream_parsed_table,
        "stream_sql_top_ips": _stream_sql_top_ips,
        "stream_access_report": _on_stream_counts(
            results.running_sections, ["section", "key"], report.top_of_sections
        ),
    }
