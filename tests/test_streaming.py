from __future__ import annotations

import time
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clftally import (
    avg_size_by_status,
    chunk_lines,
    hourly_volume,
    ip_counts,
    parse_access_log,
    request_counts,
    status_counts,
    stream_lines,
    top_ips,
)
from clftally.plans.report import report_table, section_counts, top_of_sections
from clftally.sources import event_lines
from clftally.streaming import jobs, results
from tests.samples import line, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return event_lines.as_log_lines(event_lines.read_events(spark, SF))


@pytest.fixture(scope="module")
def batch(lines):
    return parse_access_log(lines, anchored=False)


@pytest.fixture(scope="module")
def feed(lines, tmp_path_factory):
    """The log as files of 150 lines."""
    folder = str(tmp_path_factory.mktemp("feed") / "lines")
    chunk_lines(lines, folder, lines_per_file=150)
    return folder


@pytest.fixture
def stream(spark, feed):
    """The parsed log, two files at a time."""
    return parse_access_log(stream_lines(spark, feed, max_files_per_trigger=2), anchored=False)


def same(left, right):
    return sorted(rows(left), key=repr) == sorted(rows(right), key=repr)


RESULTS = {
    "status": (results.running_status_counts, lambda log: status_counts(log, True)),
    "ip": (results.running_ip_counts, lambda log: ip_counts(log, True)),
    "request": (results.running_request_counts, lambda log: request_counts(log, True)),
    "size": (results.running_mean_size, avg_size_by_status),
    "hour": (results.running_hourly_volume, lambda log: hourly_volume(log, True)),
    "sections": (results.running_sections, lambda log: section_counts(log, True)),
}


def test_every_running_result_equals_its_batch_result(spark, stream, batch, tmp_path):
    running = {name: build(stream) for name, (build, _) in RESULTS.items()}
    tables = jobs.run_together(spark, running, str(tmp_path))
    for name, (_, twin) in RESULTS.items():
        assert same(tables[name], twin(batch)), name
    assert rows(results.top_rows(tables["ip"])) == rows(top_ips(batch, 10, True))
    assert rows(top_of_sections(tables["sections"], 3)) == rows(report_table(batch, 3, True))
    assert not spark.streams.active


def test_micro_batch_size_does_not_matter_and_progress_is_reported(spark, feed, batch, tmp_path):
    for files, batches in ((1, 7), (100, 1)):
        parsed = parse_access_log(stream_lines(spark, feed, files), anchored=False)
        query = jobs.start_running_result(
            results.running_status_counts(parsed), f"{tmp_path}/{files}", name=f"status_{files}"
        )
        assert jobs.await_and_stop([query])
        seen = [p for p in jobs.progress(query) if p["rows"]]
        assert len(seen) == batches and sum(p["rows"] for p in seen) == 1000
        assert all(p["rows_per_second"] > 0 for p in seen)
        assert same(jobs.read_result(spark, f"{tmp_path}/{files}"), status_counts(batch, True))


def test_top_rows_within_the_query_keep_the_result_table_small(spark, stream, batch, tmp_path):
    top = results.top_rows(results.running_ip_counts(stream), 4)
    table = jobs.run(spark, top, str(tmp_path))
    assert table.count() == 4
    assert rows(results.top_rows(table, 4)) == rows(top_ips(batch, 4, True))


def test_a_result_is_never_read_half_written(spark, feed, batch, tmp_path):
    """A batch that began to write but left no note does not change what is read."""
    folder = str(tmp_path)
    parsed = parse_access_log(stream_lines(spark, feed, 3), anchored=False)
    table = jobs.run(spark, results.running_status_counts(parsed), folder)
    done = len(list(Path(folder, "checkpoint", "commits").glob("[0-9]*")))
    batch.limit(1).select("status").write.mode("overwrite").parquet(f"{folder}/result/place={done}")
    assert same(jobs.read_result(spark, folder), status_counts(batch, True))
    Path(folder, f"done-{done % 2}", "_SUCCESS").unlink()
    for note in Path(folder, f"done-{done % 2}").glob("*"):
        note.unlink()
    assert same(jobs.read_result(spark, folder), status_counts(batch, True))
    assert same(table, status_counts(batch, True))


def test_a_result_can_be_read_while_more_batches_run(spark, lines_of, tmp_path):
    feed, folder = f"{tmp_path}/feed", f"{tmp_path}/query"
    held = []
    for part in range(4):
        lines_of([line()] * 5).coalesce(1).write.mode("append").text(feed)
        parsed = parse_access_log(stream_lines(spark, feed, 1))
        held.append(jobs.run(spark, results.running_status_counts(parsed), folder))
    assert [rows(table) for table in held] == [[(200, 5 * (part + 1))] for part in range(4)]


def test_nothing_to_read_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no query"):
        jobs.read_result(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no query"):
        jobs.read_counts(spark, str(tmp_path), ["ip"])


def test_an_empty_feed_gives_an_empty_table(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    parsed = parse_access_log(stream_lines(spark, str(feed)))
    table = jobs.run(spark, results.running_status_counts(parsed), f"{tmp_path}/a")
    assert table.dtypes == [("status", "int"), ("count", "bigint")] and table.count() == 0
    table = jobs.run_counts(spark, results.running_ip_counts(parsed), f"{tmp_path}/b", ["ip"])
    assert table.dtypes == [("ip", "string"), ("count", "bigint")] and table.count() == 0
    assert jobs.run_appending(spark, results.closed_hours(parsed, "1 hour"), f"{tmp_path}/c").count() == 0


@pytest.mark.parametrize("compact_every", [2, 100])
def test_changed_keys_only_are_written(spark, lines_of, tmp_path, compact_every):
    feed, folder = f"{tmp_path}/feed", f"{tmp_path}/query"
    held, want = [], {}
    for part in range(7):
        addresses = ["9.9.9.9", f"1.1.1.{part}", f"1.1.1.{part // 2}"]
        lines_of([line(ip=ip) for ip in addresses]).coalesce(1).write.mode("append").text(feed)
        for ip in addresses:
            want[ip] = want.get(ip, 0) + 1
        parsed = parse_access_log(stream_lines(spark, feed, 1))
        query = jobs.start_running_counts(
            results.running_ip_counts(parsed), folder, ["ip"], compact_every=compact_every
        )
        assert jobs.await_and_stop([query])
        held.append((jobs.read_counts(spark, folder, ["ip"]), dict(want)))
        assert dict(rows(held[-1][0])) == want
        (own,) = Path(folder, "changes").glob(f"generation=*/batch={part}")
        assert {row.ip for row in spark.read.parquet(str(own)).collect()} == set(addresses)
    # A result taken before changes were put together once more can still be read.
    assert all(dict(rows(table)) == counts for table, counts in held[-2:])


def test_a_batch_that_runs_again_changes_nothing(spark, lines_of, tmp_path):
    feed, folder = f"{tmp_path}/feed", f"{tmp_path}/query"
    lines_of([line(ip=f"1.1.1.{n % 3}") for n in range(8)]).coalesce(1).write.text(feed)
    running = lambda: results.running_ip_counts(parse_access_log(stream_lines(spark, feed, 1)))
    before = rows(jobs.run_counts(spark, running(), folder, ["ip"]))
    for commit in Path(folder, "checkpoint", "commits").glob("*0*"):
        commit.unlink()
    assert same(jobs.run_counts(spark, running(), folder, ["ip"]), spark.createDataFrame(before, "ip string, count long"))


def test_a_restarted_query_counts_new_files_only(spark, lines_of, tmp_path):
    feed, folder = f"{tmp_path}/feed", f"{tmp_path}/query"
    want = 0
    for part in range(3):
        lines_of([line()] * (part + 1)).coalesce(1).write.mode("append").text(feed)
        want += part + 1
        parsed = parse_access_log(stream_lines(spark, feed, 1))
        table = jobs.run(spark, results.running_status_counts(parsed), folder)
        assert rows(table) == [(200, want)]
    again = jobs.run(spark, results.running_status_counts(parse_access_log(stream_lines(spark, feed))), folder)
    assert rows(again) == [(200, want)]


def test_closed_hours_equal_the_batch_hours_that_are_over(spark, lines, tmp_path):
    """Lines in time order, so none is late."""
    feed = f"{tmp_path}/feed"
    # Shifted offsets would put lines out of order, so only lines stamped in UTC are used.
    steady = lines.filter("event_id % 50 NOT IN (7, 9, 11, 13)")
    chunk_lines(steady.orderBy("event_id").coalesce(1), feed, lines_per_file=200)
    parsed = parse_access_log(stream_lines(spark, feed, max_files_per_trigger=1))
    query = jobs.start_appending(results.closed_hours(parsed, "3 hours"), f"{tmp_path}/query")
    assert jobs.await_and_stop([query])
    got = dict(rows(spark.read.parquet(f"{tmp_path}/query/result")))
    want = dict(rows(hourly_volume(parse_access_log(steady)).select("hour", "count")))
    last = max(want)
    assert set(want) - set(got) <= {hour for hour in want if (last - hour).total_seconds() <= 4 * 3600}
    assert got.items() <= want.items() and len(got) > 100
    assert isinstance(last, datetime)


def test_in_memory_and_console_sinks(spark, stream, batch, tmp_path, capfd):
    name = f"counts_{uuid.uuid4().hex}"
    in_memory = jobs.start_in_memory(results.running_ip_counts(stream), f"{tmp_path}/m", name)
    console = jobs.start_console(results.running_status_counts(stream), f"{tmp_path}/c")
    assert jobs.await_and_stop([in_memory, console])
    top = spark.sql(f"SELECT * FROM {name} ORDER BY count DESC, ip LIMIT 10")
    assert rows(top) == rows(top_ips(batch, 10, True))


def test_a_bounded_wait_stops_only_its_own_queries(spark, stream, tmp_path):
    always = {"processingTime": "1 hour"}
    other = jobs.start_running_result(
        results.running_status_counts(stream), f"{tmp_path}/other", trigger=always
    )
    try:
        mine = jobs.start_running_result(
            results.running_status_counts(stream), f"{tmp_path}/mine", trigger=always
        )
        assert not jobs.await_and_stop([mine], timeout=0.5)
        assert not mine.isActive and other.isActive
    finally:
        other.stop()


def test_the_first_failure_of_several_queries_is_seen_at_once(spark, stream, tmp_path):
    always = {"processingTime": "1 hour"}
    fine = jobs.start_running_result(results.running_status_counts(stream), f"{tmp_path}/fine", trigger=always)
    broken = stream.withColumn("ip", F.raise_error(F.lit("broken on purpose")))
    bad = jobs.start_running_result(results.running_ip_counts(broken), f"{tmp_path}/bad", trigger=always)
    started = time.monotonic()
    with pytest.raises(StreamingQueryException, match="broken on purpose"):
        jobs.await_and_stop([fine, bad], timeout=120)
    assert time.monotonic() - started < 60 and not fine.isActive


def test_closed_hours_of_the_whole_feed(spark, lines, tmp_path):
    """In one pass over lines in time order, just the hours that ended long enough before the last line."""
    feed = f"{tmp_path}/feed"
    steady = lines.filter("event_id % 50 NOT IN (7, 9, 11, 13)")
    chunk_lines(steady.orderBy("event_id").coalesce(1), feed, lines_per_file=2000)
    parsed = parse_access_log(stream_lines(spark, feed))
    got = jobs.run_appending(spark, results.closed_hours(parsed, "3 hours"), f"{tmp_path}/query")
    log = parse_access_log(steady)
    last = log.agg(F.max("ts").cast("timestamp_ntz")).first()[0]
    hours = hourly_volume(log).select("hour", "count")
    want = [row for row in rows(hours) if (last - row[0]).total_seconds() >= 4 * 3600]
    assert sorted(rows(got)) == sorted(want)


def test_top_rows_of_a_key_with_an_odd_name(spark):
    table = spark.createDataFrame([("a", 1), ("b", 3)], ["my `key`", "count"])
    assert rows(results.top_rows(table, 1)) == [("b", 3)]


def test_running_out_of_time_is_an_error(spark, stream, tmp_path):
    with pytest.raises(TimeoutError):
        jobs.run(spark, results.running_status_counts(stream), str(tmp_path), timeout=0.01)
    assert not spark.streams.active


def test_bad_bytes_can_be_dropped_from_a_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "one.log").write_bytes(line(ip="1.1\xff.1").encode("latin-1") + b"\n")
    parsed = parse_access_log(stream_lines(spark, str(feed), drop_invalid_bytes=True))
    table = jobs.run(spark, parsed.groupBy("ip").agg(F.count("*").alias("n")), f"{tmp_path}/query")
    assert rows(table) == [("1.1.1", 1)]
