from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clftally import hourly_volume, parse_access_log, time_bounds, time_slice, volume
from clftally.functions import buckets
from clftally.operators import volume as volume_module
from tests.samples import line, rows

FREQUENCY = {"1m": "1min", "5m": "5min", "15m": "15min", "1h": "1h"}


def at(moment):
    return moment.strftime("%d/%b/%Y:%H:%M:%S +0000")


def log_of(lines_of, stamps, *extra):
    return parse_access_log(lines_of([line(stamp=stamp) for stamp in stamps] + list(extra)))


def moments(count, spread_hours, seed):
    draw = random.Random(seed)
    first = datetime(2024, 2, 28, 22, 7, 3)
    return [first + timedelta(seconds=draw.randrange(spread_hours * 3600)) for _ in range(count)]


@pytest.mark.parametrize("bucket", FREQUENCY)
def test_filled_volume_equals_resampling(lines_of, bucket):
    times = moments(60, 30, seed=1)
    log = log_of(lines_of, map(at, times), line(stamp="bad"), "junk")
    want = pd.Series(1, index=pd.DatetimeIndex(times)).resample(FREQUENCY[bucket]).size()
    got = volume(log, bucket)
    assert got.dtypes == [("bucket", "timestamp_ntz"), ("requests", "bigint")]
    assert rows(got) == list(zip(want.index.to_pydatetime(), want))
    assert 0 in set(want) or bucket == "1h"

    observed = rows(volume(log, bucket, fill_gaps=False))
    assert observed == [(start, n) for start, n in rows(got) if n]


def test_blocks_of_the_series_fit_together(lines_of, monkeypatch):
    times = moments(25, 40, seed=2)
    log = log_of(lines_of, map(at, times))
    whole = rows(volume(log, "15m"))
    for size in (1, 2, 7):
        monkeypatch.setattr(volume_module, "_BLOCK", size)
        assert rows(volume(log, "15m")) == whole


def test_one_bad_year_is_filled_too(lines_of):
    log = log_of(lines_of, ["01/Jan/0999:00:00:00 +0000", "01/Jan/2025:00:00:00 +0000"])
    filled = volume(log, "1h")
    days = (datetime(2025, 1, 1) - datetime(999, 1, 1)).days
    assert filled.count() == days * 24 + 1
    assert filled.agg(F.sum("requests")).first()[0] == 2


def test_no_instants(lines_of):
    log = log_of(lines_of, ["bad"], "junk")
    assert rows(volume(log, "5m")) == [] == rows(hourly_volume(log))
    assert rows(time_bounds(log)) == [(None, None)]
    assert rows(hourly_volume(log, keep_malformed=True)) == [(None, None, 2)]


def test_buckets_follow_the_wall_clock_of_the_zone(spark, lines_of):
    log = log_of(
        lines_of,
        ["08/Nov/2025:05:40:00 +0530", "08/Nov/2025:05:20:00 +0530", "08/Nov/2025:00:00:00 +0000"],
    )
    utc = [(datetime(2025, 11, 7, 23), 1), (datetime(2025, 11, 8), 2)]
    india = [(datetime(2025, 11, 8, 5), 3, 19800)]
    try:
        for session_zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            assert rows(volume(log, "1h")) == utc
            assert rows(volume(log, "1h", zone="Asia/Kolkata")) == india
            assert rows(hourly_volume(log).select("hour", "count")) == utc
            assert rows(hourly_volume(log, zone="Asia/Kolkata")) == [
                (datetime(2025, 11, 8, 5), "2025-11-08 05:00:00", 3, 19800)
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def by_hand(instants, width, zone):
    """Buckets of an index in the zone: instants since the last full wall-clock bucket or change of the offset."""
    zone = ZoneInfo(zone)

    def start(at):
        local = datetime.fromtimestamp(at, zone)
        begin = at - int(at + local.utcoffset().total_seconds()) % width
        while datetime.fromtimestamp(begin, zone).utcoffset() != local.utcoffset():
            begin += 1
        return begin

    counts = Counter(map(start, instants))
    every = sorted({start(at) for at in range(min(counts), max(counts) + 1, 60)})
    shown = lambda at: datetime.fromtimestamp(at, zone)
    return [(shown(at).replace(tzinfo=None), counts[at], int(shown(at).utcoffset().total_seconds())) for at in every]


@pytest.mark.parametrize("bucket", ["15m", "1h"])
@pytest.mark.parametrize(
    "zone, change",
    [
        ("Europe/Berlin", datetime(2025, 10, 26, 1)),
        ("Europe/Berlin", datetime(2025, 3, 30, 1)),
        ("Australia/Lord_Howe", datetime(2025, 4, 5, 15)),
        ("Australia/Lord_Howe", datetime(2025, 10, 4, 15, 30)),
        ("Asia/Kathmandu", datetime(2025, 10, 4, 15, 30)),
    ],
)
def test_clock_changes(lines_of, zone, change, bucket, monkeypatch):
    draw = random.Random(7)
    times = [change + timedelta(seconds=draw.randrange(-5 * 3600, 5 * 3600)) for _ in range(30)]
    times += [change - timedelta(seconds=1), change, change + timedelta(minutes=30)]
    log = log_of(lines_of, map(at, times))
    width = buckets.width_of(bucket)
    want = by_hand([int(t.replace(tzinfo=timezone.utc).timestamp()) for t in times], width, zone)
    for size in (4096, 3):
        monkeypatch.setattr(volume_module, "_BLOCK", size)
        got = volume(log, bucket, zone=zone)
        assert got.columns == ["bucket", "requests", "offset"] and rows(got) == want
    assert rows(volume(log, bucket, fill_gaps=False, zone=zone)) == [row for row in want if row[1]]
    if bucket == "1h":
        hours = [(hour, str(hour), n, offset) for hour, n, offset in want if n]
        assert rows(hourly_volume(log, zone=zone)) == hours


@pytest.mark.parametrize("change", ["2025-10-26", "2025-03-30"])
def test_a_zoned_index_resampled(lines_of, change):
    first = pd.Timestamp(change, tz="Europe/Berlin")
    draw = random.Random(8)
    index = pd.DatetimeIndex([first + timedelta(seconds=draw.randrange(24 * 3600)) for _ in range(40)])
    want = pd.Series(1, index=index).resample("1h").size()
    log = log_of(lines_of, [moment.tz_convert("UTC").strftime("%d/%b/%Y:%H:%M:%S +0000") for moment in index])
    shown = [(m.tz_localize(None).to_pydatetime(), n, int(m.utcoffset().total_seconds())) for m, n in want.items()]
    assert rows(volume(log, "1h", zone="Europe/Berlin")) == shown


def test_instants_before_1970_and_bucket_edges(lines_of):
    log = log_of(
        lines_of,
        ["31/Dec/1969:23:59:59 +0000", "01/Jan/1970:00:00:00 +0000", "01/Jan/1970:00:04:59 +0000"],
    )
    assert rows(volume(log, "5m")) == [
        (datetime(1969, 12, 31, 23, 55), 1),
        (datetime(1970, 1, 1), 2),
    ]
    days = log.select(buckets.utc_day(F.col("ts")).cast("string"))
    assert rows(days) == [("1969-12-31",), ("1970-01-01",), ("1970-01-01",)]


def test_hours_without_requests_are_left_out(lines_of):
    log = log_of(
        lines_of, ["01/Mar/2024:01:00:00 +0000", "01/Mar/2024:04:59:59 +0000", "bad"], "junk"
    )
    hours = [
        (datetime(2024, 3, 1, 1), "2024-03-01 01:00:00", 1),
        (datetime(2024, 3, 1, 4), "2024-03-01 04:00:00", 1),
    ]
    assert rows(hourly_volume(log)) == hours
    assert rows(hourly_volume(log, keep_malformed=True)) == [(None, None, 2), *hours]


def test_range_includes_both_ends_and_never_rows_without_instant(lines_of):
    times = [datetime(2025, 11, 8, 0, 0, second) for second in range(1, 8)]
    log = log_of(lines_of, map(at, times), line(stamp="bad"), "junk")

    def seconds(**edges):
        return [row[0] for row in time_slice(log, **edges).select(F.second("ts")).collect()]

    assert seconds() == [1, 2, 3, 4, 5, 6, 7]
    assert seconds(start="2025-11-08 00:00:03", end="2025-11-08 00:00:05") == [3, 4, 5]
    assert seconds(start=datetime(2025, 11, 8, 0, 0, 6)) == [6, 7]
    east = timezone(timedelta(hours=2))
    assert seconds(end=datetime(2025, 11, 8, 2, 0, 2, tzinfo=east)) == [1, 2]
    assert seconds(start=F.lit("2025-11-08 00:00:07").cast("timestamp")) == [7]


def test_unknown_bucket(lines_of):
    with pytest.raises(ValueError, match="2m"):
        volume(log_of(lines_of, []), "2m")
