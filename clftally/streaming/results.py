"""The running results, as streaming DataFrames over a parsed stream.

A running count keeps one row of state per key for as long as the query runs. That is small for statuses
and hours; addresses and request lines grow with the log, which is why the state lives in RocksDB, and why
`jobs.start_running_counts` writes only the keys that a micro-batch changed.
By default lines that are no log record are counted too, under an empty or NULL key.

The results are unsorted. A full sort within the query would run the stateful step twice per micro-batch,
once to sample the sort's ranges, so it is left to the reader; `top_rows` needs no such sort and can be
part of the query, which then writes no more than the top rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from clftally.functions import buckets
from clftally.operators import counts, volume
from clftally.plans import report


def running_status_counts(parsed: DataFrame, keep_malformed: bool = True) -> DataFrame:
    return counts.count_by(parsed, "status", keep_malformed)


def running_ip_counts(parsed: DataFrame, keep_malformed: bool = True) -> DataFrame:
    return counts.count_by(parsed, "ip", keep_malformed)


def running_request_counts(parsed: DataFrame, keep_malformed: bool = True) -> DataFrame:
    return counts.count_by(parsed, "request", keep_malformed)


def running_mean_size(parsed: DataFrame) -> DataFrame:
    """Mean size per status of valid lines."""
    return counts.mean_size_by_status(parsed)


def running_hourly_volume(parsed: DataFrame, keep_malformed: bool = True) -> DataFrame:
    return volume.hourly_counts(parsed, keep_malformed)


def running_sections(parsed: DataFrame, keep_malformed: bool = True) -> DataFrame:
    """Counts by status, address and request line in one query that reads the stream once."""
    return report.section_counts(parsed, keep_malformed)


def closed_hours(parsed: DataFrame, lateness: str) -> DataFrame:
    """Requests per hour, each emitted once when it can no longer change; for append mode.

    State is dropped with the hour. Lines that come more than ``lateness`` after the latest one may be
    left out, and the last open hours are not emitted, so use `running_hourly_volume` for exact totals.
    """
    hours = (
        parsed.filter(F.col("ts").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("window"))
        .count()
    )
    start = buckets.wall_clock(F.unix_seconds("window.start"))
    return hours.select(start.alias("hour"), "count")


def closed_volume(parsed: DataFrame, lateness: str, bucket: str = "5m") -> DataFrame:
    """Requests per bucket with the empty ones, each emitted once when it can no longer change; for append mode.

    The rows are those of the batch `volume.volume` from the first bucket with a request to the last that the
    watermark has passed, however the stream is cut into micro-batches. Lines that come more than ``lateness`` after
    the latest one may be left out, and open buckets are not emitted.

    Buckets are counted first, in parallel and with state for the open ones only. The closed ones, a row each, then
    pass one task that knows the last bucket it has handed on, and fills in what is empty between that and the next
    one, or the watermark.
    """
    width = buckets.width_of(bucket)
    counted = (
        parsed.filter(F.col("ts").isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{width} seconds").alias("window"))
        .agg(F.count("*").alias("requests"))
        .select(F.unix_seconds("window.start").alias("start"), "requests", F.lit(0).alias("log"))
    )
    filled = counted.groupBy("log").transformWithStateInPandas(
        _FilledBuckets(width), "start long, requests long", "append", "eventTime"
    )
    return filled.select(buckets.wall_clock(F.col("start")).alias("bucket"), "requests")


class _FilledBuckets(StatefulProcessor):
    """Hands closed buckets on, with those between them. State: the start of the last one, and one timer."""

    # Buckets handed on at once.
    ROWS = 1 << 16

    def __init__(self, width: int):
        self.width = width

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = {}
        for batch in rows:
            counts.update(zip(batch["start"].tolist(), batch["requests"].tolist()))
        if counts:
            start = self.last.get()[0] + self.width if self.last.exists() else min(counts)
            yield from self._buckets(start, max(counts) + self.width, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark has passed the end of a bucket that had no request."""
        start = self.last.get()[0] + self.width
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        yield from self._buckets(start, closed - (closed - start) % self.width, {})

    def close(self) -> None:
        pass

    def _buckets(self, start: int, end: int, counts: dict[int, int]) -> Iterator[pd.DataFrame]:
        if start >= end:
            return
        for first in range(start, end, self.width * self.ROWS):
            starts = range(first, min(end, first + self.width * self.ROWS), self.width)
            yield pd.DataFrame({"start": starts, "requests": [counts.get(second, 0) for second in starts]})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((end - self.width,))
        self.handle.registerTimer((end + self.width) * 1000)


def top_rows(result: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent keys of a result; on the running query or on its result table."""
    key = result.columns[0].replace("`", "``")
    return result.orderBy(F.desc("count"), F.col(f"`{key}`")).limit(n)
