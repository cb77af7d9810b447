"""Request volume over time, time bounds and time ranges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.functions import buckets
from clftally.operators.parse import evaluate_once

# Buckets per block when the gaps are filled; see `volume`.
_BLOCK = 4096


def hourly_counts(
    parsed: DataFrame, keep_malformed: bool = False, zone: str = "UTC"
) -> DataFrame:
    """Requests per hour that has any, unsorted.

    ``keep_malformed`` keeps the group of rows without an instant, as a NULL hour. In a zone other than UTC ``offset``
    follows, the seconds that its clock is ahead of UTC, which tells apart an hour that the clock shows twice.
    """
    return _hourly_counts(parsed, keep_malformed, zone).drop("_start")


def _hourly_counts(parsed: DataFrame, keep_malformed: bool, zone: str) -> DataFrame:
    rows = parsed if keep_malformed else parsed.filter(F.col("ts").isNotNull())
    counts = rows.groupBy(buckets.start_second(F.col("ts"), 3600, zone).alias("_start")).count()
    hour = buckets.wall_clock(F.col("_start"), zone)
    return counts.select(
        "_start",
        hour.alias("hour"),
        F.date_format(hour, "yyyy-MM-dd HH:mm:ss").alias("hour_str"),
        "count",
        *_offset(zone),
    )


def hourly_volume(
    parsed: DataFrame, keep_malformed: bool = False, zone: str = "UTC"
) -> DataFrame:
    """Requests per hour that has any, in time order; columns as in `hourly_counts`."""
    return _hourly_counts(parsed, keep_malformed, zone).orderBy("_start").drop("_start")


def volume(
    parsed: DataFrame, bucket: str = "5m", fill_gaps: bool = True, zone: str = "UTC"
) -> DataFrame:
    """Requests per 1m, 5m, 15m or 1h bucket, in time order.

    With ``fill_gaps`` every bucket from the first to the last appears, empty ones with 0. The full
    series is made in two steps, blocks of buckets and then the buckets of each block, so no task holds
    more than one block however far apart the first and last instants are. In a zone other than UTC ``offset``
    follows, as in `hourly_counts`.
    """
    width = buckets.width_of(bucket)
    counts = (
        parsed.filter(F.col("ts").isNotNull())
        .groupBy(buckets.start_second(F.col("ts"), width, zone).alias("_start"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("_start").isNotNull())
    )
    return volume_of(counts, width, fill_gaps, zone)


def volume_of(counts: DataFrame, width: int, fill_gaps: bool = True, zone: str = "UTC") -> DataFrame:
    """The same from counted buckets: ``_start``, as `buckets.start_second` gives it, and ``requests``."""
    if fill_gaps:
        series = _every_bucket(counts, width, zone)
        counts = series.join(counts, "_start", "left").select(
            "_start", F.coalesce("requests", F.lit(0).cast("bigint")).alias("requests")
        )
    return counts.orderBy("_start").select(
        buckets.wall_clock(F.col("_start"), zone).alias("bucket"), "requests", *_offset(zone)
    )


def time_bounds(parsed: DataFrame) -> DataFrame:
    """First and last instant; NULL in both when there is none."""
    return parsed.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def time_slice(
    parsed: DataFrame,
    start: str | datetime | Column | None = None,
    end: str | datetime | Column | None = None,
    day: str | None = None,
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an open end means no limit there.

    Rows without an instant are never part of a range. ``day`` names a column that holds the UTC day of the
    instant, such as the stored table's: the range is put on that as well, so only the folders of these days
    are read.
    """
    ts = F.col("ts")
    rows = parsed.filter(ts.isNotNull())
    for edge, keeps in ((start, Column.__ge__), (end, Column.__le__)):
        if edge is None:
            continue
        limit = buckets.instant_literal(edge)
        rows = rows.filter(keeps(ts, limit))
        if day:
            rows = rows.filter(keeps(F.col(day), buckets.utc_day(limit)))
    return rows


def _offset(zone: str) -> list[Column]:
    return [] if zone == "UTC" else [buckets.offset_at(F.col("_start"), zone).alias("offset")]


def _every_bucket(counts: DataFrame, width: int, zone: str) -> DataFrame:
    """All bucket starts between the first and the last of ``counts``.

    They are found from instants that are ``width`` apart. No bucket is longer, so each has one of them, but for those
    that a change of the offset cut short: there the two buckets before are looked up as well.

    The bounds also use the counts, which are never negative: this keeps both uses of ``counts`` the
    same query, so Spark runs it once and reuses its shuffle.
    """
    span = width * _BLOCK
    block_of = lambda second: F.floor(second / span)
    bounds = counts.agg(
        F.min("_start").alias("lo"), F.max("_start").alias("hi"), F.sum("requests").alias("total")
    ).filter(F.col("total") > 0)
    blocks = bounds.select(
        "lo", "hi", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi") + width - 1))).alias("block")
    ).repartition("block")
    step = F.lit(width).cast("bigint")
    grid = lambda second: second - F.pmod(second, step)
    first = F.greatest(grid(F.col("lo")), F.col("block") * span)
    last = F.least(grid(F.col("hi") + width - 1), F.col("block") * span + (span - width))
    marks = blocks.select("lo", "hi", F.explode(F.sequence(first, last, step)).alias("_start"))
    if zone == "UTC":
        return marks.select("_start")
    start_of = lambda second: buckets.start_of(second, width, zone)
    rows = evaluate_once(marks, start_of(F.col("_start")), "_at").withColumn("_before", start_of(F.col("_start") - width))
    rows = evaluate_once(rows, start_of(F.col("_at") - 1), "_cut")
    cut_short = F.array_distinct(F.array("_at", "_cut", start_of(F.col("_cut") - 1)))
    new = F.when(F.col("_at") - F.col("_before") == width, F.array("_at")).otherwise(
        F.filter(cut_short, lambda at: at > F.col("_before"))
    )
    return rows.select("lo", "hi", F.explode(new).alias("_start")).filter("_start BETWEEN lo AND hi").select("_start")
