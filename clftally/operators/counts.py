"""Counts, shares, means and top lists over parsed rows.

Each groups on the map side first, so a key that holds a large part of the log reaches the shuffle as one
row per task. ``keep_malformed`` counts lines that are no log record too: status NULL, other keys empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clftally.operators.parse import keep_valid


def count_by(parsed: DataFrame, key: str, keep_malformed: bool = False) -> DataFrame:
    """Rows per key, unsorted."""
    return keep_valid(parsed, keep_malformed).groupBy(key).count()


def status_counts(
    parsed: DataFrame, keep_malformed: bool = False, by_count: bool = False
) -> DataFrame:
    """Requests per status, by status or by falling count."""
    counts = count_by(parsed, "status", keep_malformed)
    return counts.orderBy(F.desc("count"), "status") if by_count else counts.orderBy("status")


def status_share(parsed: DataFrame) -> DataFrame:
    """Count and share of each status, with the labels and the scale a chart of them needs.

    The total is a window over the counted statuses. Their number cannot exceed 1,000 (three digits), so
    this gathers no more rows than that.
    """
    return share_of(count_by(parsed.filter(F.col("status").isNotNull()), "status", keep_malformed=True))


def share_of(counts: DataFrame) -> DataFrame:
    """The same from counted statuses: ``status`` and ``count``."""
    everything = Window.partitionBy()
    quarters = F.col("percent") * 4
    share = counts.withColumn(
        "percent", F.col("count") / F.sum("count").over(everything) * 100
    ).withColumn("scale", F.col("percent") / F.max("percent").over(everything))
    return share.select(
        "status",
        F.col("status").cast("string").alias("status_label"),
        "count",
        "percent",
        # Halves that a double holds exactly go to the even digit.
        F.format_string("%.1f%%", F.when(quarters == F.floor(quarters), F.bround("percent", 1)).otherwise(F.col("percent"))).alias("percent_label"),
        "scale",
    ).orderBy("status")


def ip_counts(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Requests per client address, most frequent first."""
    return count_by(parsed, "ip", keep_malformed).orderBy(F.desc("count"), "ip")


def request_counts(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Requests per request line, most frequent first."""
    return count_by(parsed, "request", keep_malformed).orderBy(F.desc("count"), "request")


def top_ips(
    parsed: DataFrame, n: int = 10, keep_malformed: bool = False, position: str | None = None
) -> DataFrame:
    """The ``n`` most frequent client addresses; ties by address, or see `top_by`."""
    return top_by(parsed, "ip", n, keep_malformed, position)


def top_requests(
    parsed: DataFrame, n: int = 10, keep_malformed: bool = False, position: str | None = None
) -> DataFrame:
    """The ``n`` most frequent request lines; ties by request, or see `top_by`."""
    return top_by(parsed, "request", n, keep_malformed, position)


def top_by(
    parsed: DataFrame, key: str, n: int = 10, keep_malformed: bool = False, position: str | None = None
) -> DataFrame:
    """The ``n`` most frequent keys; ties by key, or by first occurrence if ``position`` names a column.

    ``position`` orders the rows, such as the ``line_number`` of `number_lines`. The least one of each key goes through
    the partial aggregation with its count, and each task still keeps ``n`` rows. Keys that have no position come last.
    """
    if position is None:
        return count_by(parsed, key, keep_malformed).orderBy(F.desc("count"), key).limit(n)
    counted = keep_valid(parsed, keep_malformed).groupBy(key).agg(
        F.count("*").alias("count"), F.min(position).alias("_first")
    )
    return counted.orderBy(F.desc("count"), F.asc_nulls_last("_first"), key).limit(n).select(key, "count")


def mean_size() -> Column:
    """Mean of ``size`` in a group; NULL without known sizes.

    The sum is kept as a decimal: sums of doubles depend on the order of adding once they pass 2^53.
    """
    total = F.sum(F.col("size").cast("decimal(20,0)")).cast("double")
    return F.when(F.count("size") > 0, total / F.count("size")).alias("average_response_size")


def mean_size_by_status(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Mean response size per status, unsorted; unknown sizes do not count."""
    return (
        keep_valid(parsed, keep_malformed)
        .groupBy("status")
        .agg(mean_size())
    )


def avg_size_by_status(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Mean response size per status, largest first."""
    return mean_size_by_status(parsed, keep_malformed).orderBy(
        F.desc("average_response_size"), "status"
    )


def parse_quality(parsed: DataFrame) -> DataFrame:
    """One row of counters: how many lines there are, and how many have each typed field.

    Needs rows parsed with ``ts``, ``status`` and ``size``. No line parsed, or no stamp read, shows as 0.
    """
    return parsed.agg(
        F.count("*").alias("total_lines"),
        F.count_if("ok").alias("parsed_lines"),
        F.count("ts").alias("with_timestamp"),
        F.count("status").alias("with_status"),
        F.count("size").alias("with_size"),
    )
