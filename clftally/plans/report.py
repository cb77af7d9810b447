"""Report bundles, the one-pass report table, and the SQL view."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clftally.operators import counts, volume
from clftally.operators.parse import keep_valid

VIEWER_SECTIONS = ("volume", "status_share", "top_ips", "top_requests")

# What `section_counts` counts by.
KEYS = ("status", "ip", "request")

# Groups of keys that are ranked apart first.
_GROUPS = 256


def report(
    parsed: DataFrame,
    top_n: int = 10,
    sections: Sequence[str] = ("status_counts", "top_ips", "top_requests"),
    keep_malformed: bool = False,
    position: str | None = None,
) -> dict[str, DataFrame]:
    """The named sections as separate tables, none of them computed yet.

    ``position`` names a column by which ties in top lists go by first occurrence. Each table is its own job. Give it a stored table (`read_parsed`) to parse only once, or use
    `report_table`, which needs one pass over any input.
    """
    available = {
        "status_counts": lambda: counts.status_counts(parsed, keep_malformed, by_count=True),
        "top_ips": lambda: counts.top_ips(parsed, top_n, keep_malformed, position),
        "top_requests": lambda: counts.top_requests(parsed, top_n, keep_malformed, position),
        "ip_counts": lambda: counts.ip_counts(parsed, keep_malformed),
        "avg_sizes": lambda: counts.avg_size_by_status(parsed, keep_malformed),
    }
    return named_sections(available, sections)


def section_counts(parsed: DataFrame, keep_malformed: bool = False, position: str | None = None) -> DataFrame:
    """Counts by status, by address and by request line in one pass: ``(section, key, count)``.

    With ``position``, a column that orders the rows, also ``first``, the least one of each key. Each row becomes one pair per section, and the pairs are counted before the shuffle. Works on a
    stream too, where it reads the source once for all three.
    """
    pairs = F.array(
        *[F.struct(F.lit(name).alias("section"), F.col(name).cast("string").alias("key")) for name in KEYS]
    )
    kept = keep_valid(parsed, keep_malformed)
    if position is None:
        return kept.select(F.inline(pairs)).groupBy("section", "key").count()
    grouped = kept.select(F.col(position).alias("_position"), F.inline(pairs)).groupBy("section", "key")
    return grouped.agg(F.count("*").alias("count"), F.min("_position").alias("first"))


def top_of_sections(sections: DataFrame, top_n: int = 10) -> DataFrame:
    """Every status, and the ``top_n`` most frequent keys of the other sections.

    Ranking takes two steps. The keys of a section are dealt by hash into `_GROUPS` groups, and each group keeps its
    ``top_n``; then those are ranked together. So no task sees more keys of a section than a share of them, or
    ``top_n`` from each group, however large ``top_n`` is. A status is a group of its own, so all of them rank first.
    Ties go by ``first`` where there is such a column, else by key.
    """
    ties = [F.asc_nulls_last("first"), F.col("key")] if "first" in sections.columns else [F.col("key")]
    group = F.when(F.col("section") == "status", F.col("key"))
    first = F.desc("count"), *ties
    in_group = Window.partitionBy("section", group, F.pmod(F.xxhash64("key"), F.lit(_GROUPS))).orderBy(*first)
    in_section = Window.partitionBy("section", group).orderBy(*first)
    ranked = sections
    for order in (in_group, in_section):
        ranked = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_n).drop("place")
    return ranked.orderBy("section", *first)


def report_table(
    parsed: DataFrame, top_n: int = 10, keep_malformed: bool = False, position: str | None = None
) -> DataFrame:
    """Status counts, top addresses and top requests as one table, from one pass over the rows.

    With ``position`` ties go by first occurrence, which ``first`` shows.
    """
    return top_of_sections(section_counts(parsed, keep_malformed, position), top_n)


def summary_table(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Status counts, all address counts and mean sizes per status, from one pass over the rows.

    One row per section and key: ``section, key, count, average_response_size``; the mean is NULL but in the
    section ``avg_sizes``, where unknown sizes do not enter it. Each row of the log becomes one pair for its status
    and one for its address, which are counted before the shuffle.
    """
    as_text = lambda name: F.col(name).cast("string").alias("key")
    pairs = F.array(
        F.struct(F.lit("status").alias("section"), as_text("status"), F.col("size")),
        F.struct(F.lit("ip_counts").alias("section"), as_text("ip"), F.lit(None).cast("bigint").alias("size")),
    )
    counted = (
        keep_valid(parsed, keep_malformed)
        .select(F.inline(pairs))
        .groupBy("section", "key")
        .agg(F.count("*").alias("count"), counts.mean_size())
    )
    no_mean = F.lit(None).cast("double")
    by_status = F.array(
        F.struct(F.lit("status_counts").alias("section"), no_mean.alias("mean")),
        F.struct(F.lit("avg_sizes").alias("section"), F.col("average_response_size").alias("mean")),
    )
    by_ip = F.array(F.struct(F.col("section"), no_mean.alias("mean")))
    named = F.explode(F.when(F.col("section") == "status", by_status).otherwise(by_ip)).alias("named")
    return counted.select(named, "key", "count").select(
        "named.section", "key", "count", F.col("named.mean").alias("average_response_size")
    )


def slice_report(
    parsed: DataFrame,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    bucket: str = "5m",
    top_n: int = 10,
    zone: str = "UTC",
    sections: Sequence[str] = VIEWER_SECTIONS,
    day: str | None = None,
) -> dict[str, DataFrame]:
    """The tables of the log viewer for a time range: volume, status share, top lists.

    ``day`` names a stored table's column of days; see `volume.time_slice`.
    """
    rows = volume.time_slice(parsed, start, end, day)
    available = {
        "volume": lambda: volume.volume(rows, bucket, zone=zone),
        "status_share": lambda: counts.status_share(rows),
        "top_ips": lambda: counts.top_ips(rows, top_n),
        "top_requests": lambda: counts.top_requests(rows, top_n),
    }
    return named_sections(available, sections)


def register_view(parsed: DataFrame, name: str = "access_log") -> None:
    """Make the parsed log available to ``spark.sql`` under a name."""
    parsed.createOrReplaceTempView(name)


def named_sections(
    available: dict[str, Callable[[], DataFrame]], sections: Sequence[str]
) -> dict[str, DataFrame]:
    unknown = set(sections) - set(available)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return {name: available[name]() for name in sections}
