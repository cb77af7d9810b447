"""A store of counts per minute beside the parsed table, for the viewer.

For each UTC minute and each status, address and request line the store holds how often it occurs. Such counts add
up, so a time range needs the rows of the log only for a minute that it cuts. The store lies in one folder per day and
section, and a refresh counts again only the days whose files in the table have changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.functions import buckets
from clftally.operators import counts, volume
from clftally.plans import report
from clftally.sources.parsed import DAY, read_parsed

COUNTS = "minute timestamp, key string, count long, section string, day date"
MARKS = "mark long, day date"

_MINUTE = 60_000_000


def refresh(spark: SparkSession, table: str, store: str) -> list[date]:
    """Bring the store up to date with the parsed table; returns the days that were counted again.

    A day's mark, made of the names, sizes and times of its files, is taken before its rows are read and stored after
    its counts, so a refresh that fails, or meets a table that is being written, leaves days to be counted again and
    never takes them for done. The list of days passes through the driver, a row per day. Days are replaced, not
    removed: nothing in this package takes a day out of the table. Let no one read a day while it is replaced.
    """
    stale = stale_days(spark, table, store).collect()
    days = sorted(row.day for row in stale)
    if days:
        rows = read_parsed(spark, table).filter(F.col(DAY).isin(days))
        counted = _pairs(rows, report.KEYS).groupBy("day", "section", "minute", "key").agg(F.count("*").alias("count"))
        _replace(counted.hint("rebalance", "day", "section"), f"{store}/counts", ["day", "section"], ["minute", "key"])
        marks = spark.createDataFrame([(row.mark, row.day) for row in stale], MARKS)
        _replace(marks.repartition(1), f"{store}/marks", ["day"], [])
    return days


def stale_days(spark: SparkSession, table: str, store: str) -> DataFrame:
    """``day`` and its present ``mark``, for the days of the table that the store has not, or not as they are now."""
    file = [F.col(f"_metadata.{name}").alias(name) for name in ("file_path", "file_size", "file_modification_time")]
    files = read_parsed(spark, table).select(DAY, *file).filter(F.col(DAY).isNotNull()).distinct()
    mark = F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))
    present = files.groupBy(DAY).agg(mark.alias("mark"))
    return present.join(_read(spark, f"{store}/marks", MARKS), [DAY, "mark"], "left_anti")


def minute_counts(
    spark: SparkSession,
    table: str,
    store: str,
    start: str | datetime | Column | None = None,
    end: str | datetime | Column | None = None,
    sections: Sequence[str] = report.KEYS,
) -> DataFrame:
    """``minute, section, key, count`` of the rows from ``start`` to ``end``, both included.

    Whole minutes come from the store, and only those that the range cuts are counted from the table's rows, for which
    at most the two days that hold them are read. A key may have several rows of one minute; they add up.
    """
    stored = _read(spark, f"{store}/counts", COUNTS).filter(F.col("section").isin(*sections))
    rows = volume.time_slice(read_parsed(spark, table), start, end, DAY)
    minute, outside, outside_day = F.col("minute"), F.lit(False), F.lit(False)
    if start is not None:
        micros = F.unix_micros(buckets.instant_literal(start))
        whole = F.timestamp_micros(micros + F.pmod(-micros, F.lit(_MINUTE).cast("bigint")))
        stored = stored.filter((minute >= whole) & (F.col(DAY) >= buckets.utc_day(whole)))
        outside, outside_day = F.col("ts") < whole, F.col(DAY) <= buckets.utc_day(whole)
    if end is not None:
        behind = F.unix_micros(buckets.instant_literal(end)) + 1
        whole = F.timestamp_micros(behind - F.pmod(behind, F.lit(_MINUTE).cast("bigint")))
        stored = stored.filter((minute < whole) & (F.col(DAY) <= buckets.utc_day(whole)))
        # If the range lies within one minute, nothing is stored of it, and all of it is outside.
        outside, outside_day = outside | (F.col("ts") >= whole), outside_day | (F.col(DAY) >= buckets.utc_day(whole))
    edges = _pairs(rows.filter(outside & outside_day), sections).withColumn("count", F.lit(1).cast("bigint"))
    names = ["minute", "section", "key", "count"]
    return stored.select(*names).unionByName(edges.select(*names))


def slice_report(
    spark: SparkSession,
    table: str,
    store: str,
    start: str | datetime | Column | None = None,
    end: str | datetime | Column | None = None,
    bucket: str = "5m",
    top_n: int = 10,
    zone: str = "UTC",
    sections: Sequence[str] = report.VIEWER_SECTIONS,
) -> dict[str, DataFrame]:
    """The tables of `report.slice_report`, from the store; ``zone`` must be whole minutes off UTC."""

    def counted(section: str) -> DataFrame:
        return minute_counts(spark, table, store, start, end, [section])

    def requests() -> DataFrame:
        width = buckets.width_of(bucket)
        first = buckets.start_second(F.col("minute"), width, zone).alias("_start")
        return volume.volume_of(counted("status").groupBy(first).agg(F.sum("count").alias("requests")), width, zone=zone)

    def share() -> DataFrame:
        status = F.col("key").cast("int").alias("status")
        return counts.share_of(counted("status").filter("key IS NOT NULL").groupBy(status).agg(F.sum("count").alias("count")))

    def top(section: str) -> DataFrame:
        summed = counted(section).groupBy(F.col("key").alias(section)).agg(F.sum("count").alias("count"))
        return summed.orderBy(F.desc("count"), section).limit(top_n)

    available = {
        "volume": requests,
        "status_share": share,
        "top_ips": lambda: top("ip"),
        "top_requests": lambda: top("request"),
    }
    return report.named_sections(available, sections)


def _pairs(rows: DataFrame, sections: Sequence[str]) -> DataFrame:
    """``day, minute, section, key`` of every row with an instant, one for each section."""
    minute = F.timestamp_seconds(buckets.start_second(F.col("ts"), 60)).alias("minute")
    pairs = [F.struct(F.lit(name).alias("section"), F.col(name).cast("string").alias("key")) for name in sections]
    return rows.filter("ok AND ts IS NOT NULL").select(DAY, minute, F.inline(F.array(*pairs)))


def _replace(rows: DataFrame, path: str, folders: list[str], order: list[str]) -> None:
    """Write rows in place of what is stored in the same folders."""
    writer = rows.sortWithinPartitions(*folders, *order).write.partitionBy(*folders).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored, or no rows if nothing has been yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
