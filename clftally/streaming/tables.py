"""The parsed log as a table that a stream fills, each line once.

Every micro-batch writes its rows to a folder of its own, by UTC day, and then a note that it is complete; one that runs
again after a failure writes the same rows to the same folder. Readers take what the notes name and nothing else, so
they never see part of a batch. Late lines are rows of their day like any others. From time to time the batches since
the last time are put together into one folder with files of even size; what has been put together is not written again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clftally.functions.buckets import utc_day
from clftally.sources.parsed import DAY, PARSED_SCHEMA, TABLE_SCHEMA
from clftally.streaming import jobs

# Columns that name folders: raw batches or batches put together, the number of the putting together, the batch.
_FOLDERS = ("kind", "number", "batch")
_RAW, _MERGED = "raw", "merged"


def start_parsed_table(
    parsed: DataFrame,
    folder: str,
    name: str | None = None,
    trigger: Mapping = jobs.AVAILABLE_NOW,
    compact_every: int = jobs.COMPACT_EVERY,
) -> StreamingQuery:
    """Start a query that adds the rows of a parsed stream to the table in ``folder``, which `read_table` reads."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = jobs.noted(spark, f"{folder}/merged-done")
        if merged and batch_id <= int(merged.batch):
            return  # Part of what has been put together, which is complete.
        number = merged.number + 1 if merged else 0
        rows = batch.select(*PARSED_SCHEMA.names).withColumn(DAY, utc_day(F.col("ts")))
        _write(rows.sortWithinPartitions(DAY, "ts"), _place(folder, _RAW, number, batch_id))
        jobs.note(spark, f"{folder}/done", batch_id, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact_table(spark, folder)

    spark = parsed.sparkSession
    if jobs.noted(spark, f"{folder}/done") is None:
        jobs.note(spark, f"{folder}/done", -1, -1)
    writer = parsed.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger)
    return (writer.queryName(name) if name else writer).outputMode("append").foreachBatch(save).start()


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches that are complete, with their ``day``; give that to `time_slice` to read only its days.

    It can be read until batches have been put together twice more.
    """
    return _rows(spark, folder).select(*TABLE_SCHEMA.names)


def compact_table(spark: SparkSession, folder: str) -> None:
    """Put the batches since the last time together; a day with most of the rows is split over many files.

    The folders of those put together the time before are emptied; the rest stays for readers that have begun.
    """
    last, merged = jobs.noted(spark, f"{folder}/done"), jobs.noted(spark, f"{folder}/merged-done")
    if last is None or int(last.batch) < 0 or merged and int(merged.batch) >= int(last.batch):
        return
    number = merged.number + 1 if merged else 0
    rows = _rows(spark, folder).filter(F.col("kind") == _RAW).select(*TABLE_SCHEMA.names)
    _write(rows.hint("rebalance", DAY).sortWithinPartitions(DAY, "ts"), _place(folder, _MERGED, number, 0))
    jobs.note(spark, f"{folder}/merged-done", int(last.batch), number)
    if number:
        nothing = spark.createDataFrame([], T.StructType([*TABLE_SCHEMA.fields, T.StructField("batch", T.IntegerType())]))
        _write(nothing, f"{folder}/rows/kind={_RAW}/number={number - 1}", "batch", DAY)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    last, merged = jobs.noted(spark, f"{folder}/done"), jobs.noted(spark, f"{folder}/merged-done")
    if last is None:
        raise ValueError(f"no query has been started in {folder}")
    whole = T.StructType([*TABLE_SCHEMA.fields, T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in _FOLDERS[1:])])
    if int(last.batch) < 0:
        return spark.createDataFrame([], whole)
    stored = spark.read.schema(whole).parquet(f"{folder}/rows")
    done = merged.number if merged else -1
    together = (F.col("kind") == _MERGED) & (F.col("number") <= done)
    single = (
        (F.col("kind") == _RAW)
        & (F.col("number") > done)
        & (F.col("batch") > (int(merged.batch) if merged else -1))
        & (F.col("batch") <= int(last.batch))
    )
    return stored.filter(together | single)


def _place(folder: str, kind: str, number: int, batch: int) -> str:
    return f"{folder}/rows/kind={kind}/number={number}/batch={batch}"


def _write(rows: DataFrame, place: str, *by: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*(by or (DAY,))).parquet(place)
