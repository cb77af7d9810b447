"""Log lines as text files: batch scan, streaming scan, and splitting into files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clftally.operators import numbering
from clftally.sources import shared

# Files that one task writes at most, as Spark numbers them with three digits, and tasks, numbered with five. Within
# these the order of names is the order of files.
_FILES_PER_TASK, _TASKS = 1000, 100_000

_REPLACEMENT = "\ufffd"


def scan_lines(spark: SparkSession, path: str, drop_invalid_bytes: bool = False) -> DataFrame:
    """One row per text line, in column ``value``.

    Bytes that are not UTF-8 show as U+FFFD; ``drop_invalid_bytes`` removes them from their lines.
    """
    lines = spark.read.text(path)
    return _without_invalid_bytes(lines) if drop_invalid_bytes else lines


def stream_lines(
    spark: SparkSession,
    folder: str,
    max_files_per_trigger: int = 1000,
    drop_invalid_bytes: bool = False,
) -> DataFrame:
    """The lines of a watched folder as a stream; each new file is picked up once."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(folder)
    return _without_invalid_bytes(lines) if drop_invalid_bytes else lines


def chunk_lines(lines: DataFrame, folder: str, lines_per_file: int = 500) -> None:
    """Write lines as text files of at most ``lines_per_file`` lines.

    Every partition is cut into files on its own, in line order, and file names sort in that order.
    No rows move between tasks. A NULL or a text with a line end in it would not come back as it was, so the job
    fails on either; drop or split such rows first.
    """
    lines.select(_checked("value")).write.option("maxRecordsPerFile", lines_per_file).text(folder)


def number_lines(spark: SparkSession, path: str, drop_invalid_bytes: bool = False) -> DataFrame:
    """The lines of text files with their place: ``line_number``, ``file_number``, ``line_in_file``, ``value``.

    All count from 0, over the files that have lines in the order of their names, and do not depend on how files are
    split. The lines themselves are not sorted: the splits are counted, and each line takes what comes before its
    split. Only the table of splits is put in order.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        # Within a split these are in a row, as nothing comes between them and the scan.
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("_lines"), F.min("_at").alias("_first"))
    splits = numbering.carried(splits, ["_file"], "_start", {"_in_file": F.sum("_lines")})
    files = splits.groupBy("_file").agg(F.sum("_lines").alias("_lines"))
    # One row per file, as in the listing that the driver holds anyway.
    before = numbering.carried(files, [], "_file", {"_before": F.sum("_lines"), "file_number": F.count("*")})
    places = splits.drop("_lines").join(before.drop("_lines"), "_file")
    in_file = F.col("_in_file") + F.col("_at") - F.col("_first")
    numbered = lines.join(places, ["_file", "_start"]).select(
        (F.col("_before") + in_file).alias("line_number"), "file_number", in_file.alias("line_in_file"), "value"
    )
    return _without_invalid_bytes(numbered) if drop_invalid_bytes else numbered


def chunk_lines_in_order(
    lines: DataFrame, folder: str, lines_per_file: int = 500, order: Sequence[str | Column] | None = None
) -> None:
    """Write lines as text files of exactly ``lines_per_file`` lines, the last one with the rest.

    The files' names sort in the order of the lines: by ``order`` if given, as numbered if there is a column
    ``line_number`` (from 0 without gaps, as `number_lines` gives it), else as the rows come, split by split.
    Each line moves to its file once; a task writes up to `_FILES_PER_TASK` files one after another, and no task has
    more. Fails on NULL and on text with line ends, as `chunk_lines` does.
    """
    spark = lines.sparkSession
    scratch = None
    try:
        if order is not None or "line_number" not in lines.columns:
            # Stored once: rows that are numbered must come in the same order when they are written.
            scratch = shared.fresh_folder(spark, "numbered")
            placed = lines if order is None else lines.repartitionByRange(*order).sortWithinPartitions(*order)
            placed = placed.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"), "value")
            placed.write.parquet(scratch)
            stored = spark.read.parquet(scratch)
            blocks = stored.groupBy("block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
            before = numbering.carried(blocks, [], "block", {"before": F.sum("lines")}).drop("lines")
            number = F.col("before") + F.col("at") - F.col("first")
            lines = stored.join(F.broadcast(before), "block").select(number.alias("line_number"), "value")
        total = lines.agg(F.max("line_number")).first()[0]
        files = 0 if total is None else total // lines_per_file + 1
        if files > _FILES_PER_TASK * _TASKS:
            raise ValueError(f"more than {_FILES_PER_TASK * _TASKS} files; take more lines per file")
        tasks = min(_TASKS, max(1, -(-files // _FILES_PER_TASK), min(files, 4 * spark.sparkContext.defaultParallelism)))
        per_task = max(1, -(-files // tasks))
        task = F.floor(F.col("line_number") / F.lit(lines_per_file * per_task)).cast("int")
        dealt = lines.select("line_number", _checked("value")).repartitionById(tasks, task)
        ordered = dealt.sortWithinPartitions("line_number").select("value")
        ordered.write.option("maxRecordsPerFile", lines_per_file).text(folder)
    finally:
        if scratch:
            shared.remove_folder(spark, scratch)


def _checked(name: str) -> Column:
    value = F.col(name)
    no_line = F.raise_error(F.lit("chunks need text without line ends, and no NULL"))
    return F.when(value.isNull() | value.rlike("[\\r\\n]"), no_line).otherwise(value).alias(name)


def _without_invalid_bytes(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    repaired = F.replace(F.make_valid_utf8(value), F.lit(_REPLACEMENT), F.lit(""))
    return lines.withColumn("value", F.when(F.is_valid_utf8(value), value).otherwise(repaired))
