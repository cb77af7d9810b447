"""The parsed log as a Parquet table, one folder per UTC day.

Parsing text is the expensive step. Metrics over this table read only the columns they use, prune days,
and push their filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.functions.buckets import utc_day

PARSED_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("client", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("request", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("ok", T.BooleanType()),
    ]
)
TABLE_SCHEMA = T.StructType([*PARSED_SCHEMA.fields, T.StructField("day", T.DateType())])


# The column that names a row's folder; give it to `time_slice` as ``day``.
DAY = "day"

# How `write_parsed` treats what is stored already, as Spark's save mode and its way of overwriting partitions.
_MODES = {"new": ("errorifexists", "static"), "append": ("append", "static"), "replace_days": ("overwrite", "dynamic")}


def write_parsed(parsed: DataFrame, path: str, rebalance: bool = True, mode: str = "new") -> None:
    """Store parsed rows by UTC day, sorted by time within each file.

    ``mode`` is ``new`` (there must be no table yet), ``append``, or ``replace_days``: the days that occur in the
    rows are replaced whole and the others stay, so a day can be written again after a failure or with late lines.

    ``rebalance`` lets adaptive execution gather each day into files of even size; a day that holds
    much of the table is split over many tasks. Turn it off for input that is already in time order,
    which then needs no shuffle.
    """
    if mode not in _MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {', '.join(_MODES)}")
    save_mode, overwriting = _MODES[mode]
    rows = parsed.select(*PARSED_SCHEMA.names).withColumn(DAY, utc_day(F.col("ts")))
    if rebalance:
        rows = rows.hint("rebalance", DAY)
    writer = rows.sortWithinPartitions(DAY, "ts").write.partitionBy(DAY).mode(save_mode)
    writer.option("partitionOverwriteMode", overwriting).parquet(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, with its partition column ``day``."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)
