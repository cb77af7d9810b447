"""Log lines derived from the ``events`` table, for checks and benchmarks.

The given tables hold no web log. Each event becomes one line whose fields follow from the event; fixed
remainders of the event id give lines that are hard to parse: comments, empty lines, shifted or missing
offsets, offsets with a colon, with seconds or as a `Z`, days and hours of one digit, unreadable stamps, odd sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE = """
CASE event_id % 100
  WHEN 3 THEN concat('# comment ', event_id)
  WHEN 53 THEN ''
  ELSE concat(
    if(event_id % 100 = 77, '# ', ''),
    '10.0.', user_id div 256, '.', user_id % 256,
    ' - ', if(user_id % 3 = 0, concat('u', user_id), '-'),
    ' [',
    if(event_id % 50 = 11, 'bad-stamp',
       concat(CASE event_id % 50
                WHEN 17 THEN date_format(ts, 'd/MMM/yyyy:HH:mm:ss')
                WHEN 19 THEN date_format(ts, 'd/MMM/yyyy:H:m:s')
                ELSE date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') END,
              CASE event_id % 50
                WHEN 7 THEN '' WHEN 9 THEN ' +0530' WHEN 13 THEN ' +05:30'
                WHEN 23 THEN ' Z' WHEN 29 THEN ' -053015' WHEN 31 THEN '  +20:45:07' ELSE ' +0000' END)),
    '] "', if(event_type IN ('signup', 'purchase'), 'POST', 'GET'),
    ' /', event_type, '/', event_id % 20, ' HTTP/1.1" ',
    CASE event_type
      WHEN 'error' THEN if(event_id % 2 = 0, '500', '404')
      WHEN 'signup' THEN '302'
      WHEN 'purchase' THEN '201'
      ELSE '200' END,
    ' ',
    CASE WHEN event_id % 10 = 0 THEN '-'
         WHEN event_id % 97 = 0 THEN '5000000000'
         WHEN event_id % 89 = 0 THEN 'abc'
         ELSE string(event_id * 37 % 4096) END)
END AS value"""


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream of its files.

    A streaming source takes a folder or a glob. The table may be one file or a folder of files, so its
    name is given as a glob that fits nothing else.
    """
    return (
        spark.readStream.schema(read_events(spark, sf_dir).schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(f"{sf_dir}/events.parque[t]")
    )


def as_log_lines(events: DataFrame) -> DataFrame:
    """``event_id`` and the log line in ``value``; works on batch and streaming input."""
    return events.selectExpr("event_id", _LINE)
