"""Every registered query against DuckDB, on the given tables and on a skewed copy of them."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES = registry.log_queries()
SQL = oracle.build(*registry.SLICE, registry.LATENESS, registry.LINES_PER_CHUNK)
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def spark_result(frame):
    kinds = {name: KINDS[kind] for name, kind in frame.dtypes}
    names = sorted(frame.columns)
    return kinds, sorted((tuple(row[name] for name in names) for row in frame.collect()), key=repr)


def duckdb_result(sql, events):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}')")
        found = con.execute(sql)
        kinds = {column[0]: str(column[1]) for column in found.description}
        order = sorted(range(len(kinds)), key=lambda i: found.description[i][0])
        return kinds, sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    assert spark_result(QUERIES[name](spark, SF)) == duckdb_result(SQL[name], f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Several files; one user, one kind and one minute hold more than a third of the events."""
    folder = tmp_path_factory.mktemp("skewed")
    events = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.col("event_id") % 5 < 2
    (
        events.withColumn("user_id", F.when(hot, 3).otherwise(F.col("user_id") * 300))
        .withColumn("event_type", F.when(hot, "view").otherwise(F.col("event_type")))
        .withColumn("ts", F.when(hot, F.lit("2024-01-15 10:00:30").cast("timestamp_ntz")).otherwise(F.col("ts")))
        .repartition(6)
        .write.parquet(f"{folder}/events.parquet")
    )
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "access_report",
        "ip_counts_raw",
        "parse_quality",
        "parsed_table",
        "slice_volume",
        "status_share",
        "stream_access_report",
        "stream_closed_hours",
        "stream_status_counts",
        "summary_report",
        "top_requests",
        "volume_1m",
    ],
)
def test_skewed_tables(spark, skewed, name):
    got = spark_result(QUERIES[name](spark, skewed))
    assert got == duckdb_result(SQL[name], f"{skewed}/events.parquet/*.parquet")


@pytest.fixture(scope="module")
def with_nulls(spark, tmp_path_factory):
    """Events that lack a user, a kind or a time; their lines are NULL."""
    folder = tmp_path_factory.mktemp("nulls")
    e = F.col("event_id")
    (
        spark.read.parquet(f"{SF}/events.parquet")
        .withColumn("user_id", F.when(e % 7 != 0, F.col("user_id")))
        .withColumn("event_type", F.when(e % 11 != 0, F.col("event_type")))
        .withColumn("ts", F.when(e % 13 != 0, F.col("ts")))
        .write.parquet(f"{folder}/events.parquet")
    )
    return str(folder)


@pytest.mark.parametrize("name", ["parse_access_log_find", "parse_quality", "ip_counts_raw", "volume_1h"])
def test_missing_values(spark, with_nulls, name):
    got = spark_result(QUERIES[name](spark, with_nulls))
    assert got == duckdb_result(SQL[name], f"{with_nulls}/events.parquet/*.parquet")


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns[0] == "status" and frame.count() == 5
