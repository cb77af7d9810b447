from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clftally.plans import report, rollup
from clftally.sources import parsed as parsed_table
from clftally.sources.parsed import PARSED_SCHEMA

DAY1 = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)

SLICES = [
    (None, None),
    ("2025-03-01 22:10:20.5", "2025-03-02 01:45:10.25"),
    ("2025-03-01 22:10:00", "2025-03-02 01:45:00"),
    ("2025-03-01 22:10:00", "2025-03-02 01:44:59.999999"),
    ("2025-03-01 23:59:30", None),
    (None, "2025-03-02 00:00:29"),
    ("2025-03-01 22:15:10", "2025-03-01 22:15:50"),
    ("2025-03-01 22:15:50", "2025-03-01 22:16:10"),
    ("2025-03-01 22:15:00", "2025-03-01 22:15:59.999999"),
    ("2025-03-02 02:00:00", "2025-03-01 22:00:00"),
    ("2031-01-01 00:00:00", None),
]


def log(spark, seed, first, n=3000):
    """Rows within four hours, with rows that are no record and instants on the edges of minutes."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        ts = first + dt.timedelta(microseconds=draw.choice([draw.randrange(14_400 * 10**6), 60_000_000 * draw.randrange(240)]))
        status = draw.choice([200, 200, 404, 500])
        rows.append((f"10.0.0.{draw.randrange(9)}", "-", "-", "", ts, f"GET /{draw.randrange(40)}", status, 1, True))
    rows += [("", "", "", "", None, "", None, None, False)] * 5
    rows += [("10.9.9.9", "-", "-", "bad", None, "GET /x", 200, 1, True)]
    return spark.createDataFrame(rows, PARSED_SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rollup")
    table, store = f"{folder}/table", f"{folder}/store"
    parsed_table.write_parsed(log(spark, 1, DAY1 + dt.timedelta(hours=22)), table)
    rollup.refresh(spark, table, store)
    return table, store


@pytest.mark.parametrize("edges", SLICES, ids=str)
def test_slices_equal_those_from_the_rows(spark, stored, edges):
    table, store = stored
    want = report.slice_report(parsed_table.read_parsed(spark, table), *edges, day="day")
    got = rollup.slice_report(spark, table, store, *edges)
    for section, rows in want.items():
        assert got[section].columns == rows.columns
        assert got[section].collect() == rows.collect(), section


def test_other_buckets_and_zones(spark, stored):
    edges = SLICES[1]
    rows = parsed_table.read_parsed(spark, stored[0])
    for bucket, zone in (("1m", "UTC"), ("1h", "Asia/Kolkata"), ("15m", "Europe/Berlin")):
        want = report.slice_report(rows, *edges, bucket, zone=zone, sections=["volume"])["volume"]
        assert rollup.slice_report(spark, *stored, *edges, bucket, zone=zone)["volume"].collect() == want.collect()


def test_rows_are_read_for_cut_minutes_only(spark, stored):
    counted = rollup.minute_counts(spark, *stored, *SLICES[1], sections=["status"])
    inside = counted.filter("count > 0").select("minute", F.input_file_name().alias("file"))
    from_rows = {row.minute for row in inside.filter(F.col("file").contains("/table/")).collect()}
    assert from_rows == {dt.datetime(2025, 3, 1, 22, 10), dt.datetime(2025, 3, 2, 1, 45)}
    assert not rollup.minute_counts(spark, *stored).filter(F.input_file_name().contains("/table/")).count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull") >= 1 and "section" in plan


def test_refresh_counts_changed_days_only(spark, tmp_path):
    table, store = f"{tmp_path}/table", f"{tmp_path}/store"
    parsed_table.write_parsed(log(spark, 2, DAY1 + dt.timedelta(hours=22), 300), table)
    days = [dt.date(2025, 3, 1), dt.date(2025, 3, 2)]
    assert rollup.refresh(spark, table, store) == days
    assert rollup.refresh(spark, table, store) == []
    parsed_table.write_parsed(log(spark, 3, DAY1 + dt.timedelta(days=1, hours=5), 200), table, mode="append")
    assert rollup.refresh(spark, table, store) == days[1:]
    replaced = log(spark, 4, DAY1 + dt.timedelta(hours=3), 100).filter("ts IS NOT NULL")
    parsed_table.write_parsed(replaced, table, mode="replace_days")
    assert rollup.refresh(spark, table, store) == days[:1]
    want = report.slice_report(parsed_table.read_parsed(spark, table))
    for section, rows in rollup.slice_report(spark, table, store).items():
        assert rows.collect() == want[section].collect()


def test_counts_without_marks_are_made_again(spark, tmp_path):
    """A refresh that ends between counts and marks leaves its days to the next one."""
    table, store = f"{tmp_path}/table", f"{tmp_path}/store"
    parsed_table.write_parsed(log(spark, 5, DAY1, 50), table)
    rollup.refresh(spark, table, f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other/counts").write.partitionBy("day", "section").parquet(f"{store}/counts")
    assert rollup.refresh(spark, table, store) == [dt.date(2025, 3, 1)]
    counted = rollup.minute_counts(spark, table, store, sections=["status"])
    assert counted.agg(F.sum("count")).first()[0] == 50


def test_empty_table(spark, tmp_path):
    table, store = f"{tmp_path}/table", f"{tmp_path}/store"
    parsed_table.write_parsed(log(spark, 6, DAY1, 0).filter("ok AND ts IS NOT NULL"), table)
    assert rollup.refresh(spark, table, store) == []
    assert {name: rows.count() for name, rows in rollup.slice_report(spark, table, store, *SLICES[1]).items()} == dict.fromkeys(
        report.VIEWER_SECTIONS, 0
    )


def test_unknown_section(spark, stored):
    with pytest.raises(ValueError, match="nope"):
        rollup.slice_report(spark, *stored, sections=["nope"])
