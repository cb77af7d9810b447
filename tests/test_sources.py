from __future__ import annotations

import datetime as dt
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clftally import (
    chunk_lines,
    chunk_lines_in_order,
    number_lines,
    parse_access_log,
    read_parsed,
    scan_lines,
    status_counts,
    time_slice,
    write_parsed,
)
from clftally.sources import event_lines, shared
from clftally.sources.parsed import DAY
from tests.samples import LINES, line, rows
from tests.test_plans import plan_of

SF = "/root/testdata/sf0.001"


def test_line_ends_and_bad_bytes(spark, tmp_path):
    path = tmp_path / "access.log"
    path.write_bytes(b"a\r\nb\rc\n\nbad\xffbyte\xe2\x82\xac")
    assert rows(scan_lines(spark, str(path))) == [
        ("a",), ("b",), ("c",), ("",), ("bad\ufffdbyte€",),
    ]
    assert rows(scan_lines(spark, str(path), drop_invalid_bytes=True))[-1] == ("badbyte€",)


def test_chunks_hold_all_lines_in_order(spark, tmp_path):
    lines = spark.range(0, 1203, numPartitions=1).select(
        F.when(F.col("id") % 100 == 0, "").otherwise(F.col("id").cast("string")).alias("value")
    )
    folder = tmp_path / "chunks"
    chunk_lines(lines, str(folder))
    files = sorted(folder.glob("part-*"))
    texts = [path.read_text().splitlines() for path in files]
    assert [len(text) for text in texts] == [500, 500, 203]
    assert sum(texts, []) == [row["value"] for row in lines.collect()]
    assert scan_lines(spark, str(folder)).count() == 1203


def test_every_partition_is_chunked_on_its_own(spark, tmp_path):
    lines = spark.range(0, 1000, numPartitions=4).select(F.col("id").cast("string").alias("value"))
    folder = tmp_path / "chunks"
    chunk_lines(lines, str(folder), lines_per_file=100)
    sizes = [len(path.read_text().splitlines()) for path in folder.glob("part-*")]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and len(sizes) == 12


def chunks(folder):
    return [path.read_text().splitlines() for path in sorted(folder.glob("part-*")) if path.stat().st_size]


@pytest.mark.parametrize("total, per_file", [(0, 10), (1, 10), (2000, 100), (12_345, 7), (9_999, 10_000)])
def test_chunks_in_order_are_full_across_splits(spark, tmp_path, total, per_file):
    """All files but the last have the same number of lines, and their names sort in the order of the lines."""
    want = [f"line {i}" for i in range(total)]
    lines = spark.range(total, numPartitions=7).select(F.col("id").alias("n"), F.format_string("line %d", "id").alias("value"))
    chunk_lines_in_order(lines, str(tmp_path / "as_they_come"), per_file)
    chunk_lines_in_order(lines.orderBy(F.rand(1)), str(tmp_path / "sorted"), per_file, order=["n"])
    for folder in ("as_they_come", "sorted"):
        texts = chunks(tmp_path / folder)
        assert sum(texts, []) == want
        assert [len(text) for text in texts] == [per_file] * (total // per_file) + [total % per_file] * (total % per_file > 0)


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    """Any number of splits per file and of files per task gives the same numbers."""
    texts = {"b.log": 3000, "a.log": 1, "c.log": 0, "d.log": 999}
    for name, number in texts.items():
        (tmp_path / name).write_text("".join(f"{name} {i}" + "\r\n" * (i % 2) + "\n" * (1 - i % 2) for i in range(number)))
    want = [(n, f, i, f"{name} {i}") for n, (f, name, i) in enumerate((f, name, i) for f, name in enumerate(("a.log", "b.log", "d.log")) for i in range(texts[name]))]
    sizes = {"spark.sql.files.maxPartitionBytes": ["700", "20000", "128m"], "spark.sql.files.openCostInBytes": ["1", "1", "4m"]}
    try:
        for i in range(3):
            for key, values in sizes.items():
                spark.conf.set(key, values[i])
            numbered = number_lines(spark, str(tmp_path))
            assert sorted(rows(numbered)) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        chunk_lines_in_order(number_lines(spark, str(tmp_path)), str(tmp_path / "out"), 64)
    finally:
        for key in sizes:
            spark.conf.unset(key)
    assert sum(chunks(tmp_path / "out"), []) == [value for *_, value in want]


def test_ordered_chunks_need_lines(spark, lines_of, tmp_path):
    for bad in (None, "a\nb", "a\rb"):
        with pytest.raises(Exception, match="chunks need text"):
            chunk_lines_in_order(lines_of(["x", bad]), str(tmp_path / "chunks"), 1)


@pytest.mark.parametrize("rebalance", [True, False])
def test_parsed_table_round_trip(spark, lines_of, tmp_path, rebalance):
    texts = LINES + [line(stamp="31/Dec/2024:23:59:59 -0100"), line(stamp="bad")]
    parsed = parse_access_log(lines_of(texts))
    path = str(tmp_path / "table")
    write_parsed(parsed, path, rebalance)
    table = read_parsed(spark, path)
    assert sorted(rows(table.drop("day")), key=repr) == sorted(rows(parsed), key=repr)
    days = rows(table.groupBy("day").count().orderBy("day"))
    assert days == [(None, 3), (dt.date(2025, 1, 1), 1), (dt.date(2031, 3, 17), 9)]
    assert rows(status_counts(table)) == rows(status_counts(parsed))


def test_a_range_on_the_table_reads_only_its_days_and_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    lines = event_lines.as_log_lines(event_lines.read_events(spark, SF))
    parsed = parse_access_log(lines)
    write_parsed(parsed, path)
    edges = ("2024-01-10 12:00:00", "2024-01-12 06:00:00")
    part = time_slice(read_parsed(spark, path), *edges, day=DAY)
    assert part.count() == time_slice(parsed, *edges).count() > 0
    files = {Path(name).parent.name for (name,) in rows(part.select(F.input_file_name()).distinct())}
    assert files == {"day=2024-01-10", "day=2024-01-11", "day=2024-01-12"}
    scan = plan_of(status_counts(part.filter(F.col("status") >= 400)))
    assert "PartitionFilters: [isnotnull(day" in scan
    assert "GreaterThanOrEqual(status,400)" in scan and "GreaterThanOrEqual(ts,2024-01-10" in scan
    assert "ReadSchema: struct<ts:timestamp,status:int,ok:boolean>" in scan


def test_days_can_be_added_and_replaced(spark, lines_of, tmp_path):
    path = str(tmp_path / "table")
    log = lambda *stamps: parse_access_log(lines_of([line(stamp=f"{s}:00:00:01 +0000") for s in stamps]))
    days = lambda: dict(rows(read_parsed(spark, path).groupBy(F.dayofmonth("day")).count()))
    write_parsed(log("08/Nov/2025", "09/Nov/2025"), path)
    write_parsed(log("09/Nov/2025", "10/Nov/2025"), path, mode="append")
    assert days() == {8: 1, 9: 2, 10: 1}
    write_parsed(log("10/Nov/2025", "10/Nov/2025", "11/Nov/2025"), path, mode="replace_days")
    assert days() == {8: 1, 9: 2, 10: 2, 11: 1}
    with pytest.raises(AnalysisException):
        write_parsed(log("12/Nov/2025"), path)
    with pytest.raises(ValueError, match="unknown mode"):
        write_parsed(log("12/Nov/2025"), path, mode="replace")


def test_a_foreign_day_column_is_not_taken_for_the_stored_one(spark, lines_of):
    parsed = parse_access_log(lines_of([line()])).withColumn("day", F.lit("1999-01-01").cast("date"))
    assert time_slice(parsed, "2025-11-08", "2025-11-09").count() == 1


@pytest.mark.parametrize("text", [None, "a\nb", "a\rb"])
def test_what_is_no_line_is_not_written_as_one(spark, lines_of, tmp_path, text):
    with pytest.raises(Exception, match="without line ends"):
        chunk_lines(lines_of(["fine", text]), str(tmp_path / "chunks"))


def test_the_layout_of_chunks_depends_on_parameters_only(spark, tmp_path):
    lines = spark.range(0, 3000, numPartitions=1).select(F.col("id").cast("string").alias("value"))
    for n, total in enumerate((700, 3000)):
        chunk_lines(lines.limit(total).coalesce(1), str(tmp_path / str(n)), lines_per_file=500)
        files = sorted((tmp_path / str(n)).glob("part-*"))
        assert [len(f.read_text().splitlines()) for f in files][:-1] == [500] * (total // 500 - (total % 500 == 0))


def test_a_busy_day_is_written_by_many_tasks(spark, tmp_path):
    """Half of the rows fall on one day; small target sizes stand in for a large table."""
    path = str(tmp_path / "table")
    lines = spark.range(0, 40_000, numPartitions=8).select(
        F.format_string(
            '10.0.%s.%s - - [%02d/Nov/2025:00:00:01 +0000] "GET /%s HTTP/1.1" 200 1',
            (F.col("id") / 256).cast("int"), F.col("id") % 256,
            F.when(F.col("id") % 2 == 0, 8).otherwise(F.col("id") % 7 + 9), F.sha2(F.col("id").cast("string"), 256),
        ).alias("value")
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "200KB")
    try:
        write_parsed(parse_access_log(lines), path)
    finally:
        spark.conf.unset(size)
    files = list(Path(path).glob("day=2025-11-08/*.parquet"))
    assert len(files) > 3
    assert read_parsed(spark, path).filter("day = '2025-11-08'").count() == 20_000


class _Session:
    """As much of a cluster's session as the choice of a folder looks at."""

    def __init__(self, settings):
        self.conf = SimpleNamespace(get=lambda key, default: settings.get(key, default))
        self.sparkContext = SimpleNamespace(master="spark://host:1", getCheckpointDir=lambda: None)


def test_scratch_goes_to_the_shared_folder():
    session = _Session({"spark.checkpoint.dir": "hdfs:///shared/"})
    one, two = (shared.fresh_folder(session, "lines") for _ in range(2))
    assert one.startswith("hdfs:///shared/clftally-lines-") and one != two


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.fresh_folder(_Session({}), "lines")


def test_without_a_named_folder_a_local_run_uses_a_temporary_one(tmp_path):
    session = _Session({})
    session.sparkContext.master = "local[2]"
    assert Path(shared.shared_root(session)).is_dir()


def test_only_scratch_folders_are_removed(spark, tmp_path):
    mine, other = tmp_path / "clftally-lines-1", tmp_path / "other"
    for folder in (mine, other):
        spark.range(1).write.parquet(str(folder))
    shared.remove_folder(spark, str(mine))
    with pytest.raises(ValueError):
        shared.remove_folder(spark, str(other))
    assert not mine.exists() and other.exists()
