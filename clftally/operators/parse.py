"""Log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.functions import clf

# What parsing adds, in order.
COLUMNS = ("ip", "client", "user", "ts_raw", "ts", "request", "status", "size", "ok")


def valid_lines(lines: DataFrame, anchored: bool = True) -> DataFrame:
    """Only the lines that hold a log record."""
    return lines.filter(clf.matches_line(F.col("value"), anchored))


def parse_access_log(
    lines: DataFrame, anchored: bool = True, with_time: bool = True
) -> DataFrame:
    """Parse the ``value`` column into typed columns plus ``ok``; other input columns are kept.

    No row is dropped: a line that does not match has ``ok`` false, empty strings, and NULL in ``ts``,
    ``status`` and ``size``. ``anchored`` demands the record at the start of the line; without it, a
    record anywhere counts. Fields that a job does not use cost nothing, but for ``ts``: a job that has
    no use for it leaves it out with ``with_time=False``. Input columns may not be named like parsed ones.
    """
    taken = sorted({*COLUMNS, "_record", "_ts"} & set(lines.columns))
    if taken:
        raise ValueError(f"rename these columns before parsing: {', '.join(taken)}")
    rows = evaluate_once(lines, clf.record_of(F.col("value"), anchored), "_record")
    text = clf.record_fields(F.col("_record"))
    columns = {
        **text,
        "status": clf.status_code(text["status"]),
        "size": clf.size_in_bytes(text["size"]),
        "ok": F.col("_record") != "",
    }
    if with_time:
        rows = evaluate_once(rows, clf.instant(text["ts_raw"]), "_ts")
        columns["ts"] = F.col("_ts")
    others = [name for name in lines.columns if name != "value"]
    return rows.select(*others, *[columns[name].alias(name) for name in COLUMNS if name in columns])


def parse_timestamps(lines: DataFrame, anchored: bool = True) -> DataFrame:
    """Raw stamp and instant of every valid line, next to the columns it came with."""
    others = [name for name in lines.columns if name != "value"]
    return keep_valid(parse_access_log(lines, anchored)).select(*others, "ts_raw", "ts")


def keep_valid(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Parsed rows of valid lines, or all rows if ``keep_malformed``."""
    return parsed if keep_malformed else parsed.filter("ok")


def evaluate_once(rows: DataFrame, expression: Column, name: str) -> DataFrame:
    """Add a column that the optimizer computes exactly once per row.

    A plain column is inlined into every later projection and filter that mentions it, so a filter on a
    parsed field would run the regex twice. The output of a generator is never inlined; a generator
    over a one-element array adds exactly one value per row and keeps the stage in generated code.
    """
    return rows.select("*", F.explode(F.array(expression)).alias(name))
