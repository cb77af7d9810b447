"""Positions and running totals over all rows, without a task that sees them all.

Everything here goes in two steps: rows are cut into blocks, each block is handled on its own, and what lies before a
block is carried into it from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block in `running_sums`, as a power of two.
_LOG_BLOCK = 12


def in_blocks(rows: DataFrame, order: Sequence[str | Column], name: str = "block") -> DataFrame:
    """Rows in blocks that follow each other in the given order, as Spark samples their limits.

    The block numbers are only stable once the result has been written or checkpointed.
    """
    return rows.repartitionByRange(*order).withColumn(name, F.spark_partition_id())


def numbered(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, block: str = "block"
) -> DataFrame:
    """Number the rows of each key from 1 in the given order; ``rows`` are in stable blocks by that order.

    A key with most of the rows is spread over as many tasks as there are blocks.
    """
    rows, keys = (rows, keys) if keys else (rows.withColumn("_all", F.lit(0)), ["_all"])
    sizes = rows.groupBy(*keys, block).agg(F.count("*").alias("_size"))
    before = carried(sizes, keys, block, {"_before": F.sum("_size")}).drop("_size")
    place = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    return (
        joined(rows.withColumn("_place", place), before, [*keys, block])
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_before", "_place", "_all")
    )


def carried(totals: DataFrame, keys: Sequence[str], block: str, values: Mapping[str, Column]) -> DataFrame:
    """Add what the blocks before each block come to; ``totals`` has one row per key and block."""
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "*", *[F.coalesce(value.over(earlier), F.lit(0)).alias(name) for name, value in values.items()]
    )


def running_sums(rows: DataFrame, position: str, values: Mapping[str, str]) -> DataFrame:
    """Add the running sum of each value, its own row included, by a position that counts the rows without gaps.

    ``values`` maps new names to columns. Blocks hold 4,096 positions each and so do blocks of blocks; what is left
    to be added up in one place has one row per 16 million.
    """
    block = F.shiftright(position, _LOG_BLOCK)
    rows = rows.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(*[F.sum(column).alias(name) for name, column in values.items()])
    totals = totals.withColumn("_super", F.shiftright("_block", _LOG_BLOCK))
    tops = totals.groupBy("_super").agg(*[F.sum(name).alias(name) for name in values])
    top = carried(tops, [], "_super", {f"_top_{name}": F.sum(name) for name in values}).drop(*values)
    inner = carried(totals, ["_super"], "_block", {f"_in_{name}": F.sum(name) for name in values})
    before = inner.drop(*values).join(top, "_super").drop("_super")
    so_far = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(column).over(so_far).alias(f"_own_{name}") for name, column in values.items()])
    sums = {name: F.col(f"_own_{name}") + F.col(f"_in_{name}") + F.col(f"_top_{name}") for name in values}
    helpers = [f"_{part}_{name}" for part in ("own", "in", "top") for name in values]
    return inside.join(before, "_block").withColumns(sums).drop("_block", *helpers)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL on both sides; the left side's columns first."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return left.join(renamed, condition).drop(*[f"_r_{key}" for key in keys])
