"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are ordered by key, running sums of
their sizes are taken, and the mix takes the first words up to the source's budget; a budget above the source's
size goes round again. So a source's words in the mix equal its budget exactly, and a new run takes the same.

A source may hold any part of the rows, so no task ever sees a whole one: the first digits of the key cut each
source into buckets, sums run within a bucket, and what lies before a bucket is added from the bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clftally.llm import common

# Hexadecimal digits of the key that name a bucket, so 16 to their power buckets per source.
BUCKET_DIGITS = 4
WEIGHTS = (1, 2, 3)
LIMIT = 3

_OUTPUTS = ("size", "source_size", "target", "taken")

_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{common.BLANKS}]+")), F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    limit: int = LIMIT,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` (words) to every row.

    Sources in order of their names, a NULL source last, weigh as ``weights`` says, over and over. They share as
    many words as all documents have; no source gets more than ``limit`` times its own, and what it would get
    above that goes to the others by weight.

    A NULL text has size 0; a NULL id is a key like any other. Rows that are equal in id, source and size may
    swap their shares with each other, which changes no count. Columns of the input that are named like new
    ones, in any case, are replaced; other names are free. No rows give no rows.
    """
    aside = common.Aside(docs)
    names = [aside.name(column) for column in (text, source, doc_id)]
    return aside.back(_mixed(aside.rows, *names, weights, limit), _OUTPUTS)


def _mixed(
    docs: DataFrame, text: str, source: str, doc_id: str, weights: Sequence[int], limit: int
) -> DataFrame:
    rows = _keyed(docs, text, source, doc_id)
    # At most one row per source and bucket, however many documents there are.
    totals = common.checkpointed(
        rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    )
    shares = _targets(totals, weights, limit)
    buckets = (
        totals.withColumn(
            "_bucket_start",
            F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(*_BEFORE)),
        )
        .drop("_words")
        .join(shares, "_source")
    )
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_key", doc_id, "size").rowsBetween(*_BEFORE)
    start = F.coalesce("_bucket_start", F.lit(0)) + F.coalesce("_row_start", F.lit(0))
    budget = F.round("target").cast("bigint")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - rounds * F.col("source_size") - start
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return (
        rows.withColumn("_row_start", F.sum("size").over(in_bucket))
        .join(buckets, ["_source", "_bucket"])
        .withColumn("taken", taken.cast("bigint"))
    )


def take(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: each document as often as all its words are taken, and once cut short if some are left.

    The cut keeps the text up to the end of its last word taken. Documents of which nothing is taken go.
    """
    aside = common.Aside(mixed)
    text, size, taken = (aside.name(column) for column in (text, "size", "taken"))
    whole = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size))).otherwise(0)
    words = F.col(taken) - whole * F.col(size)
    pieces = F.regexp_extract_all(text, F.lit(f"[{common.BLANKS}]*[^{common.BLANKS}]+"), F.lit(0))
    begun = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    copies = F.concat(
        F.array_repeat(F.lit(True), whole.cast("int")),
        F.when(words > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = aside.rows.withColumn("_whole", F.explode(copies))
    return aside.back(rows.withColumn(text, F.when(F.col("_whole"), F.col(text)).otherwise(begun)))


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """Rows with their size, their key and its bucket, and a name of their source that is never NULL."""
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.select(
        "*",
        word_count(text).alias("size"),
        key.alias("_key"),
        F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"),
        # Sorts like the source, with NULL behind all.
        F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("_source"),
    )


def _targets(totals: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Source, ``source_size`` and ``target``.

    Which sources reach the limit is found in rounds: each shares the rest among those below it. A round is one
    aggregation with one row as its result, and there are few, since a source once at its limit stays there.
    """
    sources = totals.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    ranked = common.checkpointed(_ranked(sources, "_source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn(
        "_weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("bigint")
    )
    cap = F.col("source_size") * limit
    rest, weight, at_limit = _share(weighed, F.lit(False), limit)
    while True:
        above = cap.cast("double") < F.lit(float(rest)) * F.col("_weight") / F.lit(float(weight or 1))
        again = _share(weighed, above, limit)
        if again[2] == at_limit:
            break
        rest, weight, at_limit = again
    share = F.lit(float(rest)) * F.col("_weight") / F.lit(float(weight or 1))
    return weighed.select("_source", "source_size", F.least(cap.cast("double"), share).alias("target"))


def _share(sources: DataFrame, at_limit: Column, limit: int) -> tuple[int, int, int]:
    """Words and weights left for the sources below their limit, and how many are at it."""
    row = sources.agg(
        F.sum("source_size"),
        F.sum(F.when(at_limit, F.col("source_size") * limit)),
        F.sum(F.when(~at_limit, F.col("_weight"))),
        F.count_if(at_limit),
    ).first()
    return (row[0] or 0) - (row[1] or 0), row[2] or 0, row[3]


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """Add ``_rank``, from 0, in order of a column without equal values.

    Ranks run within ranges of the column; a table with one row per range says how many rows lie before it.
    """
    ranges = common.checkpointed(
        rows.repartitionByRange(F.col(name)).withColumn("_range", F.spark_partition_id())
    )
    before = ranges.groupBy("_range").count().withColumn(
        "_ahead", F.sum("count").over(Window.partitionBy().orderBy("_range").rowsBetween(*_BEFORE))
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(name)) - 1
    return (
        ranges.withColumn("_place", place)
        .join(before.drop("count"), "_range")
        .withColumn("_rank", F.col("_place") + F.coalesce("_ahead", F.lit(0)))
        .drop("_range", "_place", "_ahead")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
),
-- Sources in the order in which they reach their limit; what each would get were all before it at theirs.
filled AS (
  SELECT *, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER up, 0) AS DOUBLE) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS DOUBLE) AS weights
  FROM sources
  WINDOW up AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT arg_min(rest, source_size / weight) AS rest, arg_min(weights, source_size / weight) AS weights
  FROM filled WHERE cap >= rest * weight / weights
),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level.rest * weight / level.weights) AS target
  FROM filled, level
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0
    ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
