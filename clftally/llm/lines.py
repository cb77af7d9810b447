"""Removal of lines that many sites share.

For each line a HyperLogLog sketch counts the distinct sites it occurs on. Sketches are small and merge, so a line
that is everywhere reaches the shuffle as one sketch per task. Lines whose estimate is near the threshold are
counted exactly; the others are decided by their estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.llm import common
from clftally.operators.parse import evaluate_once

# A line on so many sites is boilerplate.
MIN_SITES = 10
# Sketch size as a power of two. The standard error of an estimate is 1.04 / sqrt(2^12) = 1.6 %; estimates within
# six of those, or within one, of the threshold are checked.
LOG_SIZE = 12
BAND = 6 * 1.04 / 2 ** (LOG_SIZE / 2)
# Each boilerplate line meets its occurrences in so many groups.
SALTS = 8

_TRIMMED = " \t\n\x0b\f\r"


def drop_shared_lines(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """Take the shared lines out of the text; adds ``n_lines`` and ``n_removed``, and keeps all rows and columns.

    All of them go, whatever part of a document they are. Equal texts count for the least of their sites only, so
    copies of one text on many sites do not make its lines shared; they are for document deduplication.

    Lines end at a line feed and are compared without blanks at their ends. Lines without a word are neither counted
    nor removed. A NULL site is a site like any other. A NULL text stays NULL and has no lines. Equal rows are
    treated alike. Input columns named like new ones, in any case, are replaced; other names are free.
    """
    aside = common.Aside(docs)
    rows = _without_shared_lines(aside.rows, aside.name(text), aside.name(site), min_sites)
    return aside.back(rows, ("n_lines", "n_removed"))


def _without_shared_lines(docs: DataFrame, text: str, site: str, min_sites: int) -> DataFrame:
    shared = common.checkpointed(shared_lines(docs, text, site, min_sites))
    salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = (
        _occurrences(docs, text)
        .withColumn("_salt", F.pmod("_ta", F.lit(SALTS)).cast("int"))
        .join(salted, ["_a", "_b", "_salt"])
        .groupBy("_ta", "_tb")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_places"))
    )
    key = common.content_key(F.col(text))
    names = docs.columns
    rows = docs.select(*names, key["a"].alias("_ta"), key["b"].alias("_tb")).join(places, ["_ta", "_tb"], "left")
    rows = evaluate_once(rows, F.split(text, "\n"), "_lines")
    cut = F.col("_places").isNotNull()
    counted = F.size(F.filter("_lines", _has_word))
    return rows.select(
        *[F.when(cut, F.array_join(_left_over(), "\n")).otherwise(F.col(c)).alias(c) if c == text else c for c in names],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(counted).cast("bigint").alias("n_lines"),
        F.when(cut, F.size("_places")).otherwise(0).cast("bigint").alias("n_removed"),
    )


def shared_lines(docs: DataFrame, text: str, site: str, min_sites: int) -> DataFrame:
    """Keys of the lines that occur on ``min_sites`` sites or more, each text being on the least of its sites."""
    name = F.coalesce(F.concat(F.lit("0"), F.col(site).cast("string")), F.lit("1"))
    whole = common.content_key(F.col(text))
    bare = F.transform(F.filter(F.split(text, "\n"), _has_word), lambda line: F.btrim(line, F.lit(_TRIMMED)))
    # The keys of a text's lines in one value, so that each text meets its copies as one row.
    lines = (
        docs.select(
            name.alias("_site"),
            whole["a"].alias("_ta"),
            whole["b"].alias("_tb"),
            F.array_distinct(F.transform(bare, common.content_key)).alias("_keys"),
        )
        .groupBy("_ta", "_tb")
        .agg(F.min("_site").alias("_site"), F.any_value("_keys").alias("_keys"))
        .select("_site", F.explode("_keys").alias("_key"))
        .select(F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"), "_site")
    )
    sketched = lines.groupBy("_a", "_b").agg(F.hll_sketch_agg("_site", LOG_SIZE).alias("_sketch"))
    margin = max(1.0, BAND * min_sites)
    estimated = common.checkpointed(
        sketched.select("_a", "_b", F.hll_sketch_estimate("_sketch").alias("_sites")).filter(
            F.col("_sites") >= min_sites - margin
        )
    )
    near = estimated.filter(F.col("_sites") <= min_sites + margin).drop("_sites")
    # Each line and site once, before they meet: a line that is everywhere has few sites in comparison.
    exact = (
        lines.distinct()
        .join(near, ["_a", "_b"], "left_semi")
        .groupBy("_a", "_b")
        .agg(F.count("*").alias("_sites"))
        .filter(F.col("_sites") >= min_sites)
    )
    sure = estimated.filter(F.col("_sites") > min_sites + margin)
    return sure.unionByName(exact).select("_a", "_b")


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    """One row per line with a word: its key, its place in its text, the text's key."""
    whole = common.content_key(F.col(text))
    lines = docs.select(
        whole["a"].alias("_ta"),
        whole["b"].alias("_tb"),
        F.posexplode(F.split(text, "\n")).alias("_pos", "_line"),
    ).filter(_has_word(F.col("_line")))
    key = common.content_key(F.btrim("_line", F.lit(_TRIMMED)))
    return lines.select("_ta", "_tb", "_pos", key["a"].alias("_a"), key["b"].alias("_b"))


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_TRIMMED))) > 0


def _left_over() -> Column:
    """The lines between one removed place and the next, from before the first to behind the last."""
    edges = F.concat(F.array(F.lit(-1)), F.col("_places"), F.array(F.size("_lines")))
    stretch = lambda before, i: F.slice(
        "_lines", before + 2, F.coalesce(F.get("_places", i), F.size("_lines")) - before - 1
    )
    return F.flatten(F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), stretch))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, * FROM documents),
lines AS (
  SELECT row, source, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM docs
),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
single AS (SELECT text, bare, min(coalesce('0' || source, '1')) AS site FROM trimmed WHERE bare <> '' GROUP BY text, bare),
shared AS (SELECT bare FROM single GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT t.*, t.bare IN (SELECT bare FROM shared) AS gone FROM trimmed t),
rebuilt AS (
  SELECT row, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS left_over
  FROM marked GROUP BY row
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_removed > 0 THEN left_over ELSE text END) AS text_sha256
FROM docs d LEFT JOIN rebuilt USING (row)
"""
