"""Input columns may have any name: those that operators use on their way, and those of their results, in any case."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clftally.llm import common, lines, mixing, near_dedup, quality, repeats

PROSE = "The rain in the valley is a thing that was of use to all and it ran for days in the old town by the river. "
OUTPUTS = {
    mixing.mix: ["size", "source_size", "target", "taken"],
    lines.drop_shared_lines: ["n_lines", "n_removed"],
    quality.judge: list(quality._OUTPUTS),
    near_dedup.classes: ["class_id"],
    near_dedup.drop_copies: [],
    repeats.remove_repeats: ["n_bytes", "spans", "kept"],
}


def helper_names():
    """All words in quotes that the modules use as names."""
    found = set()
    for module in (mixing, lines, quality, near_dedup, repeats, common):
        found |= set(re.findall(r'"(_?[A-Za-z][A-Za-z_0-9]*)"', Path(module.__file__).read_text()))
    return sorted(found - {"text", "lang", "source", "doc_id", "Iterator"})


def documents(spark):
    rows = [(i, PROSE * 3 + f"Doc {i % 7} of it", "en", f"s{i % 4}" if i else None) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("operator", OUTPUTS, ids=lambda f: f.__name__)
@pytest.mark.parametrize("case", [str, str.upper])
def test_every_name_is_free(spark, operator, case):
    docs = documents(spark)
    names = {case(name): name for name in helper_names() if case(name).lower() not in docs.columns}
    unique = {name.lower(): name for name in names}.values()
    wide = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in unique])
    got = operator(wide)
    outputs = OUTPUTS[operator]
    dropped = ["text"] if operator in (quality.judge, repeats.remove_repeats) else []
    assert got.columns == [c for c in wide.columns if c.lower() not in outputs + dropped] + outputs
    plain = {str(r) for r in operator(docs).select("doc_id", *outputs).collect()}
    rows = got.collect()
    assert {str(r) for r in got.select("doc_id", *outputs).collect()} == plain
    kept = [name for name in unique if name.lower() not in outputs]
    assert rows and all(row[name] == f"{name}{row['doc_id']}" for row in rows for name in kept)


def test_pipeline_keeps_input_columns(spark):
    docs = documents(spark).withColumn("text", F.concat(F.lit(PROSE), F.lit("Doc "), F.pmod("doc_id", F.lit(7)), F.lit(" of it")))
    extra = ["size", "KEPT", "taken", "_whole", "n_lines", "class_id", "_node", "n_removed"]
    docs = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in extra])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", *extra]
        rows = docs.collect()
        assert rows and all(row[name] == f"{name}{row.doc_id}" for row in rows for name in extra)


def test_copies_with_maps(spark):
    docs = documents(spark).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    docs = docs.withColumn("doc_id", F.lit(1).cast("long"))
    got = near_dedup.drop_copies(docs).collect()
    assert len(got) == 1 and got == near_dedup.drop_copies(docs.repartition(5)).collect()


def test_names_that_are_missing_or_twofold(spark):
    docs = documents(spark)
    with pytest.raises(ValueError, match="no_such"):
        mixing.mix(docs, text="no_such")
    assert mixing.mix(docs.withColumnRenamed("text", "Text")).count() == 24
