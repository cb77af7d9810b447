"""From documents to a tokenised mix: quality rules, shared lines, near copies, mixing, encoding.

Every stage takes the documents its predecessor kept, and its decisions take effect: what it rejects is gone from its
result. All stages but the last return the columns of ``documents``, with their values whatever their names. Each result is written as Parquet to a shared
folder and read again as the documents of the next one, so a lost executor costs no more than the stage at work.

Documents that a stage leaves without a word hold nothing to train on. The quality rules reject those of the input, and
the mix, which takes words, takes none of later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clftally.llm import common, lines, mixing, near_dedup, quality, registry
from clftally.sources import shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are like their language."""
    aside = common.Aside(docs)
    judged = quality.judge(aside.rows, aside.name("text"), aside.name("lang"), keep=aside.rows.columns)
    return aside.back(judged.filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share, whatever part of a document these are.

    Copies of one text count for one source, so that they are left to the next stage, which keeps one of them.
    """
    aside = common.Aside(docs)
    return _measured(aside.back(lines.drop_shared_lines(aside.rows, aside.name("text"), aside.name("source"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id."""
    return near_dedup.drop_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a source may be cut at the budget."""
    aside = common.Aside(docs)
    text, source, doc_id = (aside.name(column) for column in ("text", "source", "doc_id"))
    return _measured(aside.back(mixing.take(mixing.mix(aside.rows, text, source, doc_id), text)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return registry.bpe_digests(docs, release=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", encode),
]

# Near copies and token ids are beyond SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of ``documents``. The folders in between are removed at the end."""
    docs, folders = common.documents(spark, sf_dir), []
    try:
        for name, stage in STAGES:
            folders.append(shared.fresh_folder(spark, "pipeline"))
            stage(spark, docs, sf_dir).write.parquet(folders[-1])
            docs = spark.read.parquet(folders[-1])
        return common.checkpointed(docs)
    finally:
        for folder in folders:
            shared.remove_folder(spark, folder)


def _measured(docs: DataFrame) -> DataFrame:
    """Documents with ``n_chars`` brought up to date."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs
