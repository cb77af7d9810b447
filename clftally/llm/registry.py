"""The queries of this subpackage: each applies one operator to its whole table.

The operators return their real outputs; the queries here derive the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clftally.llm import (
    bpe,
    common,
    language,
    lines,
    mixing,
    near_dedup,
    neighbours,
    prefix_trie,
    quality,
    repeats,
    scoring,
    secrets,
    url_filter,
    variants,
)

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_50k.tiktoken"

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return bpe_digests(common.documents(spark, sf_dir), ranks)


def bpe_digests(docs: DataFrame, ranks: str | None = None, release: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and give the number of ids and the digests of both.

    ``ranks`` is the path of the rank file; the driver reads it. For ``release`` see `bpe.round_trip`.
    """
    rank_file = Path(ranks or public_tokenizers.path(RANKS)).read_bytes()
    both = bpe.round_trip(docs.select("doc_id", "text"), rank_file, public_tokenizers.PATTERN, release=release)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(common.documents(spark, sf_dir).select("doc_id", "text"))
    of_kind = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.joined(of_kind(*secrets.BASE_KINDS)), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(rows, rows.filter("vec_id % 50 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    judged = quality.judge(docs)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    left = lines.drop_shared_lines(docs)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["number"])
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    models = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, models, keep=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_documents(common.documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns)).drop("a", "b")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return variants.grouped(variants.word_counts(docs, one_in=variants.ONE_IN))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # It uses this module too.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_secrets": op2_secrets,
        "op3_mixing": op3_mixing,
        "op4_neighbours": op4_neighbours,
        "op5_quality": op5_quality,
        "op6_near_dedup": op6_near_dedup,
        "op7_lines": op7_lines,
        "op8_repeats": op8_repeats,
        "op9_language": op9_language,
        "op10_scoring": op10_scoring,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_url_filter": op12_url_filter,
        "op13_variants": op13_variants,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.SQL,
        "op5_quality": quality.sql(),
        "op7_lines": lines.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
        "op12_url_filter": url_filter.sql(URL_RULES),
        "op13_variants": variants.SQL,
    }
