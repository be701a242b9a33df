"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import chat_format, decontamination, licenses, mixing, ngram_join, oracles, quality_classifier, quality_rules, sharding, token_counts, token_files
from roadweave.llm.shared import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(documents(spark, sf_dir), host="source", keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("shrunk_rate", 9).alias("shrunk_rate"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(documents(spark, sf_dir))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(documents(spark, sf_dir), tokenizer_path())
    return token_counts.length_histogram(lengths)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_hostile_conversation(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_trees(chat_format.conversation_messages(rows)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "source_block", "release", "deadline", "position", "place")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "window")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokenizer_path(), end_id=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=16, carry=["doc_id"])


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_join": op2_ngram_join,
    "op2_ngram_links": op2_ngram_links,
    "op3_license_scans": op3_license_scans,
    "op4_token_counts": op4_token_counts,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = oracles.ORACLES
