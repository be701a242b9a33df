"""Corpus pipeline: five stages of the training-data operators over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. A stage's intermediates lie in the shared folder
and are deleted when the next stage begins; by then its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from roadweave.llm.shared import documents, stage_tables, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep (operator 1); rejected ones go.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty.
    """
    with stage_tables(spark):
        return quality_rules.judge_documents(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join stays (operator 2), the least doc_id.

    Rows with null or repeated doc_id are judged by their own texts; rows without a text stay;
    an empty table stays empty.
    """
    with stage_tables(spark):
        return ngram_join.keep_one_each(docs.select(*COLUMNS))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (operator 7).

    Rows with null or repeated doc_id are judged by their own texts; rows without a text stay;
    an empty table stays empty.
    """
    with stage_tables(spark):
        return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mix of their sources (operator 6).

    The result is range-partitioned and sorted by the schedule, so that the files written,
    one after the other, are the mix; every row is in it once, repeated ones as often as they
    come. Null sources are one source; an empty table stays empty.
    """
    with stage_tables(spark):
        mixed = mixing.mix(docs.select(*COLUMNS))
        parts = min(1 << 16, max(1, mixed.select(F.sum(F.octet_length("text"))).first()[0] or 0) // (32 << 20) + 1)
        return mixed.repartitionByRange(parts, "position", "place").sortWithinPartitions("position", "place").select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot (operator 10), 16 shards of near equal bytes.

    ``docs`` is the mixing stage's stored result, and the order of its rows is the mix. Shards
    and slots keep it: shard after shard, slot after slot, they are the mix. Null texts have one
    byte, repeated rows are told apart by their place; an empty table stays empty.
    """
    with stage_tables(spark):
        return sharding.shard_by_bytes(docs, shards=16, carry=list(COLUMNS), order=sharding.stored_place())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: No SQL expresses the last two stages (a schedule's fold and its order); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``sf_dir``'s documents, each stage's result written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
