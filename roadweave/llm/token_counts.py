"""Token counts (operator 4).

Method: an exact length histogram. Documents are aggregated by encoded length; suffix
sums over the histogram answer totals, quantiles and truncated totals for every
context limit, without another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.encoding import PieceEncoder


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a document: n_tokens of its whole text (null and empty: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder.of(tokenizer)
        for batch in batches:
            lengths = [len(ids) for ids in coder.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Histogram of ``n_tokens`` with its suffix sums, one row a distinct length.

    n_docs documents have exactly that length; docs_at_least and tokens_at_least sum the
    suffix from it; rank_below documents are shorter; truncated_total is what remains of
    all texts under a context limit of that length, dropped_tokens what it cuts. There are
    as many rows as distinct lengths, so the window holds no more than the longest document
    has tokens. An empty table gives no rows.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    down = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = counts.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(down).alias("docs_at_least"),
        F.sum(tokens).over(down).alias("tokens_at_least"),
        F.sum("n_docs").over(every).alias("all_docs"),
        F.sum(tokens).over(every).alias("total_tokens"),
    )
    cut = F.col("tokens_at_least") - F.col("docs_at_least") * F.col("n_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least")).alias("rank_below"),
        "all_docs",
        "total_tokens",
        (F.col("total_tokens") - cut).alias("truncated_total"),
        cut.alias("dropped_tokens"),
    )


def truncated_total(histogram: DataFrame, limit: int | Column) -> DataFrame:
    """One row: tokens that remain of all documents under any context limit (0 for no documents)."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", limit) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: least length with at least ``share`` of the documents at or below it (null for none)."""
    reached = F.col("rank_below") + F.col("n_docs") >= F.ceil(F.lit(share) * F.col("all_docs"))
    return histogram.filter(reached).agg(F.min("n_tokens").alias("quantile"))
