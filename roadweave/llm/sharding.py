"""Sharding (operator 10).

Method: histogram sort. Rows are ordered by a hash of doc_id (then by a row number that
splits repeated ids), or by their place in the stored input. The driver keeps an interval of keys for each wanted splitter and
asks the partitions, again and again, for the exact bytes and rows between candidate keys;
each answer narrows the intervals until every splitter meets its tolerance. Only then do
the rows move, in one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.shared import stored, without

#: Bytes that one task of the exchange should sort; at most so many parts in all.
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 16
#: Candidate keys that one round asks about, over all splitters.
PROBES = 1024
TOP = 1 << 128


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys of 16 bytes whose byte order is the order of (high, low) as unsigned numbers."""
    both = np.empty((len(high), 2), dtype=">u8")
    both[:, 0], both[:, 1] = high.view(np.uint64), low.view(np.uint64)
    return both.view("S16").ravel()


def _as_keys(numbers: list[int]) -> np.ndarray:
    return np.array([x.to_bytes(16, "big") for x in numbers], dtype="S16")


def _count_between(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, least and greatest key for each gap between probes that holds rows.

    Gap k holds the keys from probe k-1 up to, not including, probe k. Each task sends at
    most one row a gap, and the driver gets at most ``len(probes) + 1``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, n = _as_keys(probes), len(probes) + 1
        total, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = [b"\xff" * 16] * n, [b""] * n
        for batch in batches:
            keys = _joined(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            gap = np.searchsorted(edges, keys, side="right")
            np.add.at(total, gap, sizes)
            number += np.bincount(gap, minlength=n)
            order = np.lexsort((keys, gap))
            gap, keys = gap[order], keys[order]
            first = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(gap)] - 1):
                g = gap[a]
                least[g] = min(least[g], keys[a].ljust(16, b"\0"))
                most[g] = max(most[g], keys[b].ljust(16, b"\0"))
        full = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int64()),
                pa.array(total[full], pa.int64()),
                pa.array(number[full], pa.int64()),
                pa.array([least[g] for g in full], pa.binary()),
                pa.array([most[g] for g in full], pa.binary()),
            ],
            names=["gap", "bytes", "rows", "least", "most"],
        )

    got = (
        rows.select("_key", "_tie", "size")
        .mapInArrow(count, "gap long, bytes long, rows long, least binary, most binary")
        .groupBy("gap")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
        .collect()  # at most PROBES or eight a splitter, and two edges a splitter
    )
    return {r.gap: (r.bytes, r.rows, int.from_bytes(r.least, "big"), int.from_bytes(r.most, "big")) for r in got}


class _Splitter:
    """Interval of keys in which one splitter lies, with exact bytes and rows below both ends."""

    def __init__(self, target: float, tolerance: float, total: int, rows: int) -> None:
        self.target, self.tolerance = target, tolerance
        self.low, self.high = (0, 0, 0), (TOP - 1, total, rows)
        self.inside, self.key = rows, None

    def settle(self) -> None:
        near = min(self.low, self.high, key=lambda end: abs(end[1] - self.target))
        if abs(near[1] - self.target) <= self.tolerance or self.inside <= 1 or self.high[0] - self.low[0] <= 1:
            self.key = near


def splitters(rows: DataFrame, shards: int, tolerance: float, parts_each: int) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the ``shards * parts_each - 1`` splitters, ascending."""
    total, number = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n = shards * parts_each
    strict, loose = tolerance * total / shards, 0.25 * total / n
    found = [_Splitter(total * k / n, strict if k % parts_each == 0 else loose, total, number) for k in range(1, n)]
    for s in found:
        s.settle()
    while open_ := [s for s in found if s.key is None]:
        each = max(8, PROBES // len(open_))
        probes = set()
        for s in open_:
            a, b = s.low[0], s.high[0]
            step = min(each, b - a - 1)
            probes.update((a, b))  # so that no gap reaches beyond the interval
            probes.update(a + (b - a) * i // (step + 1) for i in range(1, step + 1))
        edges = sorted(probes)
        gaps = _count_between(rows, edges)
        ends, below, held = [], (0, 0), []
        for g in range(len(edges) + 1):
            size, n_rows, least, most = gaps.get(g, (0, 0, 0, 0))
            start, below = below, (below[0] + size, below[1] + n_rows)
            if n_rows:
                held.append((start, below, n_rows, least, most))
        for s in open_:
            for start, end, n_rows, least, most in held:
                if start[0] <= s.target <= end[0]:
                    s.low, s.high, s.inside = (least, *start), (most + 1, *end), n_rows
                    break
            s.settle()
    ordered = sorted(s.key for s in found)
    return [(min(k, TOP - 1), b, r) for k, b, r in ordered]


def stored_place() -> tuple[Column, Column]:
    """(file, row) of each row of a table that Spark wrote as Parquet; their order is the order it was written in.

    File is the number of the task that wrote it, then the count of its files. Only a plan
    straight over the stored table has them.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return number(r"^part-(\d+)-") * (1 << 20) + F.coalesce(number(r"-c(\d+)\."), F.lit(0)), F.col("_metadata.row_index")


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.001, carry: list[str] | None = None, part_bytes: int = PART_BYTES, order: tuple[Column, Column] | None = None
) -> DataFrame:
    """Deal rows into ``shards`` of near equal bytes: ``carry`` columns, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1, crc of nothing, 0). Shards
    differ from the mean by ``tolerance`` of it or by about one document, whichever is more.
    Rows that repeat, even with equal doc_id, are told apart by a stored row number, so a
    hot key is split like any other. With ``order``, two longs from 0 that tell all rows apart
    (see ``stored_place``), shards and slots follow it instead of the hash: shard by shard and
    slot by slot, the rows come in that order. Null doc_ids hash alike. Fewer rows than shards leave
    shards empty; an empty table gives an empty result. Texts of any length count whole.
    Columns of the input named like the output, in any case, are replaced; all other names
    may occur.
    """
    keep = without(carry if carry is not None else docs.columns, ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    key, tie = order or (F.xxhash64(F.lit("shard"), "doc_id"), F.monotonically_increasing_id())
    rows = stored(
        docs.select(
            F.struct(*keep).alias("_kept"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            key.alias("_key"),
            tie.alias("_tie"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts_each = max(1, min(MOST_PARTS // shards, math.ceil(total / shards / part_bytes)))
    found = splitters(rows, shards, tolerance, parts_each) if total else [(TOP - 1, 0, 0)] * (shards * parts_each - 1)
    edges = [k for k, _, _ in found]
    below = [0, *(r for _, _, r in found)]
    offsets = [below[p] - below[p - p % parts_each] for p in range(shards * parts_each)]

    @F.pandas_udf("long")
    def part_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(_as_keys(edges), _joined(key.to_numpy(), tie.to_numpy()), side="right"))

    # The keys count as unsigned, so the order within a part does too.
    unsigned = [F.col("_key") < 0, F.col("_key"), F.col("_tie")]
    inside = Window.partitionBy("_part").orderBy(*unsigned)
    dealt = rows.withColumn("_part", part_of("_key", "_tie")).withColumn("_row", F.row_number().over(inside) - 1)
    return dealt.select(
        "_kept.*",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("_part") / parts_each).cast("int").alias("shard"),
        (F.get(F.lit(offsets), F.col("_part").cast("int")).cast("long") + F.col("_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
