"""Mixing sources to target weights (operator 6), DataFrame functions only.

Method: Pfair scheduling. Every source's documents form blocks of equal bytes. The k-th block
of a source with weight w is released when the ideal fluid mix has given the source k-1
blocks, and is due when it has given k; earliest-deadline-first over the released blocks
then never strays a whole block from the ideal. When a source has no blocks left, the ideal
goes on with the weights of the others, so every document is placed exactly once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm.shared import stored, without

#: Bytes of a block; blocks grow with the corpus so that there are at most MOST_BLOCKS and one a source.
BLOCK_BYTES, MOST_BLOCKS = 256 << 10, 16_384
#: Sources whose schedule is one fold in Spark; that of more is made on the driver.
MOST_SOURCES = 1_000
#: Rows that one task numbers at a time.
LOT_ROWS = 200_000


def tempered_weights(sizes: DataFrame, temperature: float) -> DataFrame:
    """(source, weight): weights in proportion to bytes to the power 1 / temperature."""
    return sizes.select("source", F.pow(F.col("bytes").cast("double"), F.lit(1.0 / temperature)).alias("weight"))


def deal_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``rows`` (_id, _tie, _source, _size and others) with _block (from 0 in each source) and _order, the bytes before.

    Rows are taken lot by lot, in a lot by (_id, _tie); a block ends with the row that fills
    it. Lots are a hash of both, so that a hot source, a repeated doc_id and rows without one
    are numbered by many tasks; only rows alike in id and text share one. Their sums are
    prefixed over the small table of lots.
    """
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    lots = max(8, -(-count // LOT_ROWS) * 4)
    each = max(block_bytes, -(-total // most_blocks))
    rows = rows.withColumn("_lot", F.pmod(F.xxhash64("_id", "_tie"), F.lit(lots).cast("long")).cast("int"))
    sums = rows.groupBy("_source", "_lot").agg(F.sum("_size").alias("_bytes"))
    earlier = Window.partitionBy("_source").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_source").alias("_s"), F.col("_lot").alias("_l"), F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_lot").orderBy(F.col("_id").asc_nulls_first(), "_tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = numbered.join(offsets, (F.col("_source") == F.col("_s")) & (F.col("_lot") == F.col("_l")))
    block = F.floor((F.col("_before") + F.col("_inside")) / F.lit(each)).cast("long")
    return placed.withColumn("_block", block).withColumn("_order", F.col("_before") + F.col("_inside")).drop("_s", "_l", "_before", "_inside", "_lot", "_id", "_tie")


def schedule(supply: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, block, release, deadline, position) of every block.

    ``supply`` has source and blocks, ``weights`` source and weight; sources without a
    positive weight follow after the others, as one more phase with weights by blocks.
    The schedule is one fold over at most MOST_BLOCKS + sources slots, and its state is the
    number of blocks given to each source; ties of deadlines go to the first source by name.
    """
    known = weights.select(F.col("source").alias("_s"), "weight")
    table = supply.join(known, F.col("source") == F.col("_s"), "left").select("source", "blocks", F.when(F.col("weight") > 0, F.col("weight")).alias("weight"))
    # Virtual time: source s gets weight_s blocks a unit, so it runs dry at blocks_s / weight_s.
    dry = F.max(F.when(F.col("weight").isNotNull(), F.col("blocks") / F.col("weight"))).over(Window.partitionBy(F.lit(0)))
    listed = table.withColumn("late", F.col("weight").isNull()).withColumn("start", F.when(F.col("late"), F.coalesce(dry, F.lit(0.0))).otherwise(0.0)).withColumn(
        "weight", F.coalesce("weight", F.col("blocks").cast("double"))
    )
    one = listed.agg(F.sort_array(F.collect_list(F.struct("source", F.col("blocks").cast("int").alias("blocks"), "weight", "start"))).alias("t"))  # sources: bounded

    def given(v: Column) -> Column:
        """Slots that the ideal mix has filled by virtual time v."""
        return F.aggregate("t", F.lit(0.0), lambda a, s: a + F.least(s["blocks"].cast("double"), F.greatest(F.lit(0.0), v - s["start"]) * s["weight"]))

    # Each source's release and deadline slots, so that the fold below only looks them up.
    marks = one.withColumn(
        "marks",
        F.transform(
            "t",
            lambda s: F.when(
                s["blocks"] > 0,
                F.transform(
                    F.sequence(F.lit(1), s["blocks"]),
                    lambda k: F.struct(
                        F.floor(given(s["start"] + (k - 1) / s["weight"]) + 1e-7).cast("int").alias("release"),
                        F.ceil(given(s["start"] + k / s["weight"]) - 1e-7).cast("int").alias("deadline"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<release:int,deadline:int>>")),
        ),
    ).withColumn("slots", F.aggregate("t", F.lit(0), lambda a, s: a + s["blocks"]))

    def pick(taken: Column, slot: Column) -> Column:
        """Index of the source whose next block is released and due first (else due first)."""
        waiting = F.transform(
            "marks",
            lambda m, i: F.when(
                F.get(taken, i) < F.size(m),
                F.struct((F.get(m, F.get(taken, i))["release"] > slot).cast("int").alias("early"), F.get(m, F.get(taken, i))["deadline"].alias("deadline"), i.alias("i")),
            ),
        )
        return F.array_min(waiting)["i"]

    chunk = 128
    step = lambda acc, slot: F.transform(F.array(pick(acc["taken"], slot)), lambda p: F.struct(
        F.transform(acc["taken"], lambda n, i: n + (i == p).cast("int")).alias("taken"), F.array_append(acc["order"], p).alias("order")
    ))[0]
    inner = lambda acc, first: F.transform(F.array(F.aggregate(
        F.sequence(first, F.least(first + chunk, F.col("slots")) - 1), F.struct(acc["taken"].alias("taken"), F.array().cast("array<int>").alias("order")), step
    )), lambda got: F.struct(got["taken"].alias("taken"), F.array_append(acc["order"], got["order"]).alias("order")))[0]
    folded = marks.filter(F.col("slots") > 0).withColumn(
        "order",
        F.flatten(
            F.aggregate(
                F.sequence(F.lit(0), F.col("slots") - 1, F.lit(chunk)),
                F.struct(F.transform("t", lambda s: F.lit(0)).alias("taken"), F.array().cast("array<array<int>>").alias("order")),
                inner,
            )["order"]
        ),
    )
    # One row, stored so that the fold runs once; from here on no row carries an array.
    folded = stored(folded.select("t", "marks", "order"), "mix-fold")
    blocks = F.flatten(F.transform("marks", lambda m, i: F.transform(m, lambda x, k: F.struct(i.alias("i"), k.alias("k"), x["release"].alias("release"), x["deadline"].alias("deadline")))))
    windows = folded.select(F.explode_outer(blocks).alias("b")).select("b.*")
    names = folded.select(F.posexplode_outer(F.transform("t", lambda s: s["source"])).alias("_n", "source"))
    turn = Window.partitionBy("_i").orderBy("position")  # at most MOST_BLOCKS + sources rows
    taken = folded.select(F.posexplode_outer("order").alias("position", "_i")).withColumn("_k", F.row_number().over(turn) - 1)
    placed = taken.join(windows, (F.col("_i") == F.col("i")) & (F.col("_k") == F.col("k"))).join(names, F.col("_i") == F.col("_n"))
    return placed.select("source", F.col("_k").cast("long").alias("block"), "release", "deadline", F.col("position").cast("long").alias("position"))


def windows_of(blocks: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source index, block, release, deadline) of every block, as in ``schedule``.

    The ideal's slots by virtual time are piecewise linear, with corners where a source starts
    or runs dry, so they are summed once over the corners and looked up for every block.
    """
    corners = np.concatenate([start, start + blocks / weight])
    order = np.argsort(corners, kind="stable")
    corners, slope = corners[order], np.cumsum(np.concatenate([weight, -weight])[order], dtype=np.longdouble)  # small weights are left of large sums
    filled = np.concatenate([[0.0], np.cumsum(slope[:-1] * np.diff(corners))])

    def given(v: np.ndarray) -> np.ndarray:
        at = np.maximum(np.searchsorted(corners, v, side="right") - 1, 0)
        return filled[at] + slope[at] * (v - corners[at])

    i = np.repeat(np.arange(len(blocks)), blocks)
    k = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    release = np.floor(given(start[i] + k / weight[i]) + 1e-7).astype(np.int64)
    deadline = np.ceil(given(start[i] + (k + 1) / weight[i]) - 1e-7).astype(np.int64)
    return i, k, release, deadline


def earliest_deadlines(source: np.ndarray, release: np.ndarray, deadline: np.ndarray) -> np.ndarray:
    """Position of every block: in each slot the released one that is due first, of several that of the first source.

    A heap holds the released blocks, at most about one a source.
    """
    order, position = np.lexsort((source, deadline, release)), np.empty(len(source), np.int64)
    heap: list[tuple[int, int, int]] = []
    n, opened, due, owner = 0, release[order].tolist(), deadline[order].tolist(), source[order].tolist()
    for slot in range(len(order)):
        while n < len(order) and (opened[n] <= slot or not heap):
            heapq.heappush(heap, (due[n], owner[n], n))
            n += 1
        position[order[heapq.heappop(heap)[2]]] = slot
    return position


def schedule_many(supply: DataFrame, weights: DataFrame) -> DataFrame:
    """``schedule`` for any number of sources, with a heap on the driver: one row a source goes there, one a block comes back."""
    spark = supply.sparkSession
    table = supply.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source") == F.col("_s"), "left").select("source", "blocks", F.col("weight").cast("double").alias("weight"))
    got = table.filter("blocks > 0").toPandas()
    got = got.iloc[np.argsort(np.array([s.encode() for s in got["source"]], dtype=object), kind="stable")]
    blocks, weight = got["blocks"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)
    late = ~(weight > 0)
    start = np.where(late, (blocks[~late] / weight[~late]).max(initial=0.0), 0.0)
    i, k, release, deadline = windows_of(blocks, np.where(late, blocks, weight), start)
    made = pd.DataFrame({"source": got["source"].to_numpy()[i], "block": k, "release": release, "deadline": deadline, "position": earliest_deadlines(i, release, deadline)})
    return spark.createDataFrame(made, "source string, block long, release int, deadline int, position long")


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 1.4, block_bytes: int = BLOCK_BYTES, most_blocks: int = MOST_BLOCKS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with source_block, release, deadline, position (of the block) and place (in the block).

    ``weights`` (source, weight) are the targets; without them each source's bytes to the
    power 1 / temperature. Every row is placed once: none is dropped or repeated. Null sources
    are one source ''. Null texts have one byte, texts of any length count whole; repeated rows
    are placed one after the other; an empty table gives no rows. Columns ``keep`` (default:
    all) stay, and only they are moved; those named like the new ones, in any case, are
    replaced, all other names may occur. Any number of sources is mixed.
    """
    keep = without(docs.columns if keep is None else keep, ("source_block", "release", "deadline", "position", "place"))
    rows = docs.select(
        F.struct(*keep).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_tie"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("_size"),
    )
    dealt = stored(deal_blocks(rows, block_bytes, most_blocks), "mix-blocks")
    sizes = stored(dealt.groupBy("_source").agg(F.sum("_size").alias("bytes"), (F.max("_block") + 1).alias("blocks")).withColumnRenamed("_source", "source"), "mix-sources")
    many = sizes.count() > MOST_SOURCES
    targets = tempered_weights(sizes, temperature) if weights is None else weights
    plan = stored((schedule_many if many else schedule)(sizes.select("source", "blocks"), targets), "mix-schedule")
    due = plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "release", "deadline", "position")
    # At most MOST_BLOCKS rows and one a source: with few sources it may go to every task.
    placed = dealt.join(due if many else F.broadcast(due), (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return placed.select("_row.*", F.col("_block").alias("source_block"), "release", "deadline", "position", F.col("_order").alias("place"))
