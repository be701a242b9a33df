"""Row operators: permutations, samples of every n-th row, differences, matched shares, matched trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.graph import range_ids


def shuffled(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """``df`` with its place in a random permutation, drawn by a hash of (seed, key); keys are unique."""
    return range_ids(df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), ["_draw"], name).drop("_draw")


def every_nth(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Rows 0, step, 2 * step and so on in ``order``."""
    return range_ids(df, order, "_k").filter(F.col("_k") % step == 0).drop("_k")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have; a null key is one like any other."""
    other = right.select(F.col(key).alias("_other")).distinct()
    return left.select(key).distinct().join(other, F.col(key).eqNullSafe(F.col("_other")), "left_anti")


def percent_matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n rows, those whose key ``right`` has, and their share in percent (null for no rows)."""
    other = right.select(F.col(key).alias("_other")).distinct()
    both = left.join(other, F.col(key) == F.col("_other"), "left")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count("_other").alias("matched"))
    return counts.withColumn("percent", F.try_divide(100.0 * F.col("matched"), F.col("n")))


def draw(seed: int, n: Column | int, *keys: Column | str) -> Column:
    """A number from 0 to n - 1 by 32 bits of a digest that other engines have too."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n.cast("long"))


def matched_trips(matches: DataFrame, trips: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same random trips on two networks: (od_id, origin, destination) in the ids of either.

    ``matches`` has left_id and right_id of vertices that are each other's; ``trips`` od_id.
    Both ends are drawn uniformly among the matches, numbered by left_id.
    """
    numbered = range_ids(matches, ["left_id"], "_k")
    n = matches.count()
    drawn = trips.select("od_id", draw(seed, max(1, n), F.lit("o"), "od_id").alias("_o"), draw(seed, max(1, n), F.lit("d"), "od_id").alias("_d"))

    def ends(side: str) -> DataFrame:
        at = lambda k, name: numbered.select(F.col("_k").alias(k), F.col(side).alias(name))
        return drawn.join(at("_o", "origin"), "_o").join(at("_d", "destination"), "_d").select("od_id", "origin", "destination")

    return ends("left_id"), ends("right_id")
