"""Closest points of interest over the network: kernel search, and hub labels joined with buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.search import Snapshot, _spread
from roadweave.operators.shared import fresh_path, read_columns


def closest_pois(edges: DataFrame, sources: DataFrame, pois: DataFrame, k: int, weight: str = "travel_time") -> DataFrame:
    """(source, poi_vertex, distance, rank) of the k nearest vertices of ``pois`` (vertex_id); ties to the least vertex.

    The search from each source stops when the k-th answer and its ties are settled.
    """
    import heapq

    sent, path = Snapshot.shared(edges, weight), fresh_path(edges.sparkSession)
    pois.filter("vertex_id is not null").select(F.col("vertex_id").cast("long").alias("vertex_id")).distinct().write.parquet(path)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        is_poi = np.isin(g.ids, read_columns(path, ["vertex_id"])[0]).tolist()
        lists = g.lists()
        for frame in frames:
            rows = []
            for s in frame["source"]:
                at = g.index(s)
                if at < 0:
                    continue
                dist, done, heap, found = {at: 0}, set(), [(0, at)], []
                while heap and (len(found) < k or heap[0][0] <= found[-1][0]):
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    if is_poi[v]:
                        found.append((d, int(g.ids[v])))
                    for h, w in lists[v]:
                        if d + w < dist.get(h, d + w + 1):
                            dist[h] = d + w
                            heapq.heappush(heap, (d + w, h))
                rows += [(s, v, d, r + 1) for r, (d, v) in enumerate(sorted(found)[:k])]
            yield pd.DataFrame(rows, columns=["source", "poi_vertex", "distance", "rank"])

    return _spread(sources.select("source").distinct(), "source").mapInPandas(search, "source long, poi_vertex long, distance long, rank int")


def bucket_closest(up_labels: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The same answers from tables: labels (source, hub, dist) joined with buckets (hub, poi_vertex, dist).

    A bucket is cut after its k first points by (dist, poi_vertex): a later point has k better
    ones over the same hub, so it is no answer over that hub.
    """
    turn = Window.partitionBy("hub").orderBy("dist", "poi_vertex")
    b = buckets.withColumn("_k", F.row_number().over(turn)).filter(F.col("_k") <= k).select("hub", "poi_vertex", F.col("dist").alias("_b"))
    met = up_labels.join(b, "hub").groupBy("source", "poi_vertex").agg(F.min(F.col("dist") + F.col("_b")).alias("distance"))
    rank = Window.partitionBy("source").orderBy("distance", "poi_vertex")
    return met.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def prefix_counts(ranks: DataFrame, pois: DataFrame) -> DataFrame:
    """(rank, n_before): points among the vertices of lesser rank, for every rank (vertex_id, rank)."""
    marked = ranks.join(pois.select("vertex_id", F.lit(1).alias("p")).distinct(), "vertex_id", "left").select("rank", F.coalesce("p", F.lit(0)).alias("p"))
    lot = marked.withColumn("_lot", F.floor(F.col("rank") / 65536))
    sums = lot.groupBy("_lot").agg(F.sum("p").alias("_s"))
    before = sums.select(F.col("_lot").alias("_l"), F.coalesce(F.sum("_s").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_lot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return lot.withColumn("_i", F.coalesce(F.sum("p").over(inside), F.lit(0))).join(before, F.col("_lot") == F.col("_l")).select("rank", (F.col("_b") + F.col("_i")).alias("n_before"))


def ball(distances: DataFrame, size: int) -> DataFrame:
    """The first ``size`` vertices of each source by (distance, vertex)."""
    return distances.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("distance", "vertex_id"))).filter(F.col("_r") <= size).drop("_r")
