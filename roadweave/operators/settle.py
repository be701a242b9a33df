"""Answers read off the settled order of one search a source, which ends as soon as all are known.

The order is (distance, vertex). Requests of one source share its search; each request gives one
row, and no distances of other vertices leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators import fronts
from roadweave.operators.search import Snapshot, _held, _spread, fronts_of, settled
from roadweave.operators.shared import fresh_path, read_columns

#: Gets the snapshot, opportunities by place, a source's place and its requests; gives the rows.
Answer = Callable[[Snapshot, np.ndarray, int, pd.DataFrame], pd.DataFrame]


def _settled(edges: DataFrame, asked: DataFrame, answer: Answer, schema: str, weight: str, opportunities: DataFrame | None = None) -> DataFrame:
    """``answer`` for the requests (source, ...) of each source; sources without edges give nothing."""
    sent, path = Snapshot.shared(edges, weight), None
    if opportunities is not None:
        path = fresh_path(edges.sparkSession)
        opportunities.filter("vertex_id is not null and n is not null").groupBy(F.col("vertex_id").cast("long").alias("vertex_id")).agg(F.sum("n").cast("long").alias("n")).write.parquet(path)
    names = [c.split()[0] for c in schema.split(", ")]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        n = _counts(g, path)
        for frame in frames:
            made = [answer(g, n, at, own) for source, own in frame.groupby("source", sort=False) if (at := g.index(source)) >= 0]
            yield pd.concat(made)[names] if made else pd.DataFrame({c: [] for c in names})

    return _spread(asked, "source").sortWithinPartitions("source").mapInPandas(search, schema)


def _counts(graph: Snapshot, path: str | None) -> np.ndarray:
    """Opportunities by place, of vertices with an edge; read once by each worker."""
    if path is None:
        return np.zeros(0, np.int64)
    if path not in (kept := graph.__dict__.setdefault("_counted", {})):
        vertices, n = read_columns(path, ["vertex_id", "n"])
        known = _held(graph.ids, vertices)
        kept[path] = np.zeros(len(graph.ids), np.int64)
        kept[path][np.searchsorted(graph.ids, vertices[known])] = n[known]
    return kept[path]


def within(edges: DataFrame, sources: DataFrame, limit: int, weight: str = "travel_time") -> DataFrame:
    """(source, vertex_id, distance) of the vertices at most ``limit`` away; no search goes beyond."""

    def answer(g: Snapshot, _: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        order, reached = settled(g, at, stop=lambda v, d: d > limit)
        k = int(np.searchsorted(reached, limit, side="right"))
        return pd.DataFrame({"source": own["source"].iloc[0], "vertex_id": g.ids[order[:k]], "distance": reached[:k]})

    return _settled(edges, sources.select("source").distinct(), answer, "source long, vertex_id long, distance long", weight)


def nearest(edges: DataFrame, sources: DataFrame, size: int, weight: str = "travel_time") -> DataFrame:
    """(source, vertex_id, distance) of the first ``size`` vertices in order."""

    def answer(g: Snapshot, _: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        left = iter(range(size - 1, -1, -1))
        order, reached = settled(g, at, stop=lambda v, d: next(left) == 0)
        return pd.DataFrame({"source": own["source"].iloc[0], "vertex_id": g.ids[order], "distance": reached})

    return _settled(edges, sources.select("source").distinct(), answer, "source long, vertex_id long, distance long", weight)


def ranks(edges: DataFrame, od: DataFrame, weight: str = "travel_time", places: DataFrame | None = None) -> DataFrame:
    """(od_id, source, vertex_id, rank): place of the destination ``vertex_id`` in order; trips without a way get no row.

    ``places`` as in ``search.point_to_point``.
    """
    if sent := fronts_of(edges, places, weight):
        return fronts.before(sent, od).withColumnRenamed("n", "rank")

    def answer(g: Snapshot, _: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        place = own["vertex_id"].map(g.index).to_numpy()
        order, _ = settled(g, at, targets=set(place[place >= 0].tolist()) or {at})
        of = dict(zip(order, range(len(order))))
        own = own.assign(rank=[of.get(p, -1) for p in place])
        return own[own["rank"] >= 0]

    return _settled(edges, od.select("od_id", "source", "vertex_id"), answer, "od_id long, source long, vertex_id long, rank long", weight)


def between(edges: DataFrame, od: DataFrame, opportunities: DataFrame, weight: str = "travel_time", places: DataFrame | None = None) -> DataFrame:
    """(od_id, source, vertex_id, between): opportunities before the destination in order, without the source's own.

    ``places`` as in ``search.point_to_point``.
    """
    if sent := fronts_of(edges, places, weight):
        return fronts.before(sent, od, opportunities).withColumnRenamed("n", "between")

    def answer(g: Snapshot, n: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        place = own["vertex_id"].map(g.index).to_numpy()
        order, _ = settled(g, at, targets=set(place[place >= 0].tolist()) or {at})
        passed = np.cumsum(n[order]) - n[order] - n[at]
        of = dict(zip(order, passed.tolist())) | {at: 0}
        own = own.assign(between=[of.get(p, -1) for p in place])
        return own[own["between"] >= 0]

    return _settled(edges, od.select("od_id", "source", "vertex_id"), answer, "od_id long, source long, vertex_id long, between long", weight, opportunities)


def at_rank(edges: DataFrame, trips: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(trip_id, source, destination): the vertex at the wanted place ``rank``; no row beyond what can be reached."""

    def answer(g: Snapshot, _: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        left = iter(range(int(own["rank"].max()), -1, -1))
        order, _ = settled(g, at, stop=lambda v, d: next(left, 0) <= 0)
        own = own[own["rank"].between(0, len(order) - 1)]
        return own.assign(destination=g.ids[np.array(order, np.int64)[own["rank"].to_numpy(np.int64)]])

    return _settled(edges, trips.select("trip_id", "source", "rank"), answer, "trip_id long, source long, destination long", weight)


def at_distance(edges: DataFrame, trips: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(trip_id, source, destination, distance): the first vertex in order at ``least`` or farther."""

    def answer(g: Snapshot, _: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        most = own["least"].max()
        order, reached = settled(g, at, stop=lambda v, d: d >= most)
        reached = np.array(reached, np.int64)
        k = np.searchsorted(reached, own["least"].to_numpy())
        own, k = own[k < len(order)], k[k < len(order)]
        return own.assign(destination=g.ids[np.array(order, np.int64)[k]], distance=reached[k])

    return _settled(edges, trips.select("trip_id", "source", "least"), answer, "trip_id long, source long, destination long, distance long", weight)


def after_skips(edges: DataFrame, trips: DataFrame, opportunities: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(trip_id, source, destination): the first vertex in order at which the opportunities passed exceed ``skip``."""

    def answer(g: Snapshot, n: np.ndarray, at: int, own: pd.DataFrame) -> pd.DataFrame:
        most, passed = int(own["skip"].max()), 0

        def enough(vertex: int, _: int) -> bool:
            nonlocal passed
            passed += int(n[g.index(vertex)])
            return passed > most

        order, _ = settled(g, at, stop=enough)
        k = np.searchsorted(np.cumsum(n[order]), own["skip"].to_numpy(), side="right")
        own, k = own[k < len(order)], k[k < len(order)]
        return own.assign(destination=g.ids[np.array(order, np.int64)[k]])

    return _settled(edges, trips.select("trip_id", "source", "skip"), answer, "trip_id long, source long, destination long", weight, opportunities)
