"""Traffic assignment: all-or-nothing flows and conjugate Frank-Wolfe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.cost import COSTS, OBJECTIVES, ArrayOps
from roadweave.operators import fronts
from roadweave.operators.search import Shared, Snapshot, _spread, bidirectional, dijkstra, fronts_of, parents, path_edges


def all_or_nothing(edges: DataFrame, od: DataFrame, weight: str = "travel_time", places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flows (edge_id, vol) and distances (od_id, distance) with every trip on its shortest path.

    Trips that cannot arrive have a null distance and load no edge. Each task sums its own
    trips before anything is shuffled. ``places`` as in ``point_to_point``; flows and distances are
    then made apart, each when it is asked for.
    """
    if sent := fronts_of(edges, places, weight):
        return fronts.flows(sent, od), fronts.trips(sent, od).select("od_id", "distance")
    return _load(Snapshot.shared(edges, weight), od)


def _load(sent: Shared | Broadcast, od: DataFrame) -> tuple[DataFrame, DataFrame]:
    schema = "od_id long, distance long, edge_id long, n long"

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        load = np.zeros(len(g.edge), np.int64)
        for frame in frames:
            rows = []
            for origin, group in frame.groupby("origin", sort=False):
                at = g.index(origin)
                places = [g.index(d) for d in group["destination"]]
                dist = parent = None
                if at >= 0:
                    dist, _ = dijkstra(g, at, targets={p for p in places if p >= 0})
                    parent = parents(g, dist)
                for od_id, d, p in zip(group["od_id"], group["destination"], places):
                    if d == origin:
                        rows.append((od_id, 0))
                    elif at < 0 or p < 0 or dist[p] < 0:
                        rows.append((od_id, None))
                    else:
                        rows.append((od_id, int(dist[p])))
                        v = p
                        while v != at:
                            e = parent[v]
                            load[e] += 1
                            v = int(g.tail[e])
            out = pd.DataFrame(rows, columns=["od_id", "distance"]).astype({"od_id": "Int64", "distance": "Int64"})
            out["edge_id"], out["n"] = pd.array([None] * len(out), "Int64"), pd.array([None] * len(out), "Int64")
            yield out
        full = np.flatnonzero(load)
        none = pd.array([None] * len(full), "Int64")
        yield pd.DataFrame({"od_id": none, "distance": none, "edge_id": g.edge[full], "n": load[full]})

    from roadweave.operators.shared import stored

    both = stored(_spread(od.select("od_id", "origin", "destination"), "origin").sortWithinPartitions("origin").mapInPandas(search, schema))
    flows = both.filter("edge_id is not null").groupBy("edge_id").agg(F.sum("n").alias("vol"))
    return flows, both.filter("edge_id is null").select("od_id", "distance")


def distance_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean and greatest relative change of distances (od_id, distance); null if nothing compares."""
    both = before.select("od_id", F.col("distance").alias("old")).join(after, "od_id")
    change = F.try_divide(F.abs(F.col("distance") - F.col("old")), F.col("old"))
    return both.agg(F.avg(change).alias("avg_change"), F.max(change).alias("max_change"))


def bisect(derivative, low: float, high: float, epsilon: float = 1e-15) -> float:
    """Root of an increasing derivative on [low, high]: an end if it has no sign change, else by halving."""
    if derivative(low) >= 0:
        return low
    if derivative(high) <= 0:
        return high
    while high - low > 2 * epsilon:
        middle = low + (high - low) / 2
        if middle in (low, high):
            break
        if derivative(middle) < 0:
            low = middle
        else:
            high = middle
    return low + (high - low) / 2


@dataclass
class Assignment:
    """Result of the loop: arrays by edge in the order of edge_ids, and one stat row an iteration."""

    edge_ids: np.ndarray
    volumes: np.ndarray
    saturations: np.ndarray
    stats: list[dict] = field(default_factory=list)
    distances: DataFrame | None = None
    history: list[np.ndarray] = field(default_factory=list)


def frank_wolfe(
    edges: DataFrame, od: DataFrame, period_hours: float, objective: str = "ue", cost: str = "bpr", iterations: int = 0, gap: float = 1e-4,
    conjugate: bool = True, keep_history: bool = False, lengths: bool = False,
) -> Assignment:
    """Conjugate Frank-Wolfe on ``edges`` and ``od``.

    With ``iterations`` 0 the loop ends when the relative gap is at most ``gap``, else after that
    many iterations. Searches use costs truncated to whole numbers. ``lengths`` takes lengths for
    times and stops after one iteration. The edge vectors live on the driver, where the graph
    snapshot is built anyway; trips stay distributed.
    """
    f, goal = COSTS[cost](ArrayOps), OBJECTIVES[objective]
    graph = Snapshot.of(edges.withColumn("travel_time", F.col("length")) if lengths else edges, "travel_time")
    columns = edges.select("edge_id", "length", F.greatest(F.round(F.col("capacity") * period_hours), F.lit(1)).alias("c")).toPandas().set_index("edge_id").loc[graph.edge]
    t = columns["length"].to_numpy(float) if cost == "inverse" else graph.weight.astype(float)
    c, order = columns["c"].to_numpy(float), np.argsort(graph.edge)
    place = {int(e): k for k, e in enumerate(graph.edge)}
    if lengths:
        iterations = 1
    summed = lambda a: float(np.add.reduce(a[order]))  # noqa: E731  one fixed order of summation

    def load(costs: np.ndarray) -> tuple[np.ndarray, int, DataFrame]:
        g = Snapshot(graph.ids, graph.first, graph.tail, graph.head, np.trunc(costs).astype(np.int64), graph.edge)
        flows, distances = _load(od.sparkSession.sparkContext.broadcast(g), od)
        y = np.zeros(len(graph.edge))
        for r in flows.toLocalIterator():  # one row an edge
            y[place[r.edge_id]] = r.vol
        return y, int(distances.agg(F.coalesce(F.sum("distance"), F.lit(0))).first()[0]), distances

    x, checksum, distances = load(goal.gradient(f, t, c, np.zeros(len(t))))
    out = Assignment(graph.edge[order], x, x / c, [], distances)
    out.stats.append({"iteration": 1, "checksum": checksum, "prev_total_traversal_cost": None, "prev_relative_gap": None})
    s, k = x, 1
    if keep_history:
        out.history.append(x[order])
    while (iterations and k < iterations) or not iterations:
        k += 1
        grad = goal.gradient(f, t, c, x)
        whole = np.trunc(grad)
        total, path_total = summed(x * f.value(t, c, x)), summed(x * whole)
        y, checksum, distances = load(grad)
        reached = 1 - checksum / path_total if path_total else 0.0
        out.stats.append({"iteration": k, "checksum": checksum, "prev_total_traversal_cost": total, "prev_relative_gap": reached})
        if k == 2 or not conjugate:
            s = y
        else:
            h, r, d = goal.curvature(f, t, c, x), s - x, y - x
            num, den = summed(r * h * d), summed(r * h * (d - r))
            alpha = min(max(num / den, 0.0), 1 - 1e-15) if den else 0.0
            s = alpha * s + (1 - alpha) * y
        step = s - x
        tau = bisect(lambda a: summed(step * goal.gradient(f, t, c, x + a * step)), 0.0, 1.0)
        x = x + tau * step
        out.distances = distances
        if keep_history:
            out.history.append(x[order])
        if not iterations and reached <= gap:
            break
    out.volumes, out.saturations = x[order], (x / c)[order]
    return out


def flows_frame(od: DataFrame, result: Assignment) -> DataFrame:
    """(edge_id, vol, sat) of the last iteration as a table."""
    frame = pd.DataFrame({"edge_id": result.edge_ids, "vol": result.volumes, "sat": result.saturations})
    return od.sparkSession.createDataFrame(frame)


__all__ = ["Assignment", "all_or_nothing", "bidirectional", "bisect", "distance_change", "flows_frame", "frank_wolfe", "path_edges"]
