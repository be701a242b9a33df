"""A hierarchy of dense fronts: nested dissection with all distances inside each separator's region.

The parts of the dissection form a tree; a node owns the vertices of its separator (a leaf: all of
its part) and borders on those vertices of its ancestors that its region touches. Its front holds the distances, by ways
through its region alone, between its own and its border's vertices. Both ends of a trip climb the tree
to all separators above them and meet at the least sum; exact distances come down to any node again.
Points of interest wait in the buckets of the vertices that they climb to.

The driver builds one front at a time from arrays and writes it to the shared folder; tasks map the files.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.hierarchy import _neighbours, bisect
from roadweave.operators.search import _spread
from roadweave.operators.shared import columns_of, fresh_path, read_columns

#: Most vertices of a leaf, pivots closed together, elements of a strip that stays in a core's cache.
LEAF, PIVOTS, STRIP = 64, 64, 1 << 16
#: Steps of paths in a batch of rows, trips that go down the tree together.
ROWS, LANES = 1_000_000, 256


def _close(f: np.ndarray, own: int) -> None:
    """Least distances by ways over the first ``own`` vertices, in place."""
    m = len(f)
    rows = max(1, STRIP // max(1, m))
    room = np.empty((max(min(PIVOTS, own), min(rows, m)), m), f.dtype)
    for a in range(0, own, PIVOTS):
        b = min(own, a + PIVOTS)
        panel, via = f[a:b], room[: b - a]
        for j in range(a, b):
            np.add(panel[:, j, None], f[j], out=via)
            np.minimum(panel, via, out=panel)
        for begin, end in ((0, a), (b, m)):
            for r in range(begin, end, rows):
                strip = f[r : min(end, r + rows)]
                via = room[: len(strip)]
                for j in range(a, b):
                    np.add(strip[:, j, None], f[j], out=via)
                    np.minimum(strip, via, out=strip)


def build(vertices: DataFrame, edges: DataFrame, weight: str = "travel_time") -> "Shared":
    """The fronts of ``edges`` (edge_id, tail, head, weight), cut by the places of ``vertices`` (vertex_id, x, y), in the shared folder."""
    from pyarrow import fs

    known, x, y = columns_of(vertices, ["vertex_id", "x", "y"])
    tail, head, w, edge = columns_of(edges.select("tail", "head", F.col(weight).alias("w"), "edge_id"), ["tail", "head", "w", "edge_id"])
    ids = np.union1d(known, np.union1d(tail, head))
    xy = np.zeros((len(ids), 2), np.int64)  # ends without a place lie at the origin
    xy[np.searchsorted(ids, known)] = np.stack([x, y], axis=1)
    del known, x, y
    first, near = _neighbours(ids, tail, head)
    upper, owned, parent = np.zeros(len(ids), bool), [], []
    todo = [(np.arange(len(ids), dtype=np.int32), -1)]
    while todo:  # a node comes before its children, a subtree in one piece
        part, above = todo.pop()
        parent.append(above)
        if len(part) <= LEAF:
            owned.append(np.sort(part))
            continue
        cut, rest, high = bisect(part, xy, first, near, upper)
        owned.append(np.sort(cut))
        todo += [(half, len(parent) - 1) for half in (high, rest)]
    del first, near, upper, xy
    lo = np.r_[0, np.cumsum([len(x) for x in owned])]
    order = np.concatenate(owned)
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    ids, owned = ids[order], None
    tail, head = place[np.searchsorted(ids_sorted := np.sort(ids), tail)], place[np.searchsorted(ids_sorted, head)]
    kind, far = (np.int32, 1 << 29) if w.max(initial=0) * len(ids) < 1 << 29 else (np.int64, 1 << 60)
    by_head = np.lexsort((edge, head))
    into = {"into": np.r_[0, np.cumsum(np.bincount(head, minlength=len(ids)))], "tail": tail[by_head], "weight": w[by_head].astype(kind), "edge": edge[by_head]}
    deep = np.argsort(np.maximum(tail, head), kind="stable")  # an edge belongs to the node of its deeper end
    tail, head, w = tail[deep], head[deep], w[deep].astype(kind)
    cuts = np.searchsorted(np.maximum(tail, head), lo)
    path = fresh_path(edges.sparkSession)
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    border: list[np.ndarray] = [None] * len(parent)
    handed: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    at, offsets = 0, np.zeros(len(parent), np.int64)
    with store.open_output_stream(f"{base}/blocks") as out:
        for k in range(len(parent) - 1, -1, -1):
            begin, own = lo[k], int(lo[k + 1] - lo[k])
            a, b, c = tail[cuts[k] : cuts[k + 1]], head[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]]
            below = handed.pop(k, [])
            rim = np.unique(np.concatenate([a, b, *(x for x, _ in below)]))
            rim = border[k] = rim[rim < begin].astype(np.int32)
            m = own + len(rim)
            local = lambda v: np.where(v >= begin, v - begin, own + np.searchsorted(rim, v))  # noqa: B023, E731
            f = np.full((m, m), far, kind)
            np.fill_diagonal(f, 0)
            np.minimum.at(f, (local(a), local(b)), c)
            for met, dist in below:
                i = np.ix_(l := local(met), l)
                f[i] = np.minimum(f[i], dist)
            _close(f, own)
            offsets[k], at = at, at + 2 * own * m
            out.write(f[:own].tobytes())
            out.write(np.ascontiguousarray(f[:, :own].T).tobytes())
            if parent[k] >= 0 and len(rim):
                handed.setdefault(parent[k], []).append((rim, f[own:, own:].copy()))
    arrays = {"ids": ids, "lo": lo, "parent": np.array(parent), "rims": np.r_[0, np.cumsum([len(x) for x in border])], "rim": np.concatenate(border), "offsets": offsets, "far": np.array([far], kind)}
    for name, values in (arrays | into).items():
        buffer = io.BytesIO()
        np.save(buffer, values)
        with store.open_output_stream(f"{base}/{name}.npy") as out:
            out.write(buffer.getbuffer())
    return Shared(path)


_read: dict[str, "Fronts"] = {}


@dataclass
class Shared:
    """Fronts by their path; a process keeps the last that it read."""

    path: str

    @property
    def value(self) -> "Fronts":
        if self.path not in _read:
            _read.clear()
            _read[self.path] = Fronts(self.path)
        return _read[self.path]


class Fronts:
    """Vertices are places: a node's own are lo[k] to lo[k + 1], an ancestor's are less."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        local = isinstance(store, fs.LocalFileSystem)  # else the files are held in memory

        def load(name: str) -> np.ndarray:
            return np.load(f"{base}/{name}.npy", mmap_mode="r") if local else np.load(io.BytesIO(store.open_input_file(f"{base}/{name}.npy").read()))

        self.ids, self.lo, self.parent, self.rims, self.rim, self.offsets, far = map(load, ("ids", "lo", "parent", "rims", "rim", "offsets", "far"))
        self.into, self.tail, self.weight, self.edge = map(load, ("into", "tail", "weight", "edge"))
        self.far, kind = far[0], far.dtype
        if not store.get_file_info(f"{base}/blocks").size:
            self.blocks = np.zeros(0, kind)
        elif local:
            self.blocks = np.memmap(f"{base}/blocks", kind, "r")
        else:
            self.blocks = np.frombuffer(store.open_input_file(f"{base}/blocks").read(), kind)
        self.by_id = np.argsort(self.ids).astype(np.int32)
        self.sorted = self.ids[self.by_id]

    def places(self, vertices: np.ndarray) -> np.ndarray:
        """Place of each vertex, -1 for unknown ones."""
        if not len(self.ids):
            return np.full(len(vertices), -1)
        at = np.minimum(np.searchsorted(self.sorted, vertices), len(self.ids) - 1)
        return np.where(self.sorted[at] == vertices, self.by_id[at], -1)

    def node(self, place: int) -> int:
        return int(np.searchsorted(self.lo, place, side="right")) - 1

    def border(self, k: int) -> np.ndarray:
        return self.rim[self.rims[k] : self.rims[k + 1]]

    def block(self, k: int, back: bool) -> np.ndarray:
        """Distances from (back: to) each own vertex, to (back: from) the own ones and the border."""
        own = int(self.lo[k + 1] - self.lo[k])
        size = own * (own + int(self.rims[k + 1] - self.rims[k]))
        at = int(self.offsets[k]) + size * back
        return self.blocks[at : at + size].reshape(own, -1)

    def steps(self, place: int, back: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From the place's node up to the root: the node, distances from (back: to) the place and its own vertices and its border, by ways through its region."""
        k = self.node(place)
        own = int(self.lo[k + 1] - self.lo[k])
        row = self.block(k, back)[place - self.lo[k]]
        rim, dist = self.border(k), row[own:]
        yield k, row[:own], dist
        while (k := int(self.parent[k])) >= 0:
            begin, own, above = self.lo[k], int(self.lo[k + 1] - self.lo[k]), self.border(k)
            d = np.full(own + len(above), self.far)
            d[np.where(rim >= begin, rim - begin, own + np.searchsorted(above, rim))] = dist
            if len(start := np.flatnonzero(d[:own] < self.far)):
                block = self.block(k, back)
                d = np.minimum(d, (block[start] if len(start) < own else block).__add__(d[start, None]).min(axis=0))
            rim, dist = above, d[own:]
            yield k, d[:own], dist

    def climb(self, place: int, back: bool) -> tuple[list[int], np.ndarray]:
        """The nodes from the root down to the place's, and distances from (back: to) the place and all they own, by ways through each node's region."""
        nodes, found, _ = zip(*self.steps(place, back))
        return list(nodes[::-1]), np.concatenate(found[::-1])

    def between(self, a: tuple[list[int], np.ndarray], b: tuple[list[int], np.ndarray]) -> int:
        """Distance from a climb to a climb back; -1 if there is no way."""
        n = 0
        for p, q in zip(a[0], b[0]):
            if p != q:
                break
            n += int(self.lo[p + 1] - self.lo[p])
        least = int((a[1][:n] + b[1][:n]).min()) if n else int(self.far)
        return least if least < self.far else -1


class Reach:
    """Exact distances from one place, made for a node when they are asked for."""

    def __init__(self, fronts: Fronts, climb: tuple[list[int], np.ndarray], room: np.ndarray) -> None:
        self.fronts, self.dist, self.done, self.inner, at = fronts, room, set(), {}, 0
        for k in climb[0]:
            own = int(fronts.lo[k + 1] - fronts.lo[k])
            self.inner[k] = climb[1][at : at + own]
            at += own

    def make(self, k: int) -> None:
        """Distances of a node's own vertices, its ancestors' first."""
        g, todo = self.fronts, []
        while k >= 0 and k not in self.done:
            todo.append(k)
            k = int(g.parent[k])
        for k in reversed(todo):
            a, b = int(g.lo[k]), int(g.lo[k + 1])
            rim, least = g.border(k), self.inner.get(k)
            if len(rim) and b > a:
                outer = (g.block(k, True)[:, b - a :] + self.dist[rim]).min(axis=1)
                least = outer if least is None else np.minimum(least, outer)
            self.dist[a:b] = g.far if least is None else least
            self.done.add(k)

    def path(self, source: int, target: int) -> list[int]:
        """Places in ``fronts.edge`` of the edges from source to target, which must be reached: each vertex is entered by its tight edge of least id."""
        g, out, v, dist = self.fronts, [], target, self.dist
        self.make(node := g.node(v))
        begin, end = int(g.lo[node]), int(g.lo[node + 1])
        while v != source:
            a, b = int(g.into[v]), int(g.into[v + 1])
            d = int(dist[v])
            for e, u, w in zip(range(a, b), g.tail[a:b].tolist(), g.weight[a:b].tolist()):
                if not begin <= u < end:
                    self.make(k := g.node(u))
                if int(dist[u]) + w == d:
                    out.append(e)
                    v = u
                    break
            if not begin <= v < end:
                node = g.node(v)
                begin, end = int(g.lo[node]), int(g.lo[node + 1])
        return out[::-1]


def _asked(g: Fronts, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple | None, pd.DataFrame, list[int]]]:
    """Place and climb of each origin (-1 and none if unknown), its trips, the places of their destinations."""
    for frame in frames:
        for origin, group in frame.groupby("origin", sort=False):
            at = int(g.places(np.array([origin]))[0])
            yield at, g.climb(at, False) if at >= 0 else None, group, g.places(group["destination"].to_numpy()).tolist()


def _least(g: Fronts, at: int, up: tuple | None, same: bool, end: int) -> int:
    return 0 if same else g.between(up, g.climb(end, True)) if at >= 0 and end >= 0 else -1


def _by_origin(od: DataFrame) -> DataFrame:
    return _spread(od.select("od_id", "origin", "destination"), "origin").sortWithinPartitions("origin")


def trips(sent: Shared, od: DataFrame, paths: bool = False) -> DataFrame:
    """(od_id, origin, destination, distance, path): null distance and path where there is no way; without ``paths`` all paths are null.

    Trips of one origin share its climb.
    """

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        room = np.empty(len(g.ids), g.far.dtype)
        rows, size = [], 0

        def out() -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=["od_id", "origin", "destination", "distance", "path"])
            made["distance"] = made["distance"].astype("Int64")
            return made

        for at, up, group, ends in _asked(g, frames):
            reach = Reach(g, up, room) if at >= 0 and paths else None
            for od_id, o, d, p in zip(group["od_id"].tolist(), group["origin"].tolist(), group["destination"].tolist(), ends):
                least = _least(g, at, up, o == d, p)
                way = g.edge[reach.path(at, p)] if paths and least > 0 else np.zeros(0, np.int64) if not least and paths else None
                rows.append((od_id, o, d, least if least >= 0 else None, way))
                size += 20 + len(way if way is not None else ())
            if size > ROWS:
                yield out()
                rows, size = [], 0
        yield out()

    return _by_origin(od).mapInPandas(search, "od_id long, origin long, destination long, distance long, path array<long>")


def flows(sent: Shared, od: DataFrame) -> DataFrame:
    """(edge_id, vol) with every trip on the path of ``trips``; each task sums its own."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        room, load = np.empty(len(g.ids), g.far.dtype), np.zeros(len(g.edge), np.int64)
        for at, up, group, ends in _asked(g, frames):
            reach = Reach(g, up, room) if at >= 0 else None
            for o, d, p in zip(group["origin"].tolist(), group["destination"].tolist(), ends):
                if _least(g, at, up, o == d, p) > 0:
                    load[reach.path(at, p)] += 1  # no edge twice in a path
        full = np.flatnonzero(load)
        yield pd.DataFrame({"edge_id": g.edge[full], "n": load[full]})

    return _by_origin(od).mapInPandas(search, "edge_id long, n long").groupBy("edge_id").agg(F.sum("n").alias("vol"))


def timed(sent: Shared, od: DataFrame) -> DataFrame:
    """(od_id, distance, query_time): each trip by itself, with the nanoseconds its two climbs took; null distance without a way."""
    import time

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for frame in frames:
            distances, times = [], []
            for origin, destination in zip(frame["origin"].tolist(), frame["destination"].tolist()):
                began = time.perf_counter_ns()
                at, end = g.places(np.array([origin, destination])).tolist()
                d = _least(g, at, g.climb(at, False) if at >= 0 and origin != destination else None, origin == destination, end)
                times.append(time.perf_counter_ns() - began)
                distances.append(d if d >= 0 else None)
            yield pd.DataFrame({"od_id": frame["od_id"], "distance": pd.array(distances, "Int64"), "query_time": times})

    return _spread(od.select("od_id", "origin", "destination"), "od_id").mapInPandas(search, "od_id long, distance long, query_time long")


def before(sent: Shared, od: DataFrame, opportunities: DataFrame | None = None) -> DataFrame:
    """(od_id, source, vertex_id, n): vertices, or their opportunities (vertex_id, n), before the destination in the order
    (distance, vertex) from the source; no row for trips without a way and sources without an edge. Weights must be positive.

    LANES trips of near sources go down the tree together; only the nodes above the current one keep their distances.
    """
    path = None
    if opportunities is not None:
        path = fresh_path(od.sparkSession)
        opportunities.filter("vertex_id is not null and n is not null").groupBy(F.col("vertex_id").cast("long").alias("vertex_id")).agg(F.sum("n").cast("long").alias("n")).write.parquet(path)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        counted = np.ones(len(g.ids), np.int64)
        if path is not None:
            vertices, n = read_columns(path, ["vertex_id", "n"])
            at, counted = g.places(vertices), np.zeros(len(g.ids), np.int64)
            counted[at[at >= 0]] = n[at >= 0]
        linked = np.diff(g.into) > 0
        linked[g.tail] = True
        asked = pd.concat(list(frames) or [pd.DataFrame({"od_id": [], "source": [], "vertex_id": []}, dtype="int64")])
        asked = asked.assign(_a=g.places(asked["source"].to_numpy()), _b=g.places(asked["vertex_id"].to_numpy()))
        asked = asked[(asked["_a"] >= 0) & (asked["_b"] >= 0)]
        asked = asked[linked[asked["_a"].to_numpy()]].sort_values(["_a", "od_id"])
        for begin in range(0, len(asked), LANES):
            lot = asked.iloc[begin : begin + LANES]
            ups = [g.climb(a, False) for a in lot["_a"].tolist()]
            limit = np.array([_least(g, a, up, a == b, b) for a, b, up in zip(lot["_a"].tolist(), lot["_b"].tolist(), ups)])
            got = limit >= 0
            lot = lot[got]
            if len(lot):
                found = _passed(g, [u for u, ok in zip(ups, got) if ok], limit[got].astype(g.far.dtype), lot["vertex_id"].to_numpy(), counted)
                yield pd.DataFrame({"od_id": lot["od_id"], "source": lot["source"], "vertex_id": lot["vertex_id"], "n": found - (0 if path is None else counted[lot["_a"]] * (lot["_a"] != lot["_b"]))})

    asked = od.select("od_id", F.col("source").cast("long").alias("source"), F.col("vertex_id").cast("long").alias("vertex_id")).filter("source is not null and vertex_id is not null")
    return asked.repartitionByRange(6 * od.sparkSession.sparkContext.defaultParallelism, "source").mapInPandas(search, "od_id long, source long, vertex_id long, n long")


def _passed(g: Fronts, ups: list[tuple], limit: np.ndarray, ends: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Sum of ``counted`` over the vertices before (limit, end) in order, for each climb."""
    lanes = len(ups)
    inner: dict[int, list[tuple[int, np.ndarray]]] = {}
    for lane, (nodes, dist) in enumerate(ups):
        at = 0
        for k in nodes:
            own = int(g.lo[k + 1] - g.lo[k])
            inner.setdefault(k, []).append((lane, dist[at : at + own]))
            at += own
    total = np.zeros(lanes, np.int64)
    chain: list[int] = []
    starts: list[int] = [0]
    room = np.empty((0, lanes), g.far.dtype)  # distances of the vertices that the chain's nodes own, one node after the other
    lo, parent = g.lo, g.parent.tolist()
    for k in range(len(parent)):
        while chain and chain[-1] != parent[k]:
            chain.pop()
            starts.pop()
        a, b, begin = int(lo[k]), int(lo[k + 1]), starts[-1]
        own, rim = b - a, g.border(k)
        if begin + own > len(room):
            room = np.concatenate([room, np.empty((begin + own, lanes), room.dtype)])
        d = room[begin : begin + own]
        d[:] = g.far
        if own and len(rim):
            level = np.searchsorted(lo[chain], rim, side="right") - 1
            outer = room[np.array(starts[:-1])[level] + rim - lo[chain][level]]
            block = g.block(k, True)[:, own:]
            step = max(1, (STRIP << 1) // outer.size)
            for r in range(0, own, step):
                (block[r : r + step, :, None] + outer).min(axis=1, out=d[r : r + step])
        for lane, dist in inner.get(k, ()):
            np.minimum(d[:, lane], dist, out=d[:, lane])
        n = counted[a:b]
        if len(some := np.flatnonzero(n)):
            at = d if len(some) == own else d[some]
            earlier = at < limit
            if (level := at == limit).any():
                earlier |= level & (g.ids[a:b][some][:, None] < ends)
            total += n[some] @ earlier if n.max() > 1 else np.count_nonzero(earlier, axis=0)
        chain.append(k)
        starts.append(begin + own)
    return total


def buckets(sent: Shared, pois: DataFrame, k: int) -> DataFrame:
    """(hub, turn, poi_vertex, dist): by the hub's place, its first ``k`` of ``pois`` (vertex_id) in the order (dist, poi_vertex), turn from 0.

    Later points have k better ones over the same hub. A point climbs until every border vertex has k better ones, which no way beyond can
    undo: tasks take theirs in the order of ids.
    """

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        dist, poi = np.full((len(g.ids), k), g.far), np.full((len(g.ids), k), -1, np.int64)
        for frame in frames:
            ids = frame["vertex_id"].to_numpy()
            for vertex, at in zip(ids.tolist(), g.places(ids).tolist()):
                for node, own, rim in g.steps(at, True) if at >= 0 else ():
                    a, b = int(g.lo[node]), int(g.lo[node + 1])
                    if len(some := a + np.flatnonzero(own < dist[a:b, -1])):
                        d, p, moved = own[some - a], np.full(len(some), vertex), np.zeros(len(some), bool)
                        for turn in range(k):  # it comes after those of equal distance and moves the rest on
                            old, was = dist[some, turn], poi[some, turn]
                            moved |= d < old
                            dist[some, turn], poi[some, turn] = np.where(moved, d, old), np.where(moved, p, was)
                            d, p = np.where(moved, old, d), np.where(moved, was, p)
                    if (dist[g.border(node), -1] <= rim).all():
                        break
        for a in range(0, len(dist), ROWS):
            hub, turn = np.nonzero(dist[a : a + ROWS] < g.far)
            yield pd.DataFrame({"hub": a + hub, "poi_vertex": poi[a + hub, turn], "dist": dist[a + hub, turn]})

    points = pois.select(F.col("vertex_id").cast("long").alias("vertex_id")).filter("vertex_id is not null").distinct()
    dealt = points.repartitionByRange(2 * pois.sparkSession.sparkContext.defaultParallelism, "vertex_id").sortWithinPartitions("vertex_id")
    met = dealt.mapInPandas(fill, "hub long, poi_vertex long, dist long")
    first = Window.partitionBy("hub").orderBy("dist", "poi_vertex")
    return met.withColumn("turn", F.row_number().over(first) - 1).filter(F.col("turn") < k).select("hub", "turn", "poi_vertex", "dist")


def closest(sent: Shared, sources: DataFrame, pois: DataFrame, k: int) -> DataFrame:
    """(source, poi_vertex, distance, rank) of the k nearest vertices of ``pois`` (vertex_id); ties to the least vertex.

    Each source climbs and scans the buckets of its hubs, until its k-th point is nearer than all of the border.
    """
    path = fresh_path(sources.sparkSession)
    buckets(sent, pois, k).write.parquet(path)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        dist, poi = np.full((len(g.ids), k), g.far), np.full((len(g.ids), k), -1, np.int64)
        hub, turn, p, d = read_columns(path, ["hub", "turn", "poi_vertex", "dist"])
        dist[hub, turn], poi[hub, turn] = d, p
        del hub, turn, p, d
        for frame in frames:
            ids, rows = frame["source"].to_numpy(), []
            for source, at in zip(ids.tolist(), g.places(ids).tolist()):
                best, points, last = np.zeros(0, g.far.dtype), np.zeros(0, np.int64), g.far
                for node, own, rim in g.steps(at, False) if at >= 0 else ():
                    a = int(g.lo[node])
                    some = np.flatnonzero(own <= last)
                    sums = own[some, None] + dist[a + some]
                    here = (sums <= last) & (sums < g.far)
                    best, points = np.r_[best, sums[here]], np.r_[points, poi[a + some][here]]
                    order = np.lexsort((points, best))
                    order = order[np.sort(np.unique(points[order], return_index=True)[1])[:k]]
                    best, points = best[order], points[order]
                    last = best[-1] if len(best) == k else g.far
                    if (least := rim.min(initial=g.far)) > last or least >= g.far:
                        break
                rows += [(source, v, e, r + 1) for r, (v, e) in enumerate(zip(points.tolist(), best.tolist()))]
            yield pd.DataFrame(rows, columns=["source", "poi_vertex", "distance", "rank"])

    asked = sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct()
    return _spread(asked, "source").mapInPandas(search, "source long, poi_vertex long, distance long, rank int")
