"""Spatial joins by grid cells: nearest neighbours, matching, containment, rings of cells."""

from __future__ import annotations

from collections.abc import Callable
from math import pi, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.geometry import EARTH_RADIUS, arc_distance, haversine, orientation, ring_contains, squared_distance
from roadweave.operators.shared import large, stored


def _cells(x: Column, y: Column, size: int) -> list[Column]:
    return [F.floor(x / size).cast("long"), F.floor(y / size).cast("long")]


def _prove_by_rings(queries: DataFrame, place: Callable[[int], DataFrame], measure: Callable[[DataFrame], DataFrame], proof: Callable[[int], Column], cell: int, most_rings: int) -> DataFrame:
    """The best target (least d, then target_id) of each query (query_id, x, y).

    ``place(cell)`` gives the targets with the cells (cx, cy) they touch, ``measure`` adds d to
    met pairs, ``proof(reach)`` is what d may be at most if all targets nearer than a square of
    that reach were met. The square doubles up to ``most_rings`` cells; then the cells grow and
    it starts again, so a query never meets more than (2 * most_rings + 1)^2 cells.
    """
    open_, answers, reach, placed = queries, [], 1, place(cell)
    best = Window.partitionBy("query_id").orderBy("d", "target_id")
    while True:
        span = F.sequence(F.lit(-reach), F.lit(reach))
        qx, qy = _cells(F.col("x"), F.col("y"), cell)
        around = open_.withColumns({"_qx": qx, "_qy": qy}).withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
        met = around.withColumns({"cx": F.col("_qx") + F.col("dx"), "cy": F.col("_qy") + F.col("dy")}).join(large(placed), ["cx", "cy"])
        found = measure(met).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
        proven = stored(found.filter(F.col("d") <= proof(reach * cell)).select("query_id", "target_id", "d"))
        answers.append(proven)
        open_ = stored(open_.join(large(proven.select("query_id")), "query_id", "left_anti"))
        if not open_.limit(1).count():
            break
        reach *= 2
        if reach > most_rings:
            cell, reach = cell * 2 * most_rings, 1
            placed = place(cell)
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def nearest(queries: DataFrame, points: DataFrame, cell: int, most_rings: int = 2) -> DataFrame:
    """(query_id, point_id, d2): the planar nearest point of each query; ties go to the least id.

    queries: query_id, x, y; points: point_id, x, y. Queries meet the points of the cells around
    them; the square of cells grows until the answer is proven, that is, nearer than the
    square's edge. Rows without coordinates are left out; without points nothing is found.
    """
    points = points.filter("x is not null and y is not null").select(F.col("point_id").alias("target_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    sought = queries.filter("x is not null and y is not null").select("query_id", "x", "y")
    if not points.limit(1).count():
        sought = sought.limit(0)
    place = lambda c: points.withColumns(dict(zip(("cx", "cy"), _cells(F.col("px"), F.col("py"), c))))
    measure = lambda met: met.withColumn("d", squared_distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    # The square reaches at least `reach` whole cells beyond the query's own cell.
    found = _prove_by_rings(sought, place, measure, lambda width: F.lit(min(width**2, 2**63 - 1)), cell, most_rings)
    return found.select("query_id", F.col("target_id").alias("point_id"), F.col("d").alias("d2"))


def nearest_segments(queries: DataFrame, segments: DataFrame, metres: float, cell: int = 2000, most_rings: int = 2) -> DataFrame:
    """(query_id, edge_id, metres, vertex_id): the segment nearest to each query on the sphere, if within ``metres``.

    queries: query_id, x, y (longitude and latitude in microdegrees); segments: edge_id, tail,
    head, x1, y1, x2, y2, great-circle arcs that cross neither pole nor antimeridian. Ties go to
    the least edge_id. ``vertex_id`` is the end that represents the query: the tail if it is
    nearer and an edge from head to tail exists, else the head. Segments are dealt to
    the cells along them, with a margin for the bend of an arc. Rows without coordinates are
    left out; without segments nothing is found.
    """
    drawn = segments.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    sought = queries.filter("x is not null and y is not null").select("query_id", "x", "y")
    if not drawn.limit(1).count():
        sought = sought.limit(0)
    x1, y1, x2, y2 = (F.col(k).cast("double") for k in ("x1", "y1", "x2", "y2"))
    bend = F.ceil(F.pow(F.radians((x2 - x1) / 1e6), 2) / 8 * (180e6 / pi)) + 1  # an arc leaves the straight line by less

    def place(size: int) -> DataFrame:
        along = drawn.withColumn("cx", F.explode(F.sequence(F.floor(F.least(x1, x2) / size).cast("long"), F.floor(F.greatest(x1, x2) / size).cast("long"))))
        at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (F.least(F.greatest(x, F.least(x1, x2)), F.greatest(x1, x2)) - x1) * F.try_divide(y2 - y1, x2 - x1))
        left, right = at(F.col("cx") * F.lit(float(size))), F.when(x1 == x2, y2).otherwise(at((F.col("cx") + 1) * F.lit(float(size))))
        rows = F.sequence(F.floor((F.least(left, right) - bend) / size).cast("long"), F.floor((F.greatest(left, right) + bend) / size).cast("long"))
        return along.withColumn("cy", F.explode(rows)).select(F.col("edge_id").alias("target_id"), "x1", "y1", "x2", "y2", "cx", "cy")

    def measure(met: DataFrame) -> DataFrame:
        return met.withColumn("d", arc_distance(F.col("y"), F.col("x"), F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))

    def proof(width: int) -> Column:
        if width >= 360_000_000:  # all segments were met
            return F.lit(float("inf"))
        # The square's sides: a parallel `width` away, and a meridian, which is nearer at higher latitudes.
        return F.least(F.lit(radians(width / 1e6)), F.asin(F.cos(F.radians(F.col("y") / 1e6)) * F.lit(sin(min(radians(width / 1e6), pi / 2))))) * EARTH_RADIUS

    found = _prove_by_rings(sought, place, measure, proof, cell, most_rings)
    near = found.filter(F.col("d") <= metres).join(large(sought), "query_id").join(large(drawn.withColumnRenamed("edge_id", "target_id")), "target_id")
    back = segments.select(F.col("head").alias("tail"), F.col("tail").alias("head")).distinct().withColumn("_back", F.lit(True))
    x, y = F.col("x"), F.col("y")
    nearer = haversine(y, x, F.col("y1"), F.col("x1")) < haversine(y, x, F.col("y2"), F.col("x2"))
    return near.join(large(back), ["tail", "head"], "left").select(
        "query_id", F.col("target_id").alias("edge_id"), F.col("d").alias("metres"), F.when(nearer & F.col("_back").isNotNull(), F.col("tail")).otherwise(F.col("head")).alias("vertex_id")
    )


def pois_to_vertices(pois: DataFrame, vertices: DataFrame, metres: float, cell: int = 2000) -> DataFrame:
    """(poi_id, vertex_id): planar nearest vertex of each point (poi_id, lat, lng), kept if within ``metres`` on the sphere."""
    near = nearest(pois.select(F.col("poi_id").alias("query_id"), F.col("lng").alias("x"), F.col("lat").alias("y")), vertices.select(F.col("vertex_id").alias("point_id"), F.col("lng").alias("x"), F.col("lat").alias("y")), cell)
    at = vertices.select(F.col("vertex_id").alias("point_id"), F.col("lat").alias("vlat"), F.col("lng").alias("vlng"))
    both = near.join(pois.select(F.col("poi_id").alias("query_id"), "lat", "lng"), "query_id").join(at, "point_id")
    return both.filter(haversine(F.col("lat"), F.col("lng"), F.col("vlat"), F.col("vlng")) <= metres).select(F.col("query_id").alias("poi_id"), F.col("point_id").alias("vertex_id"))


def mutual_matches(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(left_id, right_id) of vertices (id, lat, lng) that are each other's only nearest within ``metres``.

    A tie for the nearest place on either side rejects the vertex.
    """
    step = max(1, int(metres / 111_000 * 1e6 * 3) + 1)  # a cell wider than the radius up to about 70 degrees north
    l = left.select(F.col("id").alias("left_id"), F.col("lat").alias("llat"), F.col("lng").alias("llng"))
    r = right.select(F.col("id").alias("right_id"), F.col("lat").alias("rlat"), F.col("lng").alias("rlng"), *(c.alias(n) for c, n in zip(_cells(F.col("lng"), F.col("lat"), step), ("cx", "cy"))))
    off = F.sequence(F.lit(-1), F.lit(1))
    lx, ly = _cells(F.col("llng"), F.col("llat"), step)
    near = l.withColumn("dx", F.explode(off)).withColumn("dy", F.explode(off)).withColumns({"cx": lx + F.col("dx"), "cy": ly + F.col("dy")}).join(large(r), ["cx", "cy"])
    within = near.filter(haversine(F.col("llat"), F.col("llng"), F.col("rlat"), F.col("rlng")) <= metres).withColumn("d2", squared_distance(F.col("llng"), F.col("llat"), F.col("rlng"), F.col("rlat")))

    def only(side: str, other: str) -> DataFrame:
        rank = within.withColumn("_r", F.rank().over(Window.partitionBy(side).orderBy("d2")))
        return rank.filter("_r = 1").groupBy(side).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(other)).filter("n = 1").drop("n")

    return only("left_id", "right_id").join(large(only("right_id", "left_id")), ["left_id", "right_id"])


def match_edges(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_edge, right_edge) of edges between matched vertices, where each side has one such edge."""
    from roadweave.operators.graph import unique_edges

    m = lambda end: matches.select(F.col("left_id").alias(f"l_{end}"), F.col("right_id").alias(f"r_{end}"))
    l = unique_edges(left).select(F.col("tail").alias("l_tail"), F.col("head").alias("l_head"), F.col("edge_id").alias("left_edge"))
    r = unique_edges(right).select(F.col("tail").alias("r_tail"), F.col("head").alias("r_head"), F.col("edge_id").alias("right_edge"))
    return l.join(m("tail"), "l_tail").join(m("head"), "l_head").join(r, ["r_tail", "r_head"]).select("left_edge", "right_edge")


def points_in_areas(points: DataFrame, faces: DataFrame, cell: int) -> DataFrame:
    """(point_id, area_id) where the last face of the area that contains the point is a filled one.

    points: point_id, x, y; faces: area_id, face_idx, ring of (x, y) structs. A face is filled
    if its ring is counter-clockwise, a hole else. Faces are dealt to the cells of their boxes,
    so points meet only faces near them.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = faces.select("area_id", "face_idx", "ring", orientation(F.col("ring")).alias("o"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long")))
    dealt = boxed.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    px, py = _cells(F.col("x"), F.col("y"), cell)
    met = points.select("point_id", "x", "y", px.alias("cx"), py.alias("cy")).join(dealt, ["cx", "cy"])
    inside = met.filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).filter(ring_contains(F.col("ring"), F.col("x"), F.col("y")))
    last = inside.groupBy("point_id", "area_id").agg(F.max_by("o", "face_idx").alias("o"))
    return last.filter("o > 0").select("point_id", "area_id")


def nearest_ring(queries: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """(query_id, ring, target_id) of all targets in the smallest non-empty Moore ring up to ``most``.

    queries: query_id, cell_x, cell_y; cells: target_id, cell_x, cell_y.
    """
    off = F.sequence(F.lit(-most), F.lit(most))
    around = queries.withColumn("dx", F.explode(off)).withColumn("dy", F.explode(off)).select(
        "query_id", F.greatest(F.abs("dx"), F.abs("dy")).alias("ring"), (F.col("cell_x") + F.col("dx")).alias("cell_x"), (F.col("cell_y") + F.col("dy")).alias("cell_y")
    )
    met = around.join(cells, ["cell_x", "cell_y"])
    least = met.withColumn("_least", F.min("ring").over(Window.partitionBy("query_id")))
    return least.filter("ring = _least").select("query_id", "ring", "target_id")
