"""Plane and sphere geometry as Column expressions; coordinates are integers (micro-degrees or cells)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; fixed value.
EARTH_RADIUS = 6371000.0
HALF_TURN = 180_000_000


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres between points in micro-degrees."""
    rad = lambda c: F.radians(c / F.lit(1e6))
    dlat, dlng = F.radians((lat2 - lat1) / F.lit(1e6)) / 2, F.radians((lng2 - lng1) / F.lit(1e6)) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def arc_distance(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres from a point to the arc between two others, in micro-degrees."""

    def unit(phi: Column, lam: Column) -> tuple[Column, Column, Column]:
        p, l = F.radians(phi / F.lit(1e6)), F.radians(lam / F.lit(1e6))
        return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)

    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    q, a, b = unit(lat, lng), unit(lat1, lng1), unit(lat2, lng2)
    n = cross(a, b)
    size = F.sqrt(dot(n, n))
    beside = (size > 0) & (dot(cross(n, a), q) >= 0) & (dot(cross(b, n), q) >= 0)  # the foot lies on the arc
    ends = F.least(haversine(lat, lng, lat1, lng1), haversine(lat, lng, lat2, lng2))
    return F.when(beside, F.lit(EARTH_RADIUS) * F.asin(F.least(F.abs(F.try_divide(dot(n, q), size)), F.lit(1.0)))).otherwise(ends)


def web_mercator(lat: Column, lng: Column) -> Column:
    """Struct (x, y): micro-degrees from 180 W and from about 85 S."""
    s = F.sin(F.radians(lat / F.lit(1e6)))
    y = F.round(F.lit(2.0 * HALF_TURN) * (F.lit(0.5) + F.log((1 + s) / (1 - s)) / (4 * F.pi())))
    return F.struct((lng + HALF_TURN).cast("long").alias("x"), y.cast("long").alias("y"))


def plate_carree(lat: Column, lng: Column) -> Column:
    """Struct (x, y): micro-degrees from 180 W and 90 S."""
    return F.struct((lng + HALF_TURN).cast("long").alias("x"), (lat + HALF_TURN // 2).cast("long").alias("y"))


def wrap_longitude(lng: Column) -> Column:
    """Longitude in [-180, 180) degrees, in micro-degrees."""
    return F.pmod(lng + HALF_TURN, F.lit(2 * HALF_TURN)) - HALF_TURN


def laea_europe(lat: Column, lng: Column) -> Column:
    """Struct (easting, northing) in metres of ETRS89-LAEA (EPSG:3035) on the GRS80 ellipsoid.

    Lambert azimuthal equal-area, centre 52 N 10 E, false origin 4321000 / 3210000.
    """
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = e2**0.5

    def q_of(s: Column) -> Column:
        return (1 - e2) * (s / (1 - e2 * s * s) - F.lit(1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))

    phi, lam = F.radians(lat / F.lit(1e6)), F.radians(lng / F.lit(1e6)) - F.radians(F.lit(10.0))
    s0 = F.sin(F.radians(F.lit(52.0)))
    qp, q, q0 = q_of(F.lit(1.0)), q_of(F.sin(phi)), q_of(s0)
    rq = F.lit(a) * F.sqrt(qp / 2)
    b, b0 = F.asin(q / qp), F.asin(q0 / qp)
    m0 = F.cos(F.radians(F.lit(52.0))) / F.sqrt(1 - e2 * s0 * s0)
    d = F.lit(a) * m0 / (rq * F.cos(b0))
    k = rq * F.sqrt(2 / (1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(lam)))
    return F.struct(
        (F.lit(4321000.0) + k * d * F.cos(b) * F.sin(lam)).alias("easting"),
        (F.lit(3210000.0) + k / d * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(lam))).alias("northing"),
    )


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 if a, b, c turn left, -1 if right, 0 if they lie on a line."""
    cross = (bx - ax).cast("long") * (cy - ay).cast("long") - (by - ay).cast("long") * (cx - ax).cast("long")
    return F.signum(cross.cast("double")).cast("int")


def segments_meet(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether segments ab and cd share a point; collinear ones are compared by their boxes."""
    o1, o2, o3, o4 = turn(*a, *b, *c), turn(*a, *b, *d), turn(*c, *d, *a), turn(*c, *d, *b)
    spans = lambda p, q, r, s: (F.greatest(p, q) >= F.least(r, s)) & (F.greatest(r, s) >= F.least(p, q))
    boxes = spans(a[0], b[0], c[0], d[0]) & spans(a[1], b[1], c[1], d[1])
    return F.when((o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0), boxes).otherwise((o1 * o2 <= 0) & (o3 * o4 <= 0))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, F.pmod(i + 1, F.size(ring)))


def doubled_area(ring: Column) -> Column:
    """Signed doubled area of a ring of (x, y) structs; positive if counter-clockwise."""
    return F.aggregate(
        F.transform(ring, lambda p, i: p["x"].cast("long") * _next(ring, i)["y"].cast("long") - _next(ring, i)["x"].cast("long") * p["y"].cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )


def orientation(ring: Column) -> Column:
    return F.signum(doubled_area(ring).cast("double")).cast("int")


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting, half-open in y: an edge counts if exactly one end lies above the point."""

    def crosses(p: Column, i: Column) -> Column:
        q = _next(ring, i)
        dy = (q["y"] - p["y"]).cast("long")
        left = (x - p["x"]).cast("long") * dy
        right = (y - p["y"]).cast("long") * (q["x"] - p["x"]).cast("long")
        return ((p["y"] > y) != (q["y"] > y)) & F.when(dy > 0, left < right).otherwise(left > right)

    hits = F.aggregate(F.transform(ring, lambda p, i: crosses(p, i).cast("int")), F.lit(0), lambda total, n: total + n)
    return hits % 2 == 1


def manhattan(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by)


def chebyshev(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = (ax - bx).cast("long"), (ay - by).cast("long")
    return dx * dx + dy * dy


def leftmost(ring: Column) -> Column:
    """Place of the leftmost vertex of a ring, the lowest of several."""
    return F.array_min(F.transform(ring, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i"))))["i"]


def rectangle(low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> Column:
    return F.struct(low_x.alias("x0"), low_y.alias("y0"), high_x.alias("x1"), high_y.alias("y1"))


def rectangle_contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"])


def rectangles_meet(a: Column, b: Column) -> Column:
    """Whether two rectangles share a point."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def extended(r: Column, x: Column, y: Column) -> Column:
    """The least rectangle that holds r and a point."""
    return rectangle(F.least(r["x0"], x), F.least(r["y0"], y), F.greatest(r["x1"], x), F.greatest(r["y1"], y))


def inspire_cell(code: Column, kilometre: bool) -> Column:
    """Struct (cell_x, cell_y) of an INSPIRE id: digits of N at 5 (4) and of E at 11 (9), counted from 0."""
    north = F.regexp_extract(code, r"N(\d+)E", 1).cast("int")
    east = F.regexp_extract(code, r"E(\d+)$", 1).cast("int")
    del kilometre  # the letters mark the digits at either resolution
    return F.struct(east.alias("cell_x"), north.alias("cell_y"))
