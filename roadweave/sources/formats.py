"""Readers of the file formats of road networks, trips and populations, as DataFrames.

Every reader declares its schema, leaves filtering to plain predicates, and reads through
Spark, so any path that Spark can open will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions.geometry import haversine
from roadweave.operators.graph import compact_ids

# Speeds (km/h) and lanes by road category 1 to 12 and 15; 13 is a ferry, 14 is unused.
XATF_SPEED = {1: 130, 2: 120, 3: 110, 4: 100, 5: 90, 6: 80, 7: 70, 8: 60, 9: 50, 10: 40, 11: 30, 12: 20, 15: 10}
XATF_LANES = {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 13: -1, 14: -1, 15: 1}
XATF_FERRY = 13
#: Fixed value: the travel time of an edge that cannot be driven.
NEVER = (2**31 - 1) // 2

# Speed (km/h), lanes a direction, vehicles an hour and lane, direction, by OSM highway class.
OSM_DEFAULTS = {
    "motorway": (120, 2, 2000, "forward"), "motorway_link": (80, 1, 1500, "forward"), "trunk": (80, 1, 2000, "both"), "trunk_link": (50, 1, 1500, "both"),
    "primary": (80, 1, 1500, "both"), "primary_link": (60, 1, 1500, "both"), "secondary": (30, 1, 800, "both"), "secondary_link": (30, 1, 800, "both"),
    "tertiary": (25, 1, 600, "both"), "tertiary_link": (25, 1, 600, "both"), "unclassified": (15, 1, 600, "both"), "residential": (15, 1, 600, "both"), "living_street": (10, 1, 300, "both"),
}
MILE = 1.609344


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), key)


def travel_time(length: Column, speed: Column) -> Column:
    """Tenths of a second for metres at km/h, null at speed 0."""
    return F.when(speed > 0, F.round(36 * length / speed)).cast("int")


def two_second_capacity(lanes: Column, speed: Column) -> Column:
    """Vehicles an hour if each keeps two seconds from the one before."""
    return F.round(9000 * lanes * speed / (5 * speed + 45)).cast("int")


def numbered_lines(spark: SparkSession, path: str, kept: Column | None = None) -> DataFrame:
    """(line, value) of the lines that ``kept`` admits, numbered from 0 in the order of files and lines.

    Lines are counted in each split that Spark reads, so a file of any size is numbered by
    many tasks; only the table of splits is summed in one place.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    read = read.filter(F.lit(True) if kept is None else kept)
    sizes = read.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_file").alias("_f"), F.col("_split").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file", "_split").orderBy("_at")
    numbered = read.withColumn("_k", F.row_number().over(inside)).join(starts, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    return numbered.select((F.col("_start") + F.col("_k") - 1).cast("long").alias("line"), "value")


def _fields(lines: DataFrame, separator: str, **at: int) -> DataFrame:
    """line and the named integer fields of each line."""
    f = F.split("value", separator)
    return lines.select("line", *(F.get(f, k).cast("long").alias(name) for name, k in at.items()))


def xatf_attributes(edges: DataFrame) -> DataFrame:
    """Adds speed, lanes, capacity and travel time to (length, category); a ferry takes a minute for a unit of length and has no speed and no capacity."""
    speed, lanes = _lookup(F.col("category").cast("int"), XATF_SPEED), _lookup(F.col("category").cast("int"), XATF_LANES)
    ferry = F.col("category") == XATF_FERRY
    e = edges.withColumns({"free_flow_speed": speed, "num_lanes": lanes})
    return e.withColumns(
        {
            "capacity": F.when(ferry, 0).otherwise(two_second_capacity(F.col("num_lanes"), F.col("free_flow_speed"))),
            "travel_time": F.when(ferry, 600 * F.col("length")).otherwise(travel_time(F.col("length"), F.col("free_flow_speed"))).cast("int"),
        }
    )


def read_xatf(spark: SparkSession, vertex_path: str, edge_path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of comma files of 5 and 10 fields; directions 1 and 2 are one-way, 0 and 3 go both ways.

    Vertices get dense ids in the order of their lines; edges come by tail, then line, a way
    back after the way there. A ferry's length is the distance between its ends; its travel
    time stays that of the length in the file.
    """
    v = _fields(numbered_lines(spark, vertex_path), ",", orig_id=0, lng5=3, lat5=4)
    vertices = v.select(F.col("line").alias("vertex_id"), "orig_id", (F.col("lat5") * 10).cast("int").alias("lat"), (F.col("lng5") * 10).cast("int").alias("lng"))
    raw = _fields(numbered_lines(spark, edge_path), ",", tail=1, head=2, length=4, direction=6, category=9)
    there = F.struct(F.col("tail").alias("a"), F.col("head").alias("b"), F.lit(0).alias("back"))
    back = lambda k: F.struct(F.col("head").alias("a"), F.col("tail").alias("b"), F.lit(k).alias("back"))
    ways = F.when(F.col("direction") == 1, F.array(there)).when(F.col("direction") == 2, F.array(back(0))).otherwise(F.array(there, back(1)))
    rows = raw.select("line", "length", "category", F.explode(ways).alias("w")).select("line", "length", "category", "w.*")
    at = lambda end, name: vertices.select(F.col("orig_id").alias(end), F.col("vertex_id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lng").alias(f"{name}_lng"))
    placed = xatf_attributes(rows.withColumn("length", F.col("length").cast("int"))).join(at("a", "tail"), "a").join(at("b", "head"), "b")
    across = F.round(haversine(*(F.col(c) for c in ("tail_lat", "tail_lng", "head_lat", "head_lng")))).cast("int")
    measured = placed.withColumn("length", F.when(F.col("category") == XATF_FERRY, across).otherwise(F.col("length")))
    edges = compact_ids(measured.drop("a", "b", "tail_lat", "tail_lng", "head_lat", "head_lng"), ["tail", "line", "back"], "edge_id")
    return vertices, edges.select("edge_id", "tail", "head", "length", "category", "free_flow_speed", "num_lanes", "capacity", "travel_time")


def read_dimacs(
    spark: SparkSession, distances: str | None, times: str | None, places: str | None = None, distance_precision: int = 1, time_precision: int = 1, coordinate_precision: int = 1_000_000
) -> tuple[DataFrame | None, DataFrame]:
    """Vertices (if given) and edges from 1-based arc files; either of distance and time may be missing.

    The k-th arc of one file is the k-th of the other. Files give distances in parts of a
    metre, times in parts of a second and coordinates in parts of a degree, by their
    precisions; lengths are metres, travel times tenths of a second, places micro-degrees.
    """

    def arcs(path: str, name: str, scale: float) -> DataFrame:
        lines = _fields(numbered_lines(spark, path, F.col("value").startswith("a ")), " +", t=1, h=2, w=3)
        return lines.select("line", "t", "h", F.round(F.lit(scale) * F.col("w")).cast("int").alias(name))

    tables = [arcs(p, n, x) for p, n, x in ((distances, "length", 1 / distance_precision), (times, "travel_time", 10 / time_precision)) if p]
    both = tables[0] if len(tables) == 1 else tables[0].join(tables[1].drop("t", "h"), "line")
    edges = compact_ids(both.withColumns({"tail": F.col("t") - 1, "head": F.col("h") - 1}).drop("t", "h"), ["tail", "line"], "edge_id").drop("line")
    if not places:
        return None, edges
    points = _fields(numbered_lines(spark, places, F.col("value").startswith("v ")), " +", id=1, lng=2, lat=3)
    micro = lambda c: F.round(F.lit(1e6 / coordinate_precision) * F.col(c)).cast("int").alias(c)
    return points.select((F.col("id") - 1).alias("vertex_id"), micro("lat"), micro("lng")), edges


def read_matsim(spark: SparkSession, path: str, modes: list[str], capacity_hours: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a network XML that carry one of ``modes``; times are whole seconds, one added, in tenths.

    A link of speed 0 is never passed. ``capacity_hours`` is the period that capacities count for.
    """
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").load(path).filter("_x is not null")
    links = spark.read.format("xml").option("rowTag", "link").schema("_id string, _from string, _to string, _length double, _freespeed double, _capacity double, _permlanes double, _modes string").load(path)
    kept = links.filter(F.arrays_overlap(F.split("_modes", ","), F.array(*map(F.lit, modes))))
    speed = F.round(F.col("_freespeed") * 3.6)
    edges = kept.select(
        F.col("_id").alias("link_id"), F.col("_from").alias("tail"), F.col("_to").alias("head"), F.round("_length").cast("int").alias("length"), speed.cast("int").alias("free_flow_speed"),
        F.round(F.col("_capacity") / capacity_hours).cast("int").alias("capacity"), F.col("_permlanes").alias("num_lanes"),
        F.when(speed != 0, F.floor(3.6 * F.col("_length") / speed) * 10 + 10).otherwise(NEVER).cast("int").alias("travel_time"),
    )
    return nodes.select(F.col("_id").alias("vertex_id"), F.col("_x").alias("x"), F.col("_y").alias("y")), edges


def osm_way_attributes(ways: DataFrame) -> DataFrame:
    """Direction, speed, lanes and capacities of ways (way_id, tags MAP<STRING,STRING>) open to cars.

    Classes that are not listed are dropped. Speeds of ``mph`` are converted, and stay unrounded; of a two-way
    road ``lanes`` is halved, lanes:forward and lanes:backward override it if positive.
    """
    tag = lambda k: F.lower(F.trim(F.try_element_at("tags", F.lit(k))))
    known = ways.withColumn("highway", tag("highway")).filter(F.col("highway").isin(*OSM_DEFAULTS))
    default = lambda i: _lookup(F.col("highway"), {k: v[i] for k, v in OSM_DEFAULTS.items()})
    oneway = tag("oneway")
    direction = (
        F.when(oneway.isin("no", "false", "0"), "both").when(oneway.isin("yes", "true", "1"), "forward").when(oneway.isin("-1", "reverse"), "reverse")
        .when(tag("junction") == "roundabout", "forward").otherwise(default(3))
    )
    number = F.regexp_extract(tag("maxspeed"), r"^(\d+(\.\d+)?)", 1).try_cast("double")
    limit = F.when(tag("maxspeed").endswith("mph"), number * MILE).otherwise(number)
    half = lambda c: F.when(F.col("direction") == "both", c / 2).otherwise(c)
    count = lambda k: tag(k).try_cast("double")
    lanes = lambda k: F.when(count(k) > 0, count(k)).otherwise(F.when(count("lanes") > 0, half(count("lanes"))).otherwise(default(1).cast("double")))
    return known.withColumns({"direction": direction, "speed_limit": F.coalesce(limit, default(0).cast("double")), "signed": limit.isNotNull()}).withColumns({"lanes_forward": lanes("lanes:forward"), "lanes_backward": lanes("lanes:backward"), "lane_capacity": default(2)})


#: Order of the classes between which short unsigned roads are slowed; fixed values.
OSM_SHORT = ("trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")


def osm_segment_attributes(segments: DataFrame) -> DataFrame:
    """Capacity, free-flow speed and travel time of segments (highway, length, lanes, lane_capacity, speed_limit, signed).

    Segments under 100 m have twice the capacity; limits under 51 are driven at half; unsigned
    trunk to tertiary_link segments under 300 m are slowed in proportion to their length.
    """
    v, n = F.col("speed_limit"), F.col("length")
    slowed = ~F.col("signed") & F.col("highway").isin(*OSM_SHORT) & (n < 300)
    speed = F.when(slowed, F.round((v - 10) / 300 * n + 10)).when(F.col("signed") & (v < 51), F.round(v / 2)).otherwise(F.round(v)).cast("int")
    capacity = F.round(F.col("lanes") * F.col("lane_capacity") * F.when(n < 100, 2).otherwise(1)).cast("int")
    timed = F.coalesce(travel_time(n, F.col("free_flow_speed")), F.lit(NEVER))
    return segments.withColumns({"capacity": capacity, "free_flow_speed": speed}).withColumn("travel_time", timed)


def _unit(c: str) -> Column:
    return F.regexp_extract(F.col(c), r"([\d.]+)", 1).try_cast("double")


def read_visum(spark: SparkSession, folder: str, system: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and open links of semicolon files KNOTEN, STRECKE, STRECKENTYP; speed is the lesser of link and type."""
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", sep=";", header=True)
    nodes = read("KNOTEN").select(F.col("NR").cast("long").alias("vertex_id"), F.col("XKOORD").cast("double").alias("x"), F.col("YKOORD").cast("double").alias("y"))
    types = read("STRECKENTYP").select(F.col("NR").alias("TYPNR"), _unit(f"VMAX-IVSYS({system})").alias("type_speed"))
    links = read("STRECKE").filter(F.array_contains(F.split("VSYSSET", ","), system)).join(F.broadcast(types), "TYPNR")  # a handful of types
    e = links.select(
        F.col("VONKNOTNR").cast("long").alias("tail"), F.col("NACHKNOTNR").cast("long").alias("head"), F.round(_unit("LAENGE") * 1000).cast("int").alias("length"),
        F.col("ANZFAHRSTREIFEN").cast("int").alias("num_lanes"), F.col("KAPIV").cast("int").alias("capacity"), F.round(F.least(_unit("V0IV"), "type_speed")).cast("int").alias("free_flow_speed"),
    ).filter("capacity > 0 and free_flow_speed > 0")
    return nodes, compact_ids(e.withColumn("travel_time", travel_time(F.col("length"), F.col("free_flow_speed"))), ["tail", "head", "length"], "edge_id")


def attach_polylines(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with road_geometry from points (tail, head, index, lat, lng); the opposite direction gets it reversed."""
    lines = points.groupBy("tail", "head").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("line"))
    back = lines.select(F.col("tail").alias("head"), F.col("head").alias("tail"), F.reverse("line").alias("back"))
    empty = F.array().cast("array<struct<lat:int,lng:int>>")
    return edges.join(lines, ["tail", "head"], "left").join(back, ["tail", "head"], "left").withColumn("road_geometry", F.coalesce("line", "back", empty)).drop("line", "back")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, line, text) of one file of ``$NAME:columns`` sections; lines from ``*`` on are comments.

    One file is one row here, so its sections keep their order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).filter(~F.col("text").startswith("*") & (F.trim("text") != ""))
    last = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # lines of one file
    return lines.withColumn("section", F.last(F.when(F.col("text").startswith("$"), F.regexp_extract("text", r"^\$([^:]*)", 1)), ignorenulls=True).over(last)).select("section", "line", "text")


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """Faces (area_id, face_idx, ring) of a POLY file: sections end with END, ``!`` marks holes.

    Rings are turned counter-clockwise, holes clockwise; the closing point is dropped.
    """
    from roadweave.functions.geometry import orientation

    text = spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("area_id"), F.regexp_extract_all("value", F.lit(r"(?m)^(!?\S+)\s*\r?\n((?:\s+\S+\s+\S+\s*\r?\n)+)END"), F.lit(0)).alias("s"))
    faces = text.select("area_id", F.posexplode("s").alias("face_idx", "body"))
    numbers = F.filter(F.split("body", r"\r?\n"), lambda l: l.rlike(r"^\s+\S+\s+\S+\s*$"))
    point = lambda l, k: F.round(F.regexp_extract(l, r"^\s+(\S+)\s+(\S+)", k + 1).cast("double") * 1e6).cast("int")
    ring = faces.select("area_id", "face_idx", F.col("body").startswith("!").alias("hole"), F.transform(numbers, lambda l: F.struct(point(l, 0).alias("x"), point(l, 1).alias("y"))).alias("ring"))
    closed = F.get("ring", 0) == F.element_at("ring", -1)
    opened = ring.withColumn("ring", F.when((F.size("ring") > 1) & closed, F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring")))
    wanted = F.when(F.col("hole"), -1).otherwise(1)
    return opened.withColumn("ring", F.when(orientation(F.col("ring")) == wanted, F.col("ring")).otherwise(F.reverse("ring"))).select("area_id", "face_idx", "ring")


def poly_text(faces: list[tuple[bool, list[tuple[int, int]]]], name: str = "area") -> str:
    """A POLY file of (hole, ring in micro-degrees) faces."""
    out = [name]
    for k, (hole, ring) in enumerate(faces, 1):
        out += [f"{'!' if hole else ''}{k}", *(f"\t{x / 1e6:.6f}\t{y / 1e6:.6f}" for x, y in [*ring, ring[0]]), "END"]
    return "\n".join([*out, "END", ""])


def read_od(spark: SparkSession, path: str) -> DataFrame:
    """Trips of a CSV with header and # comments; zone columns that are missing are null, others are ignored."""
    raw = spark.read.csv(path, header=True, comment="#")
    names = ("origin", "destination", "origin_zone", "destination_zone")
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).cast("long").alias(c) for c in names))


def read_population(spark: SparkSession, path: str, metres: int) -> DataFrame:
    """(cell_x, cell_y, population) of a grid CSV: 100 m (``;``, Gitter_ID_100m) or 1 km (``,``, GRD_ID); unknown cells go."""
    code, count, sep = ("Gitter_ID_100m", "Einwohner", ";") if metres == 100 else ("GRD_ID", "TOT_P", ",")
    raw = spark.read.csv(path, header=True, sep=sep).select(F.col(code).alias("code"), F.col(count).cast("long").alias("n")).filter("n > 0")
    cell = lambda letter: F.regexp_extract("code", rf"{letter}(\d+)", 1).cast("int")
    return raw.groupBy(cell("E").alias("cell_x"), cell("N").alias("cell_y")).agg(F.sum("n").alias("population"))


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(*(F.round(F.col(c).cast("double") * 1e6).cast("int").alias(n) for c, n in (("latitude", "lat"), ("longitude", "lng"))))


def read_mobitopp(spark: SparkSession, path: str) -> DataFrame:
    """Trips of a 12-column semicolon file without header; departure in seconds since Monday midnight, zones without their Z."""
    from roadweave.functions.scalars import seconds_of_day, weekday

    names = "household_id agent_id day_of_week departure_time arrival_time travel_time origin_zone destination_zone length mode purpose duration".split()
    raw = spark.read.csv(path, sep=";", schema=", ".join(f"{n} string" for n in names))
    zone = lambda c: F.regexp_extract(c, r"^Z?(\d+)$", 1).try_cast("long").alias(c)
    return raw.select("household_id", "agent_id", (weekday(F.col("day_of_week")) * 86400 + seconds_of_day(F.col("departure_time"))).alias("departure"), zone("origin_zone"), zone("destination_zone"), "mode")


def read_matrix(spark: SparkSession, path: str, skipped: int = 8) -> DataFrame:
    """(origin_zone, destination_zone, flow) of a matrix file after its header lines; comments go."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).filter((F.col("k") >= skipped) & F.col("line").rlike(r"^\s*\d"))
    f = F.split(F.trim("line"), r"\s+")
    return lines.select(*(F.get(f, k).cast(t).alias(n) for k, (n, t) in enumerate((("origin_zone", "long"), ("destination_zone", "long"), ("flow", "double")))))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows of one CSV (iteration, vol, sat): the order of lines in an iteration is the edge id."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).filter(F.col("line").rlike(r"^\s*\d"))
    f = F.split("line", ",")
    rows = raw.select("k", F.get(f, 0).cast("int").alias("iteration"), F.get(f, 1).cast("double").alias("vol"), F.get(f, 2).cast("double").alias("sat"))
    return rows.withColumn("edge_id", (F.row_number().over(Window.partitionBy("iteration").orderBy("k")) - 1).cast("long")).drop("k")


def write_flows(flows: DataFrame, path: str) -> None:
    """Flows (iteration, edge_id, vol, sat) as Parquet by iteration."""
    flows.write.mode("overwrite").partitionBy("iteration").parquet(path)


def write_network(vertices: DataFrame, edges: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Both tables as Parquet, edges projected to ``columns`` and laid out by tail."""
    from roadweave.operators.graph import sort_edges

    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    sort_edges(edges).select(*(columns or edges.columns)).write.mode("overwrite").parquet(f"{path}/edges")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_rows(rows: DataFrame, path: str) -> None:
    """Any result table as CSV with a header: distances by iteration, assignment statistics, trips, timed queries, point-index statistics."""
    rows.write.mode("overwrite").csv(path, header=True)


def with_original_ids(od: DataFrame, vertices: DataFrame, ends: tuple[str, ...] = ("origin", "destination")) -> DataFrame:
    """Trips with their ends in the ids of the source data; ``vertices`` has vertex_id and orig_id."""
    for end in ends:
        at = vertices.select(F.col("vertex_id").alias("_v"), F.col("orig_id").alias("_orig"))
        od = od.join(at, F.col(end) == F.col("_v")).withColumn(end, F.col("_orig")).drop("_v", "_orig")
    return od
