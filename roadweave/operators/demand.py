"""Travel demand: ranks, opportunities, radiation models, choosers and trip generators.

All chance is drawn from hashes of (seed, row), so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.shared import large


def dijkstra_ranks(distances: DataFrame) -> DataFrame:
    """``distances`` (source, vertex_id, distance) with rank from 0 by (distance, vertex)."""
    return distances.withColumn("rank", (F.row_number().over(Window.partitionBy("source").orderBy("distance", "vertex_id")) - 1).cast("long"))


def intervening(distances: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(source, vertex_id, own, at, between): opportunities at the source, at the vertex, and strictly nearer in order.

    ``opportunities`` has vertex_id and n; the order is (distance, vertex), and the source does
    not count as between.
    """
    o = opportunities.select("vertex_id", F.col("n").cast("long").alias("n"))
    with_n = distances.join(o, "vertex_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    before = Window.partitionBy("source").orderBy("distance", "vertex_id").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    own = F.max(F.when(F.col("vertex_id") == F.col("source"), F.col("n"))).over(every)
    ran = with_n.select("source", "vertex_id", "distance", own.alias("own"), F.col("n").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    between = F.when(F.col("vertex_id") == F.col("source"), 0).otherwise(F.col("_before") - F.col("own"))
    return ran.select("source", "vertex_id", "distance", "own", "at", between.cast("long").alias("between"))


def formula_probabilities(distances: DataFrame, opportunities: DataFrame, selectivity: float) -> DataFrame:
    """(source, vertex_id, probability) of the radiation model with selection, normalised over a finite area.

    One opportunity is added to the source's. Vertices without opportunities and the source
    itself get no row.
    """
    lam = F.lit(float(selectivity))
    total = opportunities.agg((F.sum("n") + 1).cast("double").alias("S"))  # one row
    rows = intervening(distances, opportunities).join(F.broadcast(total))
    s, i, d = (F.col("own") + 1).cast("double"), F.col("between").cast("double"), F.col("at").cast("double")
    share = lambda m: (1 - F.pow(lam, m)) / m
    n, ns, nns = share(s), share(s + i), share(s + i + d)
    norm = 1 / (1 - ((1 - F.pow(lam, F.col("S"))) / (1 - F.pow(lam, s))) * (s / F.col("S")))
    return rows.filter((F.col("vertex_id") != F.col("source")) & (F.col("at") > 0)).select("source", "vertex_id", ((ns - nns) / n * norm).alias("probability"))


def formula_demand(probabilities: DataFrame, population: DataFrame, trips: int, seed: int = 0) -> DataFrame:
    """(origin, destination, trips): binomial outflows by population, then binomial flows by probability."""
    total = population.agg(F.sum("population").cast("double").alias("P"))  # one row
    flows = probabilities.join(population.select(F.col("vertex_id").alias("source"), "population"), "source").filter("population > 0").join(F.broadcast(total))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [
                int(np.random.default_rng([seed, s, v]).binomial(np.random.default_rng([seed, s]).binomial(trips, min(1.0, p / total_p)), min(1.0, q)))
                for s, v, p, total_p, q in zip(f["source"], f["vertex_id"], f["population"], f["P"], f["probability"])
            ]
            yield pd.DataFrame({"origin": f["source"], "destination": f["vertex_id"], "trips": n})

    return flows.mapInPandas(draw, "origin long, destination long, trips long").filter("trips > 0")


def choose_given_skip(distances: DataFrame, opportunities: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip_id, source, destination): first vertex in order at which the opportunities passed exceed ``skip``.

    ``trips`` has trip_id, source and skip. Runs of opportunities form intervals, joined by source.
    """
    rows = dijkstra_ranks(distances).join(opportunities.select("vertex_id", F.col("n").cast("long").alias("n")), "vertex_id").filter("n > 0")
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("hi", F.sum("n").over(upto)).select("source", F.col("vertex_id").alias("destination"), (F.col("hi") - F.col("n")).alias("lo"), "hi")
    return trips.join(runs, "source").filter((F.col("skip") >= F.col("lo")) & (F.col("skip") < F.col("hi"))).select("trip_id", "source", "destination")


def hash_pick(seed: int, n: Column | int, *keys: Column | str) -> Column:
    """A number from 0 to n - 1 drawn by a hash of the keys."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(F.lit(seed), *keys), n.cast("long"))


def uniform_od(spark_range: DataFrame, n_vertices: int, seed: int = 0) -> DataFrame:
    """(od_id, origin, destination) with both ends uniform over dense vertex ids; ``spark_range`` has od_id."""
    return spark_range.select("od_id", hash_pick(seed, n_vertices, F.lit("o"), "od_id").alias("origin"), hash_pick(seed, n_vertices, F.lit("d"), "od_id").alias("destination"))


def od_by_rank(distances: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip_id, source, destination): the vertex with the wanted rank (trip_id, source, rank)."""
    return dijkstra_ranks(distances).join(trips, ["source", "rank"]).select("trip_id", "source", F.col("vertex_id").alias("destination"))


def od_by_distance(distances: DataFrame, least: DataFrame) -> DataFrame:
    """(trip_id, source, destination, distance): first vertex in order at ``least`` (trip_id, source, least) or farther."""
    far = least.join(distances, "source").filter(F.col("distance") >= F.col("least"))
    return far.groupBy("trip_id", "source").agg(F.min(F.struct("distance", "vertex_id")).alias("m")).select("trip_id", "source", F.col("m.vertex_id").alias("destination"), F.col("m.distance").alias("distance"))


def until_length(od: DataFrame, total: int, lot: int = 65536) -> DataFrame:
    """Trips (od_id, distance) in order of od_id while the length before them is under ``total``."""
    rows = od.withColumn("_lot", F.floor(F.col("od_id") / lot))
    sums = rows.groupBy("_lot").agg(F.sum("distance").alias("_s"))
    before = sums.select(F.col("_lot").alias("_l"), F.coalesce(F.sum("_s").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_lot").orderBy("od_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_i", F.coalesce(F.sum("distance").over(inside), F.lit(0))).join(before, F.col("_lot") == F.col("_l")).filter(F.col("_b") + F.col("_i") < total).select("od_id", "distance")


def sample_matrix(flows: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw_id, origin_zone, destination_zone): the cell of a flow matrix in which each draw r falls.

    ``flows`` has origin_zone, destination_zone and flow (integer); ``draws`` draw_id and r from
    0 to the total flow less one. Zones are chosen by total outflow, then destinations by
    prefix sums inside the zone, so that no window sees the whole matrix.
    """
    out = flows.groupBy("origin_zone").agg(F.sum("flow").alias("out"))
    upto = out.withColumn("hi", F.sum("out").over(Window.orderBy("origin_zone"))).select("origin_zone", (F.col("hi") - F.col("out")).alias("lo"), "hi")
    zoned = draws.join(upto, (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("draw_id", "origin_zone", (F.col("r") - F.col("lo")).alias("q"))
    inside = Window.partitionBy("origin_zone").orderBy("destination_zone")
    cells = flows.withColumn("c_hi", F.sum("flow").over(inside)).select("origin_zone", "destination_zone", (F.col("c_hi") - F.col("flow")).alias("c_lo"), "c_hi")
    return zoned.join(cells, "origin_zone").filter((F.col("q") >= F.col("c_lo")) & (F.col("q") < F.col("c_hi"))).select("draw_id", "origin_zone", "destination_zone")


def filter_trips(trips: DataFrame, first: int, last: int, modes: list[str]) -> DataFrame:
    """Trips that depart in [first, last) seconds since Monday midnight, by one of ``modes``, between named zones."""
    return trips.filter((F.col("departure") >= first) & (F.col("departure") < last) & F.col("mode").isin(modes) & F.col("origin_zone").isNotNull() & F.col("destination_zone").isNotNull())


def mean_distance_per_rank(distances: DataFrame, opportunities: DataFrame, population: DataFrame) -> DataFrame:
    """(rank, expected_distance): population-weighted mean distance to the rank-th opportunity from 0 in order."""
    each = distances.join(opportunities.select("vertex_id", "n"), "vertex_id").filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    ranked = each.withColumn("rank", (F.row_number().over(Window.partitionBy("source").orderBy("distance", "vertex_id", "copy")) - 1).cast("long"))
    weighed = ranked.join(population.select(F.col("vertex_id").alias("source"), "population"), "source")
    return weighed.groupBy("rank").agg((F.sum(F.col("population") * F.col("distance")) / F.sum("population")).alias("expected_distance"))


def assign_population(grid: DataFrame, cells: DataFrame, most_ring: int, seed: int = 0) -> DataFrame:
    """(vertex_id, population): each inhabitant of a cell goes to a vertex of the nearest ring that has any.

    grid: cell_x, cell_y, population; cells: target_id (vertex), cell_x, cell_y. Inhabitants k
    of a cell pick by a hash of (seed, cell, k); cells with no vertex within ``most_ring`` rings
    assign nobody.
    """
    from roadweave.operators.spatial import nearest_ring

    named = grid.withColumn("query_id", F.struct("cell_x", "cell_y"))
    found = nearest_ring(named.select("query_id", "cell_x", "cell_y"), cells, most_ring)
    place = Window.partitionBy("query_id").orderBy("target_id")
    numbered = found.withColumn("k", (F.row_number().over(place) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    sizes = numbered.filter("k = 0").select("query_id", "n")
    people = named.join(sizes, "query_id").filter("population > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("population").cast("int"))))
    chosen = people.withColumn("k", hash_pick(seed, F.col("n"), "cell_x", "cell_y", "i")).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("m"))
    return chosen.join(numbered.select("query_id", "k", "target_id"), ["query_id", "k"]).groupBy(F.col("target_id").alias("vertex_id")).agg(F.sum("m").alias("population"))


def octagon(radius: Column) -> tuple[Column, Column]:
    """Half-height and half-side of the octagon in a circle; the factors are fixed values (cos and sin of pi/8)."""
    return F.round(F.lit(0.92387953251128675613) * radius).cast("long"), F.round(F.lit(0.38268343236508977173) * radius).cast("long")


def raster_radiation(grid: DataFrame, most_cells: int) -> DataFrame:
    """(source_x, source_y, x, y, probability) of the classical radiation model on a raster.

    grid: cell_x, cell_y, population. For a source s and a destination d at Euclidean cell
    distance r up to ``most_cells``: p = s d / (S (d + S)), S the people in the octagon of radius
    r around the source, destination not counted. Pairs meet by an equi-join on blocks of
    most_cells cells, so only neighbours within reach meet.
    """
    full = grid.filter("population > 0")
    block = lambda c: F.floor(F.col(c) / most_cells).cast("long")
    off = F.sequence(F.lit(-1), F.lit(1))
    s = full.select(F.col("cell_x").alias("source_x"), F.col("cell_y").alias("source_y"), F.col("population").alias("s")).withColumn("bx", F.explode(F.transform(off, lambda o: block("source_x") + o))).withColumn("by", F.explode(F.transform(off, lambda o: block("source_y") + o)))
    d = full.select(F.col("cell_x").alias("x"), F.col("cell_y").alias("y"), F.col("population").alias("d"), block("cell_x").alias("bx"), block("cell_y").alias("by"))
    pairs = s.join(large(d), ["bx", "by"]).drop("bx", "by")
    dx, dy = F.abs(F.col("x") - F.col("source_x")), F.abs(F.col("y") - F.col("source_y"))
    near = pairs.withColumns({"man": dx + dy, "che": F.greatest(dx, dy), "r2": dx * dx + dy * dy}).filter(F.col("r2") <= most_cells * most_cells)
    at = near.groupBy("source_x", "source_y", "man", "che").agg(F.sum("d").alias("people"))
    rings = near.filter("r2 > 0").select("source_x", "source_y", "r2").distinct()
    h, a = octagon(F.sqrt(F.col("r2").cast("double")))
    inside = rings.withColumns({"h": h, "a": a}).join(large(at), ["source_x", "source_y"]).filter((F.col("man") <= F.col("h") + F.col("a")) & (F.col("che") <= F.col("h")))
    sums = inside.groupBy("source_x", "source_y", "r2", "h", "a").agg(F.sum("people").alias("in_octagon"))
    both = near.filter("r2 > 0").join(large(sums), ["source_x", "source_y", "r2"])
    counted = F.when((F.col("man") <= F.col("h") + F.col("a")) & (F.col("che") <= F.col("h")), F.col("d")).otherwise(0)
    big = (F.col("in_octagon") - counted).cast("double")
    return both.select("source_x", "source_y", "x", "y", (F.col("s") * F.col("d") / (big * (F.col("d") + big))).alias("probability"))


def choose_trips(distances: DataFrame, opportunities: DataFrame, population: DataFrame, n: int, selectivity: float, swap: float = 0.0, seed: int = 0) -> DataFrame:
    """(trip_id, origin, destination) of ``n`` trips by the chooser loop over network distance.

    Per trip: a source in proportion to population; a rank from 1 to N; the fit opportunities
    binomial of rank and 1 - selectivity, drawn again until positive; a geometric number of
    opportunities to skip, drawn again until under N. A trip that would stay at its source is
    drawn again; ends swap with probability ``swap``. Draws come from a generator seeded by
    (seed, trip, attempt).
    """
    spark = distances.sparkSession
    total = int(opportunities.agg(F.sum("n")).first()[0] or 0)
    people = population.filter("population > 0").withColumn("hi", F.sum("population").over(Window.orderBy("vertex_id")))  # one row a source vertex
    everyone = int(population.agg(F.sum("population")).first()[0] or 0)
    sources = people.select(F.col("vertex_id").alias("source"), (F.col("hi") - F.col("population")).alias("lo"), "hi")
    open_ = spark.range(n).select(F.col("id").alias("trip_id"))
    done, attempt = None, 0

    while True:
        def draw(frames: Iterator[pd.DataFrame], attempt: int = attempt) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for t in f["trip_id"]:
                    g = np.random.default_rng([seed, t, attempt])
                    person, fit = int(g.integers(everyone)), 0
                    while fit == 0:
                        fit = int(g.binomial(int(g.integers(1, total + 1)), 1 - selectivity))
                    skip = total
                    while skip >= total:
                        skip = int(g.geometric(fit / total)) - 1
                    rows.append((t, person, skip, bool(g.random() < swap)))
                yield pd.DataFrame(rows, columns=["trip_id", "person", "skip", "turned"])

        drawn = open_.mapInPandas(draw, "trip_id long, person long, skip long, turned boolean")
        placed = drawn.join(F.broadcast(sources) if sources.count() < 100_000 else sources, (F.col("person") >= F.col("lo")) & (F.col("person") < F.col("hi"))).select("trip_id", "source", "skip", "turned")
        from roadweave.operators.shared import stored

        got = stored(choose_given_skip(distances, opportunities, placed.select("trip_id", "source", "skip")).join(placed.select("trip_id", "turned"), "trip_id").filter("source != destination"))
        ends = got.select("trip_id", F.when(F.col("turned"), F.col("destination")).otherwise(F.col("source")).alias("origin"), F.when(F.col("turned"), F.col("source")).otherwise(F.col("destination")).alias("destination"))
        done = ends if done is None else done.unionByName(ends)
        open_ = stored(open_.join(got.select("trip_id"), "trip_id", "left_anti"))
        attempt += 1
        if not open_.limit(1).count():
            return done
