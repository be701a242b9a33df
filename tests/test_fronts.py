"""Fronts against plain searches."""

import numpy as np
import pytest

from roadweave import catalog
from roadweave.operators import assignment, fronts, hierarchy, poi, search, settle
from roadweave.sources.derived import Network


@pytest.fixture
def graph(spark):
    """A net with one-way and parallel edges, ties, a part that cannot be left, an end without a place and a vertex without edges."""
    rng, side, rows = np.random.default_rng(7), 17, []
    for v in range(side * side):
        for u in ([v + 1] if v % side < side - 1 else []) + ([v + side] if v + side < side * side else []):
            rows += [(a, b, int(rng.integers(1, 5))) for a, b in ((v, u), (u, v), (v, u)) if rng.random() < 0.7 and not a > 270 >= b]
    rows.append((3, 9999, 2))
    ids = rng.permutation(len(rows)).tolist()
    edges = spark.createDataFrame([(i, a, b, w) for i, (a, b, w) in zip(ids, rows)], "edge_id long, tail long, head long, travel_time long")
    vertices = spark.createDataFrame([(v, v % side, v // side) for v in range(side * side)] + [(5000, 3, 3)], "vertex_id long, x long, y long")
    od = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, side * side, (120, 2)))] + [(900, 3, 9999), (901, 9999, 3), (902, 5000, 3), (903, 4, 5000), (904, 77777, 77777), (905, 6, 6), (906, 88888, 1)], "od_id long, origin long, destination long")
    return vertices, edges, od


def rows(df):
    return sorted((r.od_id, r.origin, r.destination, r.distance, r.path and list(r.path)) for r in df.collect())


@pytest.mark.parametrize("leaf, far", [(4, 0), (64, 0), (9, 1 << 40)])
def test_trips(spark, graph, monkeypatch, leaf, far):
    monkeypatch.setattr(fronts, "LEAF", leaf)
    monkeypatch.setattr(fronts, "PIVOTS", 3)
    monkeypatch.setattr(fronts, "STRIP", 50)
    vertices, edges, od = graph
    edges = edges.withColumn("travel_time", edges.travel_time + far)
    assert rows(fronts.trips(fronts.build(vertices, edges), od, paths=True)) == rows(search.point_to_point(edges, od))


def found(df):
    return sorted(map(tuple, df.collect()))


def by_both(monkeypatch, make):
    """Rows of searches and of fronts."""
    monkeypatch.setattr(search, "FRONT_EDGES", 1 << 40)
    plain = make()
    monkeypatch.setattr(search, "FRONT_EDGES", 0)
    monkeypatch.setattr(search.Snapshot, "shared", None)  # no search by arrays
    assert make() == plain and plain


def test_operators_with_places(spark, graph, monkeypatch):
    monkeypatch.setattr(fronts, "LEAF", 6)
    monkeypatch.setattr(fronts, "LANES", 7)
    monkeypatch.setattr(fronts, "ROWS", 50)
    vertices, edges, od = graph
    ends = od.selectExpr("od_id", "origin as source", "destination as vertex_id")
    some = vertices.filter("vertex_id % 3 = 0").selectExpr("vertex_id", "vertex_id % 5 as n")

    def make():
        vol, distances = assignment.all_or_nothing(edges, od, places=vertices)
        return [
            rows(search.point_to_point(edges, od, places=vertices)), found(vol), sorted(map(tuple, distances.collect())), sorted(map(tuple, search.timed_queries(edges, od, places=vertices).drop("query_time").collect())),
            found(settle.ranks(edges, ends, places=vertices)), found(settle.between(edges, ends, some, places=vertices)),
        ]

    by_both(monkeypatch, make)


@pytest.mark.parametrize("name", ["a1_aon_flows", "a1_checksum", "d5_intervening", "snk3_od_distances", "sp20_batch_queries", "sp22_dijkstra_rank", "sp2_point_to_point", "sp4_path_cost"])
def test_queries_of_far_trips_take_fronts(spark, monkeypatch, name):
    by_both(monkeypatch, lambda: found(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")))


@pytest.mark.parametrize("leaf, far, k, step", [(4, 0, 3, 7), (9, 0, 1, 2), (64, 1 << 40, 4, 11), (6, 0, 5, 97)])
def test_buckets(spark, graph, monkeypatch, leaf, far, k, step):
    """Ties, points met by many hubs and tasks, copies, nulls, unknown vertices, sources that reach fewer points than asked for."""
    monkeypatch.setattr(fronts, "LEAF", leaf)
    monkeypatch.setattr(fronts, "ROWS", 50)
    vertices, edges, _ = graph
    edges = edges.withColumn("travel_time", edges.travel_time + far)
    known = [r.vertex_id for r in vertices.collect()] + [9999]
    sources = spark.createDataFrame([(v,) for v in known + [77777, 6]], "source long")
    pois = spark.createDataFrame([(v,) for v in [*known[::step], 9999, 5000, 88888, 0, 0]] + [(None,)], "vertex_id long")
    alone = (5000, 5000, 0, 1)  # the search by edges knows no vertex without any
    sent = fronts.build(vertices, edges)
    assert found(fronts.closest(sent, sources.unionByName(spark.createDataFrame([(None,)], "source long")), pois, k)) == sorted([*found(poi.closest_pois(edges, sources, pois, k)), alone])
    held = fronts.buckets(sent, pois, k).collect()
    turns = {}
    for r in sorted(held):
        turns.setdefault(r.hub, []).append((r.turn, r.dist, r.poi_vertex))
    assert all([t for t, _, _ in x] == list(range(len(x))) and len(x) <= k and x == sorted(x, key=lambda y: y[1:]) for x in turns.values())
    assert fronts.closest(sent, sources, pois.limit(0), k).count() == 0 == fronts.closest(sent, sources.limit(0), pois, k).count()


def test_buckets_of_fronts_and_of_labels(spark):
    n = Network(spark, "/root/testdata/sf0.001")
    snap = search.Snapshot.of(n.edges())
    h = hierarchy.customise(hierarchy.build_topology(snap, hierarchy.nested_order(n.vertices(), n.edges())[0]), snap)
    labels = hierarchy.label_tables(spark, h)
    up = labels.filter("side = 'up' and vertex_id % 3 = 0").selectExpr("vertex_id as source", "hub", "dist")
    down = labels.filter("side = 'down'").join(n.pois().select("vertex_id").distinct(), "vertex_id").selectExpr("vertex_id as poi_vertex", "hub", "dist")
    sources = n.vertices().filter("vertex_id % 3 = 0").selectExpr("vertex_id as source")
    assert found(fronts.closest(fronts.build(n.vertices(), n.edges()), sources, n.pois(), 4)) == found(poi.bucket_closest(up, down, 4))
