"""Road operators: oracle comparison on the smallest tables, invariants, and micro fixtures."""

import heapq
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave import catalog
from roadweave.functions import cost, geometry, scalars
from roadweave.operators import assignment, demand, graph, hierarchy, search, spatial
from roadweave.sources import formats
from roadweave.sources.derived import Network
from roadweave.streaming import counts
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(k for k in catalog.QUERIES if k in catalog.ORACLES))
def test_against_oracle(spark, name):
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.fixture(scope="module")
def net(spark):
    n = Network(spark, SF)
    return n, n.edges().cache(), n.od().cache()


def edge_table(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edge_id long, tail long, head long, travel_time long, length long, capacity long, num_lanes long")


def test_ties_take_the_least_edge(spark):
    e = edge_table(spark, [(0, 2, 1, 1, 9, 1), (0, 1, 1, 1, 9, 1), (2, 3, 1, 1, 9, 1), (1, 3, 1, 1, 9, 1)])
    od = spark.createDataFrame([(0, 0, 3), (1, 3, 0)], "od_id long, origin long, destination long")
    rows = {r.od_id: (r.distance, r.path) for r in search.point_to_point(e, od).collect()}
    assert rows == {0: (2, [0, 2]), 1: (None, None)}


def test_backends_agree(net):
    n, edges, od = net
    base = {r.od_id: r.distance for r in search.point_to_point(edges, od, paths=False).collect()}
    assert {r.od_id: r.distance for r in catalog.QUERIES["sp6_bidirectional"](n.spark, SF).collect()} == base
    sources = od.select(F.col("origin").alias("source")).distinct().limit(3)
    kernel = {tuple(r) for r in search.one_to_all(edges, sources).select("source", "vertex_id", "distance").collect()}
    assert {tuple(r) for r in search.relax_to_fixpoint(edges.filter("tail < 60 and head < 60"), sources.limit(1)).collect()}
    assert len(kernel) == 600


def test_fixpoint_on_the_whole_network(net, monkeypatch):
    n, edges, _ = net
    sources = n.spark.createDataFrame([(0,), (999,)], "source long")
    kernel = {tuple(r) for r in search.one_to_all(edges, sources).collect()}
    monkeypatch.setattr(search, "SNAPSHOT_EDGES", 100)
    assert {tuple(r) for r in search.one_to_all(edges, sources).collect()} == kernel and len(kernel) == 201


def test_whole_network_components(net):
    n, edges, _ = net
    out = {r.vertex_id: set() for r in n.vertices().collect()}
    for e in edges.collect():
        if (e.head > e.tail and e.tail % 5) or (e.head < e.tail and e.tail % 3):
            out[e.tail].add(e.head)
    reach = {}
    for v in out:
        seen, waiting = {v}, [v]
        while waiting:
            new = out[waiting.pop()] - seen
            seen |= new
            waiting += new
        reach[v] = seen
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in out}
    assert {r.vertex_id: r.component for r in catalog.QUERIES["g10_scc"](n.spark, SF).collect()} == want


def test_fixpoint_query_reaches_every_vertex(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "relax_to_fixpoint", lambda edges, sources, *_: seen.append(edges) or edges)
    catalog.QUERIES["sp1_fixpoint"](spark, "/root/testdata/sf0.01")
    assert seen[0].agg(F.max("head")).first()[0] == 1999


def test_flow_conservation(net):
    _, edges, od = net
    flows, dist = assignment.all_or_nothing(edges, od)
    vol = {r.edge_id: r.vol for r in flows.collect()}
    balance = {}
    total = 0
    for e in edges.collect():
        balance[e.tail] = balance.get(e.tail, 0) - vol.get(e.edge_id, 0)
        balance[e.head] = balance.get(e.head, 0) + vol.get(e.edge_id, 0)
        total += vol.get(e.edge_id, 0) * e.travel_time
    for r in od.collect():
        balance[r.origin] += 1
        balance[r.destination] -= 1
    assert not any(balance.values()) and total == dist.agg(F.sum("distance")).first()[0]


def test_hierarchy(net):
    n, edges, _ = net
    order, tree = hierarchy.nested_order(n.vertices(), edges)
    assert sorted(r["rank"] for r in order.collect()) == list(range(200))
    snap = search.Snapshot.of(edges)
    h = hierarchy.customise(hierarchy.build_topology(snap, order), snap)
    for u in h.up:  # chordal: upper neighbours form a clique
        assert all(w in h.up[v] for v, w in itertools.combinations(u, 2))
    arcs = hierarchy.hierarchy_tables(n.spark, h)["arcs"]
    cells = hierarchy.read_partition(tree, 16).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 200 and max(r["count"] for r in cells) <= 16
    weight = {r.edge_id: r.travel_time for r in edges.collect()}
    for a in arcs.orderBy(F.col("mid").isNull(), "tail", "head").limit(5).collect():  # unpacked edges sum to the arc
        one = n.spark.createDataFrame([(a.tail, a.head, 1)], "tail long, head long, vol long")
        assert sum(weight[r.edge_id] * r.vol for r in hierarchy.unpack_flows(arcs, one).collect()) == a.weight
    assert len(hierarchy.perfect_removals(h)) > 0
    parents = hierarchy.hierarchy_tables(n.spark, h)["elim_parent"]
    assert hierarchy.cells_by_diameter(parents, 8).count() == 200


def test_frank_wolfe_converges(net):
    _, edges, od = net
    got = assignment.frank_wolfe(edges, od, 0.02, iterations=8)
    gaps = [s["prev_relative_gap"] for s in got.stats[1:]]
    assert got.stats[0]["prev_relative_gap"] is None and all(g >= -1e-9 for g in gaps) and gaps[-1] < gaps[0] and len(got.stats) == 8
    once = assignment.frank_wolfe(edges, od, 1.0, lengths=True)
    assert len(once.stats) == 1


def test_braess(spark):
    """Two routes, the shorter of which fills up: user equilibrium and system optimum differ."""
    e = edge_table(spark, [(0, 1, 100, 1, 10, 1), (1, 3, 100, 1, 10, 1), (0, 2, 300, 1, 1000, 1), (2, 3, 300, 1, 1000, 1)])
    od = spark.createDataFrame([(k, 0, 3) for k in range(20)], "od_id long, origin long, destination long")
    vol = {}
    for goal in ("ue", "so"):
        r = assignment.frank_wolfe(e, od, 1.0, goal, iterations=8)
        vol[goal] = dict(zip(r.edge_ids.tolist(), r.volumes.tolist()))
        assert vol[goal][0] + vol[goal][2] == pytest.approx(20)
    assert vol["ue"][0] == pytest.approx(14.1, abs=0.5) and vol["so"][0] < vol["ue"][0] - 3  # 100 (1 + (x/10)^2) = 300


def test_costs_are_derivatives():
    x, t, c, d = np.linspace(0.1, 9.0, 40), 12.0, 10.0, 1e-5
    for name, kind in cost.COSTS.items():
        f = kind(cost.ArrayOps)
        if name == "modified_davidson":
            x = np.linspace(0.1, 15, 40)
        assert np.allclose((f.value(t, c, x + d) - f.value(t, c, x - d)) / (2 * d), f.first(t, c, x), rtol=1e-3, atol=1e-3)
        if name != "modified_davidson":
            assert np.allclose((f.first(t, c, x + d) - f.first(t, c, x - d)) / (2 * d), f.second(t, c, x), rtol=1e-3, atol=1e-2)
        assert np.allclose((f.anti(t, c, x + d) - f.anti(t, c, x - d)) / (2 * d), f.value(t, c, x), rtol=1e-3, atol=1e-3)
        x = np.linspace(0.1, 9.0, 40)


def test_geometry(spark):
    one = spark.range(1)
    ring = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))))
    inside = lambda a, b: one.select(geometry.ring_contains(ring, F.lit(a), F.lit(b))).first()[0]
    assert inside(1, 1) and inside(1, 0) and not inside(1, 4) and not inside(5, 1)  # half-open in y
    meet = lambda *p: one.select(geometry.segments_meet(*((F.lit(a), F.lit(b)) for a, b in p))).first()[0]
    assert meet((0, 0), (4, 4), (0, 4), (4, 0)) and not meet((0, 0), (1, 1), (2, 2), (3, 3)) and meet((0, 0), (2, 2), (1, 1), (3, 3))
    p = one.select(geometry.laea_europe(F.lit(50_000_000), F.lit(5_000_000)).alias("p")).select("p.*").first()
    assert (round(p.easting, 2), round(p.northing, 2)) == (3962799.45, 2999718.85)  # published test point of EPSG:3035
    s = one.select(scalars.seconds_of_week(F.lit("Di"), F.lit("08:30:05")), scalars.next_power_of_two(F.lit(17)), scalars.highest_differing_bit(F.lit(8), F.lit(12))).first()
    assert tuple(s) == (86400 + 8 * 3600 + 1805, 32, 2)


def test_nearest_rejects_ties(spark):
    left = spark.createDataFrame([(1, 0, 0), (2, 1000, 1000)], "id long, lat int, lng int")
    right = spark.createDataFrame([(7, 10, 0), (8, -10, 0), (9, 1001, 1000)], "id long, lat int, lng int")
    assert [tuple(r) for r in spatial.mutual_matches(left, right, 50).collect()] == [(2, 9)]
    q = spark.createDataFrame([(1, 0, 0), (2, 10_000, 0)], "query_id long, x int, y int")
    pts = spark.createDataFrame([(5, 3, 4), (6, -3, 4)], "point_id long, x int, y int")
    assert sorted(tuple(r) for r in spatial.nearest(q, pts, 2, most_rings=8).collect()) == [(1, 5, 25), (2, 5, 9997**2 + 16)]


def test_nearest_without_coordinates_or_points(spark):
    q = spark.createDataFrame([(1, 0, 0), (2, None, 0)], "query_id long, x int, y int")
    pts = spark.createDataFrame([(5, 300_000, 0), (6, None, 0)], "point_id long, x int, y int")
    assert [tuple(r) for r in spatial.nearest(q, pts, 2).collect()] == [(1, 5, 300_000**2)]
    assert spatial.nearest(q, pts.limit(0), 2).collect() == []


def test_nearest_segments(spark):
    q = spark.createDataFrame([(1, 500, 10), (2, 0, 400_000), (3, 900, -10), (4, None, 3), (5, 100_000_000, 0)], "query_id long, x int, y int")
    lines = "edge_id long, tail long, head long, x1 int, y1 int, x2 int, y2 int"
    segments = spark.createDataFrame([(9, 1, 2, 0, 0, 1000, 0), (8, 2, 1, 1000, 0, 0, 0), (7, 3, 4, -2_000_000, 400_000, 2_000_000, 400_000), (6, 3, 3, 900, -15, 900, -15), (5, 5, 6, None, 0, 0, 0)], lines)
    got = {r.query_id: (r.edge_id, r.vertex_id, round(r.metres, 2)) for r in spatial.nearest_segments(q, segments, 500, cell=200_000).collect()}
    bulge = 6371000 * (math.atan(math.tan(math.radians(0.4)) / math.cos(math.radians(2))) - math.radians(0.4))  # an arc between points of one latitude bends polewards
    assert got == {1: (8, 1, 1.11), 2: (7, 4, round(bulge, 2)), 3: (6, 3, 0.56)}
    assert spatial.nearest_segments(q, segments.limit(0), 500).collect() == []


def test_components_of_a_chain(spark):
    v = spark.range(8).withColumnRenamed("id", "vertex_id")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "tail long, head long")
    assert {r.vertex_id: r.component for r in graph.strong_components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {r.vertex_id: r.component for r in graph.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {r.vertex_id for r in graph.largest_component(graph.strong_components(v, e)).collect()} == {0, 1, 2}


def test_formula_sums_to_one(net):
    n, edges, _ = net
    p = catalog.QUERIES["d4_formula_probability"](n.spark, SF).groupBy("source").agg(F.sum("probability").alias("p")).collect()
    assert p and all(r.p == pytest.approx(1, abs=1e-6) for r in p)


def test_demand_from_all_inhabitants(net):
    """Every populated vertex is a source: probabilities, trips and mean distances against brute force."""
    n, edges, _ = net
    people = {r.vertex_id: r.population for r in n.population().collect()}
    opp = {r.vertex_id: r.n for r in n.pois().groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, share = {}, lambda m: (1 - 0.9**m) / m
    for e in edges.collect():
        out.setdefault(e.tail, []).append((e.head, e.travel_time))
    total, want, by_rank = 1 + sum(opp.values()), {}, {}
    for source in people:
        heap, seen, between, rank = [(0, source)], set(), 0, 0
        s = opp.get(source, 0) + 1
        norm = 1 / (1 - ((1 - 0.9**total) / (1 - 0.9**s)) * (s / total))
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            for _ in range(opp.get(v, 0)):
                by_rank.setdefault(rank, []).append((people[source], d))
                rank += 1
            if v != source and v in opp:
                want[source, v] = (share(s + between) - share(s + between + opp[v])) / share(s) * norm
                between += opp[v]
            for h, w in out[v]:
                heapq.heappush(heap, (d + w, h))
    got = {(r.source, r.vertex_id): r.probability for r in catalog.QUERIES["d4_formula_probability"](n.spark, SF).collect()}
    assert len(people) > 40 and got == pytest.approx(want, abs=1e-8)
    trips = catalog.QUERIES["d4_formula_demand"](n.spark, SF).collect()
    assert abs(sum(r.trips for r in trips) - 10_000) < 1_000 and len({r.origin for r in trips}) > 40
    ranks = [r.expected_distance for r in catalog.QUERIES["d19_mean_distance"](n.spark, SF).orderBy("rank").collect()]
    assert ranks == pytest.approx([sum(p * d for p, d in x) / sum(p for p, _ in x) for _, x in sorted(by_rank.items())], abs=1e-5)


def test_population_is_assigned_once(net):
    n, _, _ = net
    got = catalog.QUERIES["d2_population_hash"](n.spark, SF)
    assert got.agg(F.sum("population")).first()[0] == n.population().agg(F.sum("population")).first()[0]


def test_chooser_follows_the_formula(net):
    n, edges, _ = net
    dist = search.one_to_all(edges, n.population().select(F.col("vertex_id").alias("source"))).select("source", "vertex_id", "distance")
    opp = n.pois().groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n"))
    trips = demand.choose_trips(dist, opp, n.population(), 400, 0.9)
    rows = trips.collect()
    assert len(rows) == 400 and all(r.origin != r.destination for r in rows)
    pois = {r.vertex_id for r in opp.collect()}
    assert {r.destination for r in rows} <= pois


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_xatf(spark, tmp_path):
    v = write(tmp_path, "v", "1,0,0,900000,4800000\n2,0,0,901000,4800000\n3,0,0,902000,4800000\n")
    e = write(tmp_path, "e", "1,1,2,0,1000,0,1,0,0,4\n2,2,3,0,500,0,0,0,0,9\n3,1,3,0,7,0,2,0,0,13\n")
    vertices, edges = formats.read_xatf(spark, v, e)
    got = {(r.tail, r.head): (r.length, r.free_flow_speed, r.num_lanes, r.capacity, r.travel_time) for r in edges.collect()}
    assert [r.orig_id for r in vertices.orderBy("vertex_id").collect()] == [1, 2, 3] and got[(0, 1)] == (1000, 100, 2, round(9000 * 2 * 100 / 545), 360)
    assert got[(1, 2)] == got[(2, 1)] and got[(1, 2)][4] == 360 and (0, 2) not in got
    assert got[(2, 0)][0] > 1000 and got[(2, 0)][1:] == (None, -1, 0, 600 * 7)  # a ferry's time is that of the length in the file


def test_dimacs_and_text_formats(spark, tmp_path):
    d = write(tmp_path, "d.gr", "c x\np sp 2 2\na 1 2 30\na 2 1 40\n")
    t = write(tmp_path, "t.gr", "p sp 2 2\na 1 2 3\na 2 1 4\n")
    c = write(tmp_path, "c.co", "p aux sp co 2\nv 1 9000000 48000000\nv 2 9100000 48000000\n")
    v, e = formats.read_dimacs(spark, d, t, c)
    assert sorted((r.tail, r.head, r.length, r.travel_time) for r in e.collect()) == [(0, 1, 30, 30), (1, 0, 40, 40)] and v.count() == 2
    grid = write(tmp_path, "p.csv", "Gitter_ID_100m;Einwohner\n100mN26840E43341;5\n100mN26840E43342;-1\n")
    assert [tuple(r) for r in formats.read_population(spark, grid, 100).collect()] == [(43341, 26840, 5)]
    od = write(tmp_path, "od.csv", "# made by hand\norigin,destination,departure\n1,2,7\n")
    assert [tuple(r) for r in formats.read_od(spark, od).collect()] == [(1, 2, None, None)]
    m = write(tmp_path, "m.mtx", "\n".join(["h"] * 8 + ["1 2 3.5", "2 1 1"]))
    assert [tuple(r) for r in formats.read_matrix(spark, m).collect()] == [(1, 2, 3.5), (2, 1, 1.0)]
    f = write(tmp_path, "f.csv", "iteration,vol,sat\n1,5,0.5\n1,6,0.6\n2,7,0.7\n")
    assert sorted((r.iteration, r.edge_id, r.vol) for r in formats.read_flows(spark, f).collect()) == [(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)]
    trips = write(tmp_path, "t.csv", "1;2;Mo;08:00;09:00;60;Z12;Z13;5;car;w;8\n1;3;Sunday;23:59;00:10;11;X;Z13;5;foot;w;8\n")
    assert [(r.departure, r.origin_zone, r.mode) for r in formats.read_mobitopp(spark, trips).collect()] == [(28800, 12, "car"), (604740, None, "foot")]
    s = write(tmp_path, "n.net", "* c\n$A:X;Y\n1;2\n$B:Z\n3\n")
    assert [(r.section, r.text) for r in formats.read_sections(spark, s).orderBy("line").collect()] == [("A", "$A:X;Y"), ("A", "1;2"), ("B", "$B:Z"), ("B", "3")]


def test_poly_round_trip(spark, tmp_path):
    text = formats.poly_text([(False, [(0, 0), (10, 0), (10, 10), (0, 10)]), (True, [(2, 2), (8, 2), (8, 8), (2, 8)])])
    faces = formats.read_poly(spark, write(tmp_path, "a.poly", text))
    assert faces.count() == 2
    pts = spark.createDataFrame([(1, 1, 1), (2, 5, 5), (3, 20, 20)], "point_id long, x int, y int")
    assert [r.point_id for r in spatial.points_in_areas(pts, faces, 4).collect()] == [1]


def test_matsim(spark, tmp_path):
    text = '<network><nodes><node id="1" x="1" y="2"/><node id="2" x="3" y="4"/></nodes><links><link id="a" from="1" to="2" length="100.0" freespeed="10.0" capacity="2000" permlanes="2" modes="car,bus"/><link id="b" from="2" to="1" length="100.0" freespeed="10.0" capacity="2000" permlanes="2" modes="rail"/></links></network>'
    nodes, links = formats.read_matsim(spark, write(tmp_path, "n.xml", text), ["car"])
    assert nodes.count() == 2 and [(r.link_id, r.free_flow_speed, r.travel_time) for r in links.collect()] == [("a", 36, 110)]


def test_osm_tags(spark):
    rows = [(1, {"highway": "primary", "maxspeed": "30 mph", "lanes": "4"}), (2, {"highway": "motorway"}), (3, {"highway": "footway"}), (4, {"highway": "residential", "oneway": "-1", "lanes:forward": "3"})]
    got = {r.way_id: (r.direction, r.speed_limit, r.lanes_forward) for r in formats.osm_way_attributes(spark.createDataFrame(rows, "way_id long, tags map<string,string>")).collect()}
    assert got == {1: ("both", 30 * 1.609344, 2.0), 2: ("forward", 120, 2.0), 4: ("reverse", 15, 3.0)}
    seg = spark.createDataFrame([("primary", 150, 1.0, 1500, 80, False), ("residential", 50, 1.0, 600, 30, True)], "highway string, length int, lanes double, lane_capacity int, speed_limit int, signed boolean")
    assert [(r.capacity, r.free_flow_speed) for r in formats.osm_segment_attributes(seg).collect()] == [(1500, 45), (1200, 15)]


def test_network_round_trip(net, tmp_path):
    n, edges, _ = net
    formats.write_network(n.vertices(), edges, f"file://{tmp_path}/g", ["edge_id", "tail", "head"])
    v, e = formats.read_network(n.spark, f"file://{tmp_path}/g")
    assert v.count() == 200 and e.columns == ["edge_id", "tail", "head"] and e.count() == 742


def test_stream_equals_batch(net, tmp_path):
    n, edges, _ = net
    events = n.count_events().select("ts", "edge_id", "value")
    events.coalesce(2).write.parquet(f"file://{tmp_path}/events")
    stream = counts.windowed_counts(n.spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    total = n.spark.sql("SELECT sum(m) FROM (SELECT max(n) AS m FROM counted GROUP BY start, edge_id)").first()[0]
    assert total == events.count() == counts.windowed_counts(events).agg(F.sum("n")).first()[0]


def test_entry_survives_without_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['roadweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
