"""What must not pass through the driver: graphs of searches, and tables that an estimate takes for small ones."""

import pickle

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import catalog
from roadweave.operators import hierarchy, poi, search, settle
from roadweave.sources.derived import Network

SF = "/root/testdata/sf0.001"
#: Queries whose searches take the graph from the shared folder.
SEARCHES = ["a1_aon_flows", "a1_checksum", "d15_od_by_rank", "d16_od_by_distance", "d5_intervening", "k1_closest_poi", "k7_ball", "snk3_od_distances", "sp1_one_to_all",
            "sp20_batch_queries", "sp22_dijkstra_rank", "sp2_point_to_point", "sp4_parents", "sp4_path_cost", "sp5_bounded"]


@pytest.fixture
def no_driver(spark, monkeypatch):
    """Nothing is collected or broadcast by the program, and sparkContext.broadcast sees no snapshot."""

    def refuse(*_, **__):
        raise AssertionError("rows or a graph pass through the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(type(spark.range(0)), "toPandas", refuse)
    monkeypatch.setattr(type(spark.range(0)), "collect", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)


@pytest.mark.parametrize("name", SEARCHES)
def test_graphs_bypass_the_driver(spark, no_driver, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_a_shared_snapshot_is_a_path(spark):
    edges = Network(spark, SF).edges()
    sent = search.Snapshot.shared(edges)
    assert len(pickle.dumps(sent)) < 500
    rows = sorted((r.tail, r.edge_id, r.head, r.travel_time) for r in edges.collect())
    g = sent.value
    assert [(int(g.ids[t]), e, int(g.ids[h]), w) for t, e, h, w in zip(g.tail.tolist(), g.edge.tolist(), g.head.tolist(), g.weight.tolist())] == rows
    assert [g.first[k + 1] - g.first[k] for k in range(len(g.ids))] == np.bincount(g.tail, minlength=len(g.ids)).tolist()


def test_rows_of_large_graphs(spark, monkeypatch):
    """Arrays in place of lists, ids and weights beyond 32 bits, and heads without edges of their own."""
    far = 2**40
    rows = [(far + 1, 5, 3, far), (far, far + 1, 2, 1), (far + 2, far, far + 3, 2**35), (far + 3, far, 5, 7)]
    edges = spark.createDataFrame(rows, "edge_id long, tail long, head long, travel_time long")
    sources = spark.createDataFrame([(5,), (far,), (77,)], "source long")

    def found():
        return sorted(map(tuple, search.one_to_all(edges, sources).collect()), key=str), sorted(map(tuple, settle.within(edges, sources, 2**36).collect())), sorted(map(tuple, poi.closest_pois(edges, sources, spark.createDataFrame([(3,), (77,)], "vertex_id long"), 2).collect()))

    listed = found()
    assert isinstance(search.Snapshot.of(edges).lists(), list)
    monkeypatch.setattr(search, "LISTED_EDGES", 0)
    assert not isinstance(search.Snapshot.of(edges).lists(), list)
    assert found() == listed and (far, 3, 7 + far, far + 1) in listed[0] and listed[1] == [(5, 5, 0), (far, 5, 7), (far, far, 0), (far, far + 3, 2**35)]


def test_no_edges(spark):
    edges = spark.createDataFrame([], "edge_id long, tail long, head long, travel_time long")
    sources = spark.createDataFrame([(4,)], "source long")
    assert [tuple(r) for r in search.one_to_all(edges, sources).collect()] == [(4, 4, 0, None)]
    assert settle.within(edges, sources, 9).count() == 0


@pytest.mark.parametrize("name", ["src1_edges", "j6_mutual_nn", "j9_nearest_segment", "j11_raster_radiation"])
def test_network_tables_are_not_broadcast_by_estimate(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    small = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_lot" not in x]  # lots of numbering are few
    assert not small, small


@pytest.mark.parametrize("name", ["sp11_hierarchy_arcs", "sp17_contraction_order", "sp18_partition", "sp19_od_cells", "a3_unpacked_flows"])
def test_hierarchies_bypass_the_jvm(spark, no_driver, monkeypatch, name):
    """Orders, trees and arcs go between the driver's arrays and tables as files, never as rows."""

    def refuse(*_, **__):
        raise AssertionError("rows of the driver's arrays pass through the JVM")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_buckets_bypass_the_driver(spark, no_driver, monkeypatch):
    """Neither the hierarchy of all arcs nor a broadcast of it."""
    monkeypatch.setattr(hierarchy, "build_topology", None)
    assert catalog.QUERIES["k3_bucket_knn"](spark, SF).count() > 0
