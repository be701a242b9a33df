"""A road network, trips, points of interest, people and zones derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators.graph import compact_ids
from roadweave.operators.shared import large


@dataclass
class Network:
    """Lazy tables of one scale; see the README for their columns."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def n_vertices(self) -> int:
        return self.table("part").count()  # from the file footers

    @property
    def width(self) -> int:
        n = self.n_vertices
        w = int(n**0.5)
        while w * w < n:
            w += 1
        return w

    def vertices(self) -> DataFrame:
        w = self.width
        key = F.col("p_partkey").cast("long")
        y = F.floor(key / w).cast("long")
        return self.table("part").select(
            key.alias("vertex_id"), (key % w).alias("x"), y.alias("y"), F.col("p_size").cast("long").alias("p_size"),
            (48700000 + y * 900).cast("int").alias("lat"), (9100000 + (key % w) * 1350).cast("int").alias("lng"),
        )

    def edges(self) -> DataFrame:
        """Four neighbours of each vertex, by equi-joins on the neighbour's id."""
        w = self.width
        v = self.vertices().select("vertex_id", "x", "y", "p_size")
        near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
        reach = v.select("vertex_id", "x", "y", F.col("p_size").alias("a"), F.explode(near).alias("o")).filter((F.col("x") + F.col("o.dx")).between(0, w - 1) & (F.col("y") + F.col("o.dy") >= 0))
        heads = v.select(F.col("vertex_id").alias("head"), F.col("p_size").alias("b"))
        e = reach.withColumn("head", F.col("vertex_id") + F.col("o.dx") + F.col("o.dy") * w).join(large(heads), "head")
        a, b = F.col("a"), F.col("b")
        rows = e.select(
            F.col("vertex_id").alias("tail"), "head",
            (10 + (7 * a + 3 * b) % 50).alias("travel_time"), (100 + (11 * a + 13 * b) % 400).alias("length"),
            (20 + (5 * a + b) % 80).alias("capacity"), (1 + (a + b) % 3).alias("num_lanes"),
        )
        return compact_ids(rows, ["tail", "head"], "edge_id").select("edge_id", "tail", "head", "travel_time", "length", "capacity", "num_lanes")

    def od(self) -> DataFrame:
        n = self.n_vertices
        return self.table("orders").filter(F.col("o_orderkey") % 100 == 0).select(
            F.col("o_orderkey").cast("long").alias("od_id"), ((F.col("o_custkey") * 13 + 5) % n).cast("long").alias("origin"),
            ((F.col("o_orderkey") * 7 + 3) % n).cast("long").alias("destination"), F.col("o_orderdate").alias("departure"),
        )

    def pois(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("long").alias("poi_id"), ((F.col("s_suppkey") * 37 + 11) % self.n_vertices).cast("long").alias("vertex_id"))

    def population(self) -> DataFrame:
        at = ((F.col("c_custkey") * 17 + 5) % self.n_vertices).cast("long")
        return self.table("customer").groupBy(at.alias("vertex_id")).agg(F.sum(1 + F.col("c_custkey") % 9).cast("long").alias("population"))

    def zones(self) -> DataFrame:
        return self.vertices().select("vertex_id", (F.floor(F.col("y") / 8) * 1000 + F.floor(F.col("x") / 8)).cast("long").alias("zone_id"))

    def count_events(self) -> DataFrame:
        m = self.edges().count()
        return self.table("events").select("event_id", "ts", ((F.col("user_id") * 29 + F.col("event_id")) % m).cast("long").alias("edge_id"), "value")
