"""Structural operators on edge and vertex tables: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.shared import stored

#: Rows that one task numbers at a time.
LOT = 1 << 16


def compact_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense ids from 0 in the order of integer columns, as row_number() - 1 over all rows gives them.

    Rows are numbered in lots of the first column's range; the small table of lot sizes is
    prefix-summed, so no task sees all rows if the first column is spread, as ids of vertices
    are. ``range_ids`` does the same for other columns.
    """
    lot = F.floor(F.col(order[0]) / LOT)
    rows = df.withColumn("_lot", lot)
    sizes = rows.groupBy("_lot").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("_lot").alias("_l"), F.coalesce(F.sum("_n").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_lot").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(starts, F.col("_lot") == F.col("_l"))
        .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_lot", "_l", "_row", "_start")
    )


def range_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``compact_ids`` for keys of any kind and spread: rows are sorted over range partitions, which are counted.

    The sorted rows are stored once, so that counts and numbers are of the same partitions.
    Of rows alike in ``order`` all go to one task.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(starts, part == F.col("_p")).withColumn(name, (F.col("_start") + row).cast("long")).drop("_at", "_p", "_start")


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex_id, out_degree, in_degree) of every vertex with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("tail").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("head").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.v").alias("vertex_id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def contains_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (tail, head) that some edge connects."""
    return pairs.join(edges.select("tail", "head"), ["tail", "head"], "left_semi")


def unique_edges(edges: DataFrame) -> DataFrame:
    """(tail, head, edge_id) where exactly one edge runs from tail to head."""
    return edges.groupBy("tail", "head").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id")).filter("n = 1").drop("n")


def reverse(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("tail", "head")]
    return edges.select(*others, F.col("head").alias("tail"), F.col("tail").alias("head"))


def project(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The columns named by ``defaults``; ones that the table lacks get their default, others are dropped."""
    return table.select(*(F.col(c) if c in table.columns else F.lit(v).alias(c) for c, v in defaults.items()))


def insert_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (without edge_id) appended with the next free ids, in the order of (tail, head)."""
    top = edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0]
    new = compact_ids(more, ["tail", "head"], "edge_id").withColumn("edge_id", F.col("edge_id") + top + 1)
    return edges.unionByName(new, allowMissingColumns=True)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("edge_id"), "edge_id", "left_anti")


def redirect_edges(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges with the heads that ``heads`` (edge_id, new_head) gives them."""
    return edges.join(heads, "edge_id", "left").withColumn("head", F.coalesce("new_head", "head")).drop("new_head")


def sort_edges(edges: DataFrame) -> DataFrame:
    """Range-partitioned by tail and sorted inside: the layout for scans by tail."""
    return edges.repartitionByRange("tail").sortWithinPartitions("tail", "head", "edge_id")


def permute_vertices(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges renumbered by ``mapping`` (old, new)."""
    m = lambda c: mapping.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
    return edges.join(m("tail"), "tail").join(m("head"), "head").drop("tail", "head").withColumnsRenamed({"new_tail": "tail", "new_head": "head"})


def induced_subgraph(vertices: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices in ``keep`` (vertex_id), densely renumbered with orig_id, and the edges with both ends kept."""
    kept = compact_ids(vertices.join(keep.select("vertex_id"), "vertex_id", "left_semi"), ["vertex_id"], "new_id")
    mapping = kept.select(F.col("vertex_id").alias("old"), F.col("new_id").alias("new"))
    inner = permute_vertices(edges, mapping)
    return kept.withColumnsRenamed({"vertex_id": "orig_id", "new_id": "vertex_id"}), inner


def switch_metric(edges: DataFrame) -> DataFrame:
    """Travel time replaced by length."""
    return edges.withColumn("travel_time", F.col("length"))


def broken_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose tail or head is no vertex; a valid graph has none."""
    known = vertices.select("vertex_id")
    return edges.join(known, F.col("tail") == F.col("vertex_id"), "left_anti").unionByName(edges.join(known, F.col("head") == F.col("vertex_id"), "left_anti")).distinct()


def merge_networks(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Networks of several countries in one: repeated vertex ids and vertices at one place merge, self-loops go.

    The vertex with the least id represents its place.
    """
    once = vertices.dropDuplicates(["vertex_id"])
    mapping = once.withColumn("new", F.min("vertex_id").over(Window.partitionBy("lat", "lng")))
    kept = mapping.filter(F.col("new") == F.col("vertex_id")).drop("new")
    return kept, permute_vertices(edges, mapping.select(F.col("vertex_id").alias("old"), "new")).filter("tail != head")


def in_box(vertices: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Vertices with least x, least y, greatest x, greatest y of the box inclusive; plain ranges reach the scan."""
    return vertices.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def _least_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Fixpoint of label(head) = min(label(head), label(tail)) along links; stored every round."""
    while True:
        moved = links.join(labels.select(F.col("vertex_id").alias("tail"), "label"), "tail").select(F.col("head").alias("vertex_id"), "label")
        after = stored(labels.unionByName(moved).groupBy("vertex_id").agg(F.min("label").alias("label")))
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if after.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0] == before:
            return after
        labels = after


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex_id, component): least vertex that undirected paths reach, by hooking and pointer jumping."""
    ends = edges.select(F.col("tail").alias("a"), F.col("head").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = stored(both)
    labels = vertices.select("vertex_id", F.col("vertex_id").alias("label"))
    total = None
    while True:
        near = both.join(labels.select(F.col("vertex_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("vertex_id") == F.col("a"), "left").select("vertex_id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        # The old label's vertex hooks too, then labels jump to their label's label.
        roots = hooked.groupBy(F.col("was").alias("vertex_id")).agg(F.min("label").alias("r"))
        hung = hooked.join(roots, "vertex_id", "left").select("vertex_id", F.least("label", F.coalesce("r", "label")).alias("label"))
        jump = hung.select(F.col("vertex_id").alias("label"), F.col("label").alias("to"))
        labels = stored(hung.join(jump, "label", "left").select("vertex_id", F.least("label", F.coalesce("to", "label")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.withColumnRenamed("label", "component")
        total = now


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex_id, component) of strongly connected components, named by their least vertex.

    Colouring: forward minimum labels split the graph into colours; what reaches a colour's
    root backwards inside the colour is the root's component and leaves; the rest goes on.
    """
    rest_v, rest_e, found = vertices.select("vertex_id"), stored(edges.select("tail", "head").filter("tail != head").distinct()), []
    while rest_v.limit(1).count():
        colours = _least_labels(rest_e, rest_v.select("vertex_id", F.col("vertex_id").alias("label")))
        c = lambda x: colours.select(F.col("vertex_id").alias(x), F.col("label").alias(f"c_{x}"))
        within = stored(rest_e.join(c("tail"), "tail").join(c("head"), "head").filter("c_tail = c_head").select("tail", "head"))
        roots = colours.filter("vertex_id = label")
        seeds = colours.join(roots.select(F.col("vertex_id").alias("root")), F.col("vertex_id") == F.col("root"), "left")
        # 0 marks what is reached backwards from a root, 1 the rest.
        marks = _least_labels(reverse(within), seeds.select("vertex_id", F.when(F.col("root").isNotNull(), 0).otherwise(1).cast("long").alias("label")))
        done = stored(marks.filter("label = 0").select("vertex_id").join(colours, "vertex_id").withColumnRenamed("label", "component"))
        found.append(done)
        rest_v = stored(rest_v.join(done.select("vertex_id"), "vertex_id", "left_anti"))
        alive = lambda x: rest_v.select(F.col("vertex_id").alias(x))
        rest_e = stored(within.join(alive("tail"), "tail", "left_semi").join(alive("head"), "head", "left_semi"))
    out = found[0] if found else vertices.select("vertex_id", F.col("vertex_id").alias("component"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def largest_component(components_: DataFrame) -> DataFrame:
    """Vertices of the largest component; the one with the least name of several."""
    sizes = components_.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return components_.join(sizes, "component", "left_semi").select("vertex_id")
