"""Traffic counts as a stream: windowed sums by edge, late counts dropped after the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, edge_id, n, value) of tumbling windows over (ts, edge_id, value), batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    sums = marked.groupBy(F.window("ts", window).alias("w"), "edge_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("start"), "edge_id", "n", "value")


def capacity_alerts(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Windows whose count exceeds the edge's capacity; edges are a static table, so the join keeps no state."""
    return counts.join(edges.select("edge_id", "capacity"), "edge_id").filter(F.col("n") > F.col("capacity"))
