"""Property-graph reads: snapshots, neighbours and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.sources.tables import written

from . import predicates as P


def snapshot_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes that are no versions."""
    ids = nodes.where(P.not_version()).select("item_id")
    return edges.join(ids.withColumnRenamed("item_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("item_id", "target_id"), "target_id", "left_semi")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "edge_type").distinct()


def edges_of(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct edges that touch any of the ids: two filters, so that either end can prune its scan."""
    return distinct_edges(edges.where(F.col("source_id").isin(ids)).unionByName(edges.where(F.col("target_id").isin(ids))))


def neighbours(edges: DataFrame, item: str) -> DataFrame:
    """Distinct (other, edge_type, direction); edges without type and self-loops are left out."""
    live = edges.where("edge_type IS NOT NULL AND source_id <> target_id")
    out = live.where(F.col("source_id") == item).select(F.col("target_id").alias("other"), "edge_type", F.lit("outgoing").alias("direction"))
    back = live.where(F.col("target_id") == item).select(F.col("source_id").alias("other"), "edge_type", F.lit("incoming").alias("direction"))
    return out.unionByName(back).distinct()


def within_hops(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """item_id and its least number of outgoing hops; the frontier grows by one join a hop, and is written down so that plans do not."""
    spark = edges.sparkSession
    live = edges.where("edge_type IS NOT NULL AND source_id <> target_id").select("source_id", "target_id").distinct()
    reached = spark.range(1).select(F.lit(start).alias("item_id"), F.lit(0).alias("hops"))
    front = reached
    for k in range(1, hops + 1):
        step = front.join(live, front["item_id"] == live["source_id"]).select(F.col("target_id").alias("item_id")).distinct()
        front = written(step.join(reached, "item_id", "left_anti").select("item_id", F.lit(k).alias("hops")))
        reached = reached.unionByName(front)
    return reached


def page(nodes: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return nodes.orderBy("item_id").offset(offset).limit(limit)
