"""Graph events as viewer messages and progress frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def messages(spans: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return spans.select("event_id", F.lit("new_event").alias("type"), F.coalesce("operation", F.lit("span")).alias("operation"), F.lit("unknown").alias("component"), blank("trace_id").alias("trace_id"), blank("span_id").alias("span_id"))


def kind() -> Column:
    return F.when(F.col("operation") == "add_node", "graph.node").when(F.col("operation") == "add_edge", "graph.edge")


def frames(spans: DataFrame) -> DataFrame:
    """Node and edge events; others are dropped."""
    return spans.select("event_id", kind().alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("kind IS NOT NULL")


def sequenced(events: DataFrame, subscribers: str, order: str) -> DataFrame:
    """Frames with their sequence number: it counts every event that meets a subscriber, also those that make no frame, so there are gaps.

    A running count over one stream of events; streams (runs) are told apart by `run`."""
    met = events.where(F.col(subscribers) > 0)
    running = F.count(F.lit(1)).over(Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("seq", running).withColumn("kind", kind()).where("kind IS NOT NULL")


def launch_events(events: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, refused): known types are kept, rows without a type or of another are refused."""
    known = F.coalesce(F.col("event_type").isin(*allowed), F.lit(False))
    return events.where(known), events.where(~known)


def import_stats(records: DataFrame, domain: str | None = None) -> DataFrame:
    """imported and errors of parsed records: content and a text that parsed; other domains count as neither."""
    own = F.lit(True) if domain is None else F.coalesce(F.col("domain") == domain, F.lit(False))
    good = F.coalesce(F.col("content"), F.lit("")) != ""
    return records.where(own).agg(F.count_if(good).alias("imported"), F.count_if(~good).alias("errors"))


def mining_counts(rows: DataFrame) -> DataFrame:
    """Rows and distinct entities by domain."""
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


def queue_counters(jobs: DataFrame, maxlen: int) -> DataFrame:
    """enqueued, processed, failed and dropped of a queue that holds `maxlen` jobs at most."""
    return jobs.agg(F.count(F.lit(1)).alias("enqueued"), F.count_if(F.col("status") == "done").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.greatest(F.count(F.lit(1)) - maxlen, F.lit(0)).alias("dropped"))


def stale_sessions(sessions: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """Sessions last written longer ago than that."""
    return sessions.where(F.col("updated_at") < now - hours * 3600)
