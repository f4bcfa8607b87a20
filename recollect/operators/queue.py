"""Enrichment queue: status counts, claims, cleanup, overflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "done", "failed")


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def claim(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("enqueued_at", "id").limit(n)


def cleanup(jobs: DataFrame, before: int) -> DataFrame:
    """What stays once jobs done before the cutoff are gone."""
    return jobs.where(~((F.col("status") == "done") & (F.col("enqueued_at") < before)))


def first_jobs(jobs: DataFrame) -> DataFrame:
    """One job an item: the earliest."""
    return jobs.groupBy("item_id").agg(F.min_by("id", F.struct("enqueued_at", "id")).alias("id"))


def overflow(jobs: DataFrame, maxlen: int) -> DataFrame:
    """A bounded queue that drops its oldest: the newest `maxlen` jobs."""
    return jobs.orderBy(F.col("enqueued_at").desc(), F.col("id").desc()).limit(maxlen)
