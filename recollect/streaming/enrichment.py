"""Two-tier ingest and event fan-out as streams: rows are stored at once, a query over the log enriches them later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recollect.operators import enrich

Read = Callable[[], DataFrame]


def worker(jobs: DataFrame, out: str, items: Read, edges: Read, known: Read, extractor: enrich.Transform, checkpoint: str, poll: str | None = None) -> DataStreamWriter:
    """A stream of jobs that writes nodes, edges and finished jobs below `out`; without `poll` it drains what waits and ends.

    Each batch reads current items and edges, so items that were enriched or changed meanwhile are seen; one that fails goes to
    the dead letters of its jobs and the stream goes on. Batches are written under their number: a replay overwrites its own."""

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.where("status = 'pending'").dropDuplicates(["item_id"])
        try:
            found = enrich.enrich_job(batch, items(), edges(), known(), extractor)
            for part in ("nodes", "edges", "done"):
                found[part].write.mode("overwrite").parquet(f"{out}/{part}/batch={n}")
        except Exception as error:
            batch.select("id", F.lit("failed").alias("status"), F.lit(str(error)[:500]).alias("error")).write.mode("overwrite").parquet(f"{out}/failed/batch={n}")

    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)


def broadcast(events: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, poll: str | None = None) -> DataStreamWriter:
    """One query that hands every batch to all sinks; a sink that fails does not keep it from the others."""

    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        for sink in sinks:
            try:
                sink(batch, n)
            except Exception as error:
                print(f"sink {sink!r} failed on batch {n}: {error}")
        batch.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)


def evolution(items: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A cycle of background evolution: each step maps items to items."""
    for step in steps:
        items = step(items)
    return items
