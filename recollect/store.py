"""The engine as one object: an append-only log of mutations in Parquet folders, read as folded views."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import enrich, graph, ingest, mutations, patterns, project, queue, recall, search

LOG = "item_id string, tx_seq bigint, op string, k string, v string"
EDGES = "source_id string, target_id string, edge_type string"
JOBS = "id bigint, item_id string, entity_ids map<string,string>, enqueued_at bigint, at bigint, status string"
PATTERNS = "seq bigint, name string, label string, confidence double, cnt int, source string"


class Store:
    """Items, edges, jobs and patterns below one folder of any file system that Spark knows. Writes append; reads are lazy plans."""

    def __init__(self, spark: SparkSession, path: str, extractor: enrich.Transform | None = None):
        self.spark, self.path, self.extractor = spark, path.rstrip("/"), extractor

    # --- storage

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, part: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{part}")

    def _next(self) -> int:
        return (self._read("log", LOG).agg(F.max("tx_seq")).first()[0] or 0) + 1

    def properties(self, as_of: int | None = None) -> DataFrame:
        """item_id and props (map) of live items, now or as of an earlier write."""
        rows = mutations.fold(self._read("log", LOG), as_of)
        return rows.where("k IS NOT NULL").groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))

    def nodes(self) -> DataFrame:
        own = lambda k: F.try_element_at("props", F.lit(k))
        return self.properties().select("item_id", own("memory_type").alias("memory_type"), own("created_at").alias("created_at"), "props")

    def items(self) -> DataFrame:
        """Live items with the columns that search and recall read."""
        own = lambda k: F.try_element_at("props", F.lit(k))
        return self.nodes().select(
            "item_id", "memory_type", own("content").alias("content"), own("node_category").alias("node_category"), own("origin").alias("origin"), own("workspace_id").alias("workspace_id"), own("confidence").try_cast("double").alias("confidence"),
            F.coalesce(own("stale").try_cast("boolean"), F.lit(False)).alias("stale"), F.coalesce(own("reference").try_cast("boolean"), F.lit(False)).alias("reference"), own("seq").try_cast("bigint").alias("created_seq"), "created_at", "props",
        )

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES).distinct()

    # --- writing

    def ingest(self, rows: DataFrame, default_type: str = "episodic", sync: bool = True, now: int = 0) -> DataFrame:
        """Store rows (item_id, content, memory_type, props). Not `sync`: enrichment is queued instead of run. Returns their ids."""
        at = self._next()
        stamped = rows.withColumn("tx_seq", F.lit(at).cast("bigint")).withColumn("props", F.map_concat(F.coalesce("props", F.from_json(F.lit("{}"), "map<string,string>")), F.create_map(F.lit("seq"), F.lit(str(at)))))
        self._append("log", ingest.put_rows(stamped, default_type))
        if sync:
            self.enrich(rows.select("item_id"), now)
        else:
            jobs = ingest.enqueue(rows.select("item_id", F.lit(now).cast("bigint").alias("enqueued_at"), F.from_json(F.lit("{}"), "map<string,string>").alias("entity_ids")), self.jobs())
            self._append("jobs", jobs.select(F.xxhash64("item_id", "enqueued_at").alias("id"), "item_id", "entity_ids", "enqueued_at", F.lit(now).cast("bigint").alias("at"), "status"))
        return rows.select("item_id")

    def add(self, rows: DataFrame, default_type: str = "semantic") -> DataFrame:
        """Store rows and nothing else."""
        at = self._next()
        self._append("log", ingest.put_rows(rows.withColumn("tx_seq", F.lit(at).cast("bigint")), default_type))
        return rows.select("item_id")

    def update(self, requests: DataFrame, mode: str = "merge") -> DataFrame:
        """Write property updates; returns the ids that are not there."""
        rows, refused = ingest.patch_rows(requests.withColumn("tx_seq", F.lit(self._next()).cast("bigint")), self.properties(), mode)
        self._append("log", rows)
        return refused

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete items; returns the ids that are not there."""
        rows, unknown = ingest.delete_rows(ids.withColumn("tx_seq", F.lit(self._next()).cast("bigint")), self.properties())
        self._append("log", rows)
        return unknown

    def clear(self) -> None:
        """Empty every part by writing it anew."""
        for part, schema in (("log", LOG), ("edges", EDGES), ("jobs", JOBS), ("patterns", PATTERNS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{part}")

    def delete_run(self, run_id: str) -> int:
        gone = ingest.delete_run(self.items().withColumn("run_id", F.try_element_at("props", F.lit("run_id"))), run_id).select("item_id")
        count = gone.count()
        self.delete(gone)
        return count

    # --- reading

    def get(self, item_id: str) -> dict[str, Any]:
        """One item's properties; empty where there is none."""
        found = self.properties().where(F.col("item_id") == item_id).limit(1).collect()
        return {"item_id": item_id, **found[0]["props"]} if found else {}

    def search(self, query: str, top_k: int = 5, **options: Any) -> DataFrame:
        return search.search(self.items(), query, top_k, **options)

    def recall(self, top_k: int = 10, **options: Any) -> DataFrame:
        return recall.recall_block(self.items(), top_k, **options)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a snapshot."""
        nodes = self.nodes()
        return project.flatten(nodes), graph.snapshot_edges(nodes, self.edges())

    def list(self, limit: int = 200, offset: int = 0) -> tuple[DataFrame, int]:
        nodes = self.nodes()
        return graph.page(project.flatten(nodes), limit, offset), nodes.count()

    def neighbours(self, item_id: str) -> DataFrame:
        return graph.neighbours(self.edges(), item_id)

    def health(self) -> DataFrame:
        return project.health(self.nodes(), self.jobs(), queue.STATUSES)

    # --- queue, enrichment, patterns

    def jobs(self) -> DataFrame:
        log = self._read("jobs", JOBS)
        first = log.groupBy("id").agg(F.min_by("item_id", "at").alias("item_id"), F.min("enqueued_at").alias("enqueued_at"), F.min_by("entity_ids", "at").alias("entity_ids"))
        return first.join(ingest.fold_jobs(log), "id")

    def save_pattern(self, rows: DataFrame) -> None:
        """Append pattern saves (seq, name, label, confidence, cnt, source)."""
        self._append("patterns", rows)

    def patterns(self) -> DataFrame:
        return patterns.fold(self._read("patterns", PATTERNS))

    def enrich(self, ids: DataFrame, now: int = 0, extractor: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Extract entities of these items at once; returns how many items had text. Without an extractor nothing is done."""
        make = extractor or self.extractor
        if make is None:
            return 0
        jobs = ids.select(F.xxhash64("item_id").alias("id"), "item_id", F.lit("pending").alias("status"))
        known = self.nodes().where("memory_type = 'entity'").select(F.try_element_at("props", F.lit("label")).alias("name"), F.try_element_at("props", F.lit("entity_type")).alias("label"), F.col("item_id").alias("entity_id"))
        own = self.items().where("coalesce(memory_type, '') <> 'entity'")  # an entity may keep its own id
        found = enrich.enrich_job(jobs, own, self.edges(), known, make)
        from recollect.sources.tables import written

        nodes, edges, done = written(found["nodes"]), written(found["edges"]), found["extracted"].count()
        at = self._next()
        props = F.create_map(F.lit("label"), F.col("name"), F.lit("entity_type"), F.col("label"), F.lit("node_category"), F.lit("entity"), F.lit("confidence"), F.col("confidence").cast("string"))
        rows = nodes.select(F.col("entity_id").alias("item_id"), F.map_concat(props, F.create_map(F.lit("content"), F.col("name"), F.lit("memory_type"), F.lit("entity"))).alias("props"))
        self._append("log", rows.select("item_id", F.lit(at).cast("bigint").alias("tx_seq"), F.lit("put").alias("op"), F.explode("props").alias("k", "v")))
        self._append("edges", edges)
        return done

    def drain(self, now: int, n: int = 100) -> int:
        """Claim up to `n` waiting jobs, enrich their items, and mark the jobs done; a failure marks them failed and is raised."""
        from recollect.sources.tables import written

        claimed = written(queue.claim(self.jobs(), n))
        mark = lambda s: self._append("jobs", claimed.select("id", "item_id", "entity_ids", "enqueued_at", F.lit(now).cast("bigint").alias("at"), F.lit(s).alias("status")))
        mark("processing")
        try:
            done = self.enrich(claimed, now)
        except Exception:
            mark("failed")
            raise
        mark("done")
        return done

    def reindex(self, dims: int = 64) -> DataFrame:
        """Rewrite all vectors; returns the counts."""
        rows = self.items().withColumn("label", F.try_element_at("props", F.lit("label")))
        enrich.reindex(rows, dims).write.mode("overwrite").parquet(f"{self.path}/vectors")
        return enrich.reindex_stats(rows)

    def evolve(self, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
        from recollect.streaming.enrichment import evolution

        return evolution(self.items(), steps)


def sync_remote(token: str | None = None) -> None:
    """Nothing without a token; there is no remote service to talk to with one."""
    if token:
        raise NotImplementedError("no remote store")
