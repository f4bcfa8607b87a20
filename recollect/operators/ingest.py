"""What callers write: rows of the mutation log, queue events and typed captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import USER_TYPES
from .project import accepted

NO_PROPS = "map<string,string>"


def _none() -> Column:
    return F.from_json(F.lit("{}"), NO_PROPS)


def put_rows(items: DataFrame, default_type: str = "episodic") -> DataFrame:
    """Log rows (item_id, tx_seq, op, k, v) that store items: content, type and the caller's properties, reserved names left out.

    `items` has item_id, tx_seq, content, memory_type (null: the default) and props (map, may be null)."""
    fixed = F.create_map(F.lit("content"), F.coalesce("content", F.lit("")), F.lit("memory_type"), F.coalesce("memory_type", F.lit(default_type)))
    every = F.map_concat(fixed, F.coalesce(accepted(F.col("props")), _none()))
    return items.select("item_id", "tx_seq", F.lit("put").alias("op"), F.explode(every).alias("k", "v"))


def patch_rows(requests: DataFrame, stored: DataFrame, mode: str = "merge") -> tuple[DataFrame, DataFrame]:
    """(log rows, refused ids) of property updates: properties win over content, which wins over metadata; unknown ids are refused.

    `requests` has item_id, tx_seq, content, metadata and properties (maps, may be null); `mode` is merge or replace."""
    if mode not in ("merge", "replace"):
        raise ValueError(f"no such write mode: {mode}")
    own = F.coalesce("properties", _none())
    text = F.when(F.col("content").isNotNull(), F.create_map(F.lit("content"), F.col("content"))).otherwise(_none())
    lesser = lambda m, than: F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(than), k))
    upper = F.map_concat(own, lesser(text, own))
    every = F.map_concat(upper, lesser(F.coalesce("metadata", _none()), upper))
    known = stored.select("item_id").distinct()
    rows = requests.join(known, "item_id", "left_semi").select("item_id", "tx_seq", F.lit(mode).alias("op"), F.explode(every).alias("k", "v"))
    return rows, requests.join(known, "item_id", "left_anti").select("item_id").distinct()


def delete_rows(ids: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones, unknown ids); `ids` has item_id and tx_seq. Entity nodes are refused before, by `refuse_entities`."""
    known = stored.select("item_id").distinct()
    return ids.join(known, "item_id", "left_semi").select("item_id", "tx_seq", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v")), ids.join(known, "item_id", "left_anti").select("item_id")


def refuse_entities(*_: object) -> None:
    """Entity nodes cannot be deleted one by one."""
    raise NotImplementedError("entity nodes are not deleted by id")


def latest_vectors(log: DataFrame) -> DataFrame:
    """The current vector of each item: a later write replaces an earlier one."""
    return log.groupBy("item_id").agg(F.max_by("embedding", "tx_seq").alias("embedding"), F.max("tx_seq").alias("tx_seq"))


def live_vectors(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors without those of deleted items."""
    return vectors.join(gone.select("item_id"), "item_id", "left_anti")


def enqueue(ingested: DataFrame, jobs: DataFrame) -> DataFrame:
    """New pending jobs: one an item, entity names in lower case, none for items that already wait or run.

    `ingested` has item_id, enqueued_at and entity_ids (map of names)."""
    waiting = jobs.where(F.col("status").isin("pending", "processing")).select("item_id")
    lower = F.map_from_entries(F.transform(F.map_entries(F.coalesce("entity_ids", _none())), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    first = ingested.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("enqueued_at"))).where("n = 1")
    return first.join(waiting, "item_id", "left_anti").select("item_id", "enqueued_at", lower.alias("entity_ids"), F.lit("pending").alias("status"))


def fold_jobs(log: DataFrame) -> DataFrame:
    """Current status of jobs from their events; an event cannot take a finished job back. `log` has id, at, status."""
    order = {"pending": 0, "processing": 1, "failed": 2, "done": 3}
    stage = F.coalesce(*(F.when(F.col("status") == s, F.lit(n)) for s, n in order.items()))
    return log.where(stage.isNotNull()).groupBy("id").agg(F.max_by("status", F.struct(stage, F.col("at"))).alias("status"), F.max("at").alias("at"))


def retag_rows(items: DataFrame, needle: str, origin: str, limit: int, tx_seq: int) -> DataFrame:
    """Log rows that set the origin of the first `limit` items that mention `needle` (0: of all)."""
    from .predicates import mentions

    found = items.where(mentions(needle)).orderBy("item_id")
    return (found.limit(limit) if limit else found).select("item_id", F.lit(tx_seq).cast("bigint").alias("tx_seq"), F.lit("merge").alias("op"), F.lit("origin").alias("k"), F.lit(origin).alias("v"))


def typed(items: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Captures of one kind (decision, constraint, learned, opinion) as items: content, type, and the named columns as properties."""
    if kind not in ("decision", "constraint", "learned", "opinion"):
        raise ValueError(f"no such capture: {kind}")
    pairs = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in fields)), lambda e: e["v"].isNotNull()))
    return items.select("item_id", "tx_seq", "content", F.lit(kind).alias("memory_type"), pairs.alias("props"))


def delete_run(items: DataFrame, run_id: str) -> DataFrame:
    """Tombstones of all items of a run; their number is the count reported."""
    return items.where(F.col("run_id") == run_id).select("item_id", F.lit("delete").alias("op"))


def merge_types(nodes: DataFrame, old: list[str], new: str) -> DataFrame:
    """Nodes with the old entity types renamed, and whether each changed; renaming is merging one."""
    hit = F.coalesce(F.col("entity_type").isin(*old), F.lit(False))
    return nodes.withColumns({"entity_type": F.when(hit, F.lit(new)).otherwise(F.col("entity_type")), "changed": hit})


def folder_type(default: str = "episodic") -> Column:
    """The type that a request's context names, else its own, else the default; unknown types are refused by `valid_type`."""
    return F.coalesce("context_type", "memory_type", F.lit(default))


def valid_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*USER_TYPES), F.lit(False))
