"""Projections of stored nodes, results, jobs and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scalar import markers

# Fields that views hoist, fields that a wildcard row leaves out of its metadata, and names that callers cannot overwrite.
HOISTED = ("label", "content", "memory_type", "category", "confidence", "created_at", "node_category", "entity_type")
NOT_METADATA = ("content", "label", "memory_type", "node_category", "entity_type", "embedding", "category", "confidence", "stale", "reference")
RESERVED = ("memory_type", "node_category", "item_id", "content", "embedding", "created_at", "valid_from", "valid_to")


def _property(name: str, props: str = "props") -> Column:
    return F.try_element_at(F.col(props), F.lit(name))


def without(props: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(*names))


def flatten(nodes: DataFrame) -> DataFrame:
    """item_id, the hoisted fields with their defaults, and metadata; `nodes` has item_id, memory_type, created_at and props (map)."""
    return nodes.select(
        F.coalesce("item_id", F.lit("")).alias("item_id"), F.coalesce("memory_type", _property("memory_type"), F.lit("semantic")).alias("memory_type"), F.coalesce("created_at", _property("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(_property("label"), F.lit("")).alias("label"), F.coalesce(_property("content"), F.lit("")).alias("content"), _property("category").alias("category"), _property("node_category").alias("node_category"),
        _property("entity_type").alias("entity_type"), F.coalesce(_property("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"), without(F.col("props"), HOISTED).alias("metadata"),
    )


def wildcard_rows(nodes: DataFrame) -> DataFrame:
    """Rows of a wildcard search: content falls back to the label only where there is no content at all; metadata is null when empty."""
    rest = without(F.col("props"), NOT_METADATA)
    flag = lambda c: F.coalesce(_property(c).try_cast("boolean"), F.lit(False)).alias(c)
    return nodes.select(
        "item_id", F.when(F.map_contains_key("props", F.lit("content")), _property("content")).otherwise(F.coalesce(_property("label"), F.lit(""))).alias("content"),
        F.coalesce(F.nullif(F.col("memory_type"), F.lit("")), _property("memory_type"), F.lit("")).alias("memory_type"), F.coalesce("created_at", _property("created_at"), F.lit("")).alias("created_at"),
        F.coalesce(_property("confidence").try_cast("double"), F.lit(1.0)).alias("confidence"), flag("stale"), flag("reference"), F.when(F.size(F.map_keys(rest)) > 0, rest).alias("metadata"),
    )


def recall_shape(rows: DataFrame) -> DataFrame:
    """The seven fields that recall reads, from rows that name their id item_id or id and may lack any of the rest."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in have), F.lit(None))
    given = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    return rows.select(first("item_id", "id").alias("item_id"), given("memory_type", F.lit("?")).alias("memory_type"), given("content", F.lit("")).alias("content"), given("origin", F.lit("")).alias("origin"), given("confidence", F.lit(1.0)).alias("confidence"), given("stale", F.lit(False)).alias("stale"))


def accepted(props: Column) -> Column:
    """Properties of a caller, without the reserved names."""
    return without(props, RESERVED)


def workspace(own: Column, explicit: Column, derived: Column) -> Column:
    """A caller's own property, then the explicit or configured workspace, then the folder's."""
    return F.coalesce(own, F.nullif(explicit, F.lit("")), derived)


def result_id(result: Column) -> Column:
    """The item id of an ingest result, which is an id or JSON with an item_id; the text itself where there is none."""
    return F.coalesce(F.nullif(F.get_json_object(result, "$.item_id"), F.lit("")), result)


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs as workers read them: entity ids decoded (none for blank ones), workspace never null."""
    ids = F.coalesce(F.from_json(F.nullif(F.col("entity_ids"), F.lit("")), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    return jobs.select("id", "item_id", ids.alias("entity_ids"), F.coalesce("workspace_id", F.lit("")).alias("workspace_id"), "enqueued_at")


def search_line() -> Column:
    """A line of search results: markers, type, first eight characters of the id, text."""
    return F.concat(markers(F.col("stale"), F.col("confidence")), F.lit("["), F.coalesce("memory_type", F.lit("?")), F.lit("] "), F.substring("item_id", 1, 8), F.lit("  "), F.substring(F.coalesce("content", F.lit("")), 1, 200))


def health(nodes: DataFrame, jobs: DataFrame, statuses: tuple[str, ...], mode: str = "local") -> DataFrame:
    """One row: status, items that are no versions, the queue by status, mode."""
    counted = nodes.agg(F.count_if(~F.col("memory_type").eqNullSafe("Version")).alias("memory_count"))
    queue = jobs.agg(F.struct(*(F.count_if(F.col("status") == s).alias(s) for s in statuses)).alias("queue"))
    return counted.select(F.lit("ok").alias("status"), "memory_count", F.lit(mode).alias("mode")).crossJoin(queue)  # one row each


def list_total(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("total"))
