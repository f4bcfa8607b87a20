"""Enrichment: stages, extraction jobs, reindexing and evolution of stored items, as plans over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scalar import canonical_key, decay, embed, entity_id, strip

from .predicates import USER_TYPES

Transform = Callable[[DataFrame], DataFrame]


# --- stages

def classify(items: DataFrame) -> DataFrame:
    """A type for items without one, by what their text says."""
    t = F.lower(F.coalesce("content", F.lit("")))
    rule = F.when(t.rlike("\\b(decided|decision|we will)\\b"), "decision").when(t.rlike("\\b(how to|steps?|install)\\b"), "procedural").when(t.rlike("\\b(i think|believe|prefer)\\b"), "opinion").otherwise("semantic")
    return items.withColumn("memory_type", F.coalesce(F.nullif(F.col("memory_type"), F.lit("pending")), rule))


def simplify(items: DataFrame) -> DataFrame:
    """item_id, n and sentence: texts cut after full stops, question and exclamation marks and at line ends."""
    cut = F.regexp_replace(F.coalesce("content", F.lit("")), "([.!?])\\s+", "$1\n")
    parts = F.filter(F.transform(F.split(cut, "\n+"), lambda s: strip(s)), lambda s: s != "")
    return items.select("item_id", F.posexplode(parts).alias("n", "sentence"))


def constrain(entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Entities of allowed types alone; `allowed` has entity_type."""
    return entities.join(allowed.select("entity_type").distinct(), "entity_type", "left_semi")


def link(mentions: DataFrame) -> DataFrame:
    """a, b and shared: each item with the next one (by id) that shares an entity, and over how many entities.

    Items of an entity form a chain, not all their pairs, so links stay as many as mentions, and related items stay connected."""
    distinct = mentions.select("item_id", "entity").distinct()
    chain = distinct.withColumn("b", F.lead("item_id").over(Window.partitionBy("entity").orderBy("item_id")))
    return chain.where("b IS NOT NULL").groupBy(F.col("item_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))


def annotate(items: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Length, number of words, first date named, and a lexicon's balance for every item."""
    words = F.array_remove(F.split(F.lower(F.coalesce("content", F.lit(""))), "[^\\p{L}]+"), "")
    count = lambda of: F.size(F.filter("words", lambda w: w.isin(*of)))
    rows = items.withColumn("words", words)
    return rows.select("item_id", F.length(F.coalesce("content", F.lit(""))).cast("bigint").alias("n_chars"), F.size("words").cast("bigint").alias("n_words"), F.nullif(F.regexp_extract(F.coalesce("content", F.lit("")), "\\b(\\d{4}-\\d{2}-\\d{2})\\b", 1), F.lit("")).alias("named_date"), (count(positive) - count(negative)).cast("bigint").alias("balance"))


def ground(entities: DataFrame, known: DataFrame) -> DataFrame:
    """Entities with the public id of their canonical key, where a local table knows it; `known` has name, label and public_id."""
    keyed = entities.withColumn("key", canonical_key(F.col("name"), F.col("label")))
    ids = known.select(canonical_key(F.col("name"), F.col("label")).alias("key"), "public_id").groupBy("key").agg(F.min("public_id").alias("public_id"))
    return keyed.join(ids, "key", "left")


def run(items: DataFrame, stages: list[tuple[str, Transform]], start: str | None = None, stop: str | None = None) -> dict[str, DataFrame]:
    """Every stage's result by name, from `start` to `stop` (both included). Results are lazy, so going back is reading an earlier one."""
    names = [name for name, _ in stages]
    a, b = names.index(start) if start else 0, names.index(stop) if stop else len(names) - 1
    out: dict[str, DataFrame] = {}
    for name, stage in stages[a : b + 1]:
        items = stage(items)
        out[name] = items
    return out


# --- jobs

def reindexable(nodes: DataFrame) -> DataFrame:
    """item_id and text of what can be embedded: no versions, no untyped rows; the label stands in for missing content."""
    text = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("label"))
    return nodes.where("memory_type IS NOT NULL AND memory_type <> 'Version'").select("item_id", F.coalesce(text, F.lit("")).alias("text"))


def reindex(nodes: DataFrame, dims: int = 64, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """item_id and embedding of the first 512 characters of every row with text."""
    make = embedder or (lambda t: embed(t, dims))
    return reindexable(nodes).where("text <> ''").select("item_id", make(F.substring("text", 1, 512)).alias("embedding"))


def reindex_stats(nodes: DataFrame) -> DataFrame:
    return reindexable(nodes).agg(F.count_if(F.col("text") != "").alias("reindexed"), F.count_if(F.col("text") == "").alias("skipped"), F.count(F.lit(1)).alias("total"))


def extractable(items: DataFrame, least: int = 3) -> DataFrame:
    """Items of users' types with at least `least` characters of text."""
    return items.where(F.col("memory_type").isin(*USER_TYPES) & (F.length(strip(F.col("content"))) >= least))


def not_enriched(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items without entity edges of either kind yet."""
    done = edges.where("edge_type IN ('CONTAINS_ENTITY', 'MENTIONED_IN')")
    ends = done.where("edge_type = 'CONTAINS_ENTITY'").select(F.col("source_id").alias("item_id")).unionAll(done.where("edge_type = 'MENTIONED_IN'").select(F.col("target_id").alias("item_id")))
    return items.join(ends.distinct(), "item_id", "left_anti")


def found_entities(extracted: DataFrame, known: DataFrame, default_type: str = "concept", default_confidence: float = 0.85) -> DataFrame:
    """item_id, name, label, confidence, entity_id and whether it is new: an entity with a known canonical key is that one.

    `extracted` has item_id, name, label and confidence (nulls take the defaults); `known` has name, label and entity_id. Names differ
    by more than their case; of repeated ones in an item the most confident stays."""
    typed = extracted.where("coalesce(name, '') <> ''").select("item_id", "name", F.coalesce("label", F.lit(default_type)).alias("label"), F.coalesce("confidence", F.lit(default_confidence)).alias("confidence"))
    typed = typed.withColumn("key", canonical_key(F.col("name"), F.col("label")))
    one = Window.partitionBy("item_id", "key").orderBy(F.col("confidence").desc(), "name")
    typed = typed.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    ids = known.select(canonical_key(F.col("name"), F.col("label")).alias("key"), F.col("entity_id").alias("known_id")).groupBy("key").agg(F.min("known_id").alias("known_id"))
    made = entity_id(F.col("name"), F.col("label"))
    return typed.join(ids, "key", "left").select("item_id", "name", "label", "confidence", F.coalesce("known_id", made).alias("entity_id"), F.col("known_id").isNull().alias("is_new"))


def guard_ids(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Entities whose id is an item's take one of their own, so that no item is overwritten."""
    taken = items.select(F.col("item_id").alias("entity_id"), F.lit(True).alias("taken")).distinct()
    fresh = F.substring(F.sha2(F.concat(F.lit("entity "), F.col("entity_id")).cast("binary"), 256), 1, 16)
    return entities.join(taken, "entity_id", "left").withColumn("entity_id", F.when(F.col("taken"), fresh).otherwise(F.col("entity_id"))).drop("taken")


def dual_edges(entities: DataFrame) -> DataFrame:
    """Both edges between each item and its entities."""
    pairs = entities.select(F.col("item_id").alias("i"), F.col("entity_id").alias("e")).distinct()
    return pairs.select(F.col("i").alias("source_id"), F.col("e").alias("target_id"), F.lit("CONTAINS_ENTITY").alias("edge_type")).unionAll(pairs.select("e", "i", F.lit("MENTIONED_IN")))


def enrich_job(jobs: DataFrame, items: DataFrame, edges: DataFrame, known: DataFrame, extractor: Transform) -> dict[str, DataFrame]:
    """One round of the enrichment job: nodes and edges to add, and what became of each job.

    `extractor` maps items (item_id, content) to item_id, name, label, confidence. Items that are gone, blank or already enriched
    count as processed. Reading current items at write time keeps what changed meanwhile."""
    asked = jobs.where("status = 'pending'").select("id", "item_id")
    able = not_enriched(extractable(items).join(asked.select("item_id").distinct(), "item_id", "left_semi"), edges)
    found = guard_ids(found_entities(extractor(able.select("item_id", "content")), known), items)
    current = found.join(items.select("item_id"), "item_id", "left_semi")
    nodes = current.where("is_new").groupBy("entity_id").agg(F.min_by("name", F.struct("name", "item_id")).alias("name"), F.min("label").alias("label"), F.max("confidence").alias("confidence"))
    return {"nodes": nodes, "edges": dual_edges(current), "done": asked.select("id", F.lit("done").alias("status")), "extracted": able.select("item_id")}


def job_stats(items: DataFrame, able: DataFrame, found: DataFrame) -> DataFrame:
    """extracted, entities_created, skipped and total of a round."""
    of = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))  # noqa: E731  one row each
    made = found.where("is_new").select("entity_id").distinct()
    return of(able, "extracted").crossJoin(of(made, "entities_created")).crossJoin(of(items, "total")).withColumn("skipped", F.col("total") - F.col("extracted"))


# --- evolution

def promoted(items: DataFrame, old: str, new: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows of the new type, edges that say what they supersede) for confident items of the old type."""
    ripe = items.where((F.col("memory_type") == old) & (F.coalesce("confidence", F.lit(1.0)) >= least))
    rows = ripe.select(F.concat(F.lit(f"{new}:"), "item_id").alias("item_id"), "content", F.lit(new).alias("memory_type"), "confidence", F.col("item_id").alias("from_id"))
    return rows.drop("from_id"), rows.select(F.col("item_id").alias("source_id"), F.col("from_id").alias("target_id"), F.lit("SUPERSEDES").alias("edge_type"))


def decided(items: DataFrame, now: int, half_life: float, floor: float) -> DataFrame:
    """Decisions with their confidence decayed, and whether they are withdrawn."""
    c = F.round(decay(F.coalesce("confidence", F.lit(1.0)), F.lit(now) - F.col("created_seq"), half_life), 6)
    return items.where("memory_type = 'decision'").select("item_id", c.alias("confidence"), (c < floor).alias("retracted"))


def synthesis(items: DataFrame, by: str, kind: str) -> DataFrame:
    """One row for each subject with items of the kind: how many, mean confidence, the strongest."""
    of = items.where(F.col("memory_type") == kind).groupBy(by)
    return of.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 6).alias("confidence"), F.max_by("item_id", F.struct(F.coalesce("confidence", F.lit(1.0)), "created_seq")).alias("strongest"))


def reinforced(items: DataFrame, retrievals: DataFrame, step: float, most: float = 1.0) -> DataFrame:
    """Confidence raised by `step` for each retrieval, up to `most`; `retrievals` has one row each, with item_id."""
    n = retrievals.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.least(F.lit(most), F.coalesce("confidence", F.lit(1.0)) + step * F.coalesce("n", F.lit(0)))
    return items.join(n, "item_id", "left").select("item_id", F.round(c, 6).alias("confidence"))


def outdated(items: DataFrame, references: DataFrame, commits: DataFrame) -> DataFrame:
    """Items that refer to a path changed since the commit they saw; `references` has item_id, path, seen, `commits` path, changed."""
    last = commits.groupBy("path").agg(F.max("changed").alias("changed"))
    moved = references.join(last, "path").where("changed > seen").select("item_id").distinct()
    return items.select("item_id").join(moved.withColumn("stale", F.lit(True)), "item_id", "left").select("item_id", F.coalesce("stale", F.lit(False)).alias("stale"))


def consolidated(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id and dominant: of two items that interfere, the more confident (then the older) stands for the other. `pairs` has a and b."""
    c = items.select("item_id", F.coalesce("confidence", F.lit(1.0)).alias("c"), "created_seq")
    both = pairs.join(c.toDF("a", "ca", "sa"), "a").join(c.toDF("b", "cb", "sb"), "b")
    first = (F.col("ca") > F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("sa") <= F.col("sb")))
    won = both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("item_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("dominant"), F.greatest("ca", "cb").alias("c"))
    return won.groupBy("item_id").agg(F.max_by("dominant", F.struct("c", "dominant")).alias("dominant"))


def routed(items: DataFrame) -> DataFrame:
    """Pending items by what they are: pairs of turns are episodic, instructions procedural, the rest semantic."""
    t = F.coalesce("content", F.lit(""))
    kind = F.when(t.startswith("User: "), "episodic").when(F.lower(t).rlike("\\b(step|install|run|how to)\\b"), "procedural").otherwise("semantic")
    return items.where("memory_type = 'pending'").select("item_id", kind.alias("memory_type"))


def strengthened(weights: DataFrame, together: DataFrame, rate: float = 0.1, most: float = 1.0) -> DataFrame:
    """Weights of pairs after co-retrievals: each adds a share of what is left up to `most`; `together` has a, b, weight (times)."""
    old = weights.select("a", "b", F.col("weight").alias("old"))
    grown = F.lit(most) - (F.lit(most) - F.coalesce("old", F.lit(0.0))) * F.pow(F.lit(1.0 - rate), F.coalesce(F.col("weight"), F.lit(0)))
    return old.join(together, ["a", "b"], "full").select("a", "b", F.round(grown, 6).alias("weight"))


def clusters(edges: DataFrame) -> DataFrame:
    """item_id and cluster (least id reachable) of every end of an edge: least labels spread and jump until nothing changes."""
    from recollect.sources.tables import written

    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a <> b").distinct()
    both = written(both.unionAll(both.select("b", "a")).distinct())
    labels = written(both.select(F.col("a").alias("item_id")).distinct().withColumn("cluster", F.col("item_id")))
    while True:
        near = both.join(labels, both["b"] == labels["item_id"]).groupBy(F.col("a").alias("item_id")).agg(F.min("cluster").alias("near"))
        least = labels.join(near, "item_id").select("item_id", "cluster", F.least("cluster", "near").alias("least"))
        up = labels.select(F.col("item_id").alias("least"), F.col("cluster").alias("top"))
        nexts = written(least.join(up, "least").select("item_id", F.least("least", "top").alias("next"), "cluster"))
        if nexts.where("next <> cluster").limit(1).count() == 0:
            return labels
        labels = nexts.select("item_id", F.col("next").alias("cluster"))
