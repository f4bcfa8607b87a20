"""Entity patterns: fold, gate, seed sync and gazetteer matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scalar import canonical_key, entity_id


def fold(log: DataFrame) -> DataFrame:
    """Save events to patterns: first event's count, then one a save; greatest confidence; first name, label and source."""
    first = lambda c: F.min_by(c, "seq")
    return log.groupBy(F.lower("name").alias("key")).agg(
        first("name").alias("name"), first("label").alias("label"), first("source").alias("source"), F.max("confidence").alias("confidence"), (first("cnt") + F.count(F.lit(1)) - 1).cast("bigint").alias("frequency")
    )


def active(patterns: DataFrame, least: int = 2) -> DataFrame:
    return patterns.where(F.coalesce(F.col("frequency"), F.lit(1)) >= least)


def quality(patterns: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    return patterns.where((F.length("name") >= 2) & ~F.lower("name").isin(*blocked)) if blocked else patterns.where(F.length("name") >= 2)


def new_seeds(seeds: DataFrame, store: DataFrame) -> DataFrame:
    """Seeds whose folded name the store lacks; the first in order wins."""
    w = Window.partitionBy(F.lower("name")).orderBy("seq")
    firsts = seeds.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return firsts.join(store.select(F.lower("name").alias("_k")).distinct(), F.lower(firsts["name"]) == F.col("_k"), "left_anti")


def gazetteer(texts: DataFrame, least: int = 5) -> DataFrame:
    """name, frequency and label from the letter tokens of reference texts."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("name")).where(F.length("name") >= least)
    label = F.element_at(F.array(F.lit("CONCEPT"), F.lit("TOOL"), F.lit("PERSON"), F.lit("PLACE")), (F.length("name") % 4 + 1).cast("int"))
    return words.groupBy("name").agg(F.count(F.lit(1)).cast("bigint").alias("frequency")).withColumn("label", label)


def match(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (id, name, label) of gazetteer names among a text's tokens: an equi-join whose strategy Catalyst picks."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]+"), 0))
    return docs.select(id_col, F.explode(tokens).alias("name")).join(patterns.select("name", "label"), "name").select(id_col, "name", "label")


def entity_edges(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Both edges of every match."""
    item, entity = F.concat(F.lit("doc-"), F.col(id_col).cast("string")), entity_id(F.col("name"), F.col("label"))
    pairs = matches.select(item.alias("item"), entity.alias("entity"))
    return pairs.select(F.col("item").alias("source_id"), F.col("entity").alias("target_id"), F.lit("CONTAINS_ENTITY").alias("edge_type")).unionByName(
        pairs.select(F.col("entity").alias("source_id"), F.col("item").alias("target_id"), F.lit("MENTIONED_IN").alias("edge_type"))
    )


def keyed(patterns: DataFrame) -> DataFrame:
    return patterns.select("name", "label", canonical_key(F.col("name"), F.col("label")).alias("canonical_key"), entity_id(F.col("name"), F.col("label")).alias("entity_id"))


def without_pattern(store: DataFrame, name: str, label: str) -> DataFrame:
    """The store without the pattern of that name, if its label is the same too."""
    return store.where(~((F.lower("name") == name.lower()) & (F.col("label") == label)))


def manifest_changes(applied: DataFrame, bundled: DataFrame) -> DataFrame:
    """Files of the bundled manifest that are new or whose checksum differs; both have file and checksum."""
    old = applied.select("file", F.col("checksum").alias("was"))
    return bundled.join(old, "file", "left").where(~F.col("checksum").eqNullSafe(F.col("was"))).select("file", F.when(F.col("was").isNull(), "new").otherwise("changed").alias("change"))


def sync_seeds(store: DataFrame, seeds: DataFrame, changes: DataFrame) -> DataFrame:
    """The store and the seeds of changed files that it lacks: what is there is never overwritten. `seeds` has file and seq too."""
    added = new_seeds(seeds.join(changes.select("file"), "file", "left_semi"), store)
    names = ["name", "label", "confidence", "frequency", "source"]
    return store.select(names).unionByName(added.select(names))


def generated(entries: DataFrame) -> DataFrame:
    """Seed patterns from ordered categories: of equal names the first stays; primary names are surer than aliases.

    `entries` has category_no, place, is_alias, name and label; case matters here."""
    first = Window.partitionBy("name").orderBy("category_no", "place", "is_alias")
    kept = entries.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("name", "label", F.when(F.col("is_alias"), 0.95).otherwise(0.99).alias("confidence"), F.lit(2).alias("frequency"))


def counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
