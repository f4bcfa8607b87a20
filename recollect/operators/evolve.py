"""Evolution of stored items: decay, pruning, co-retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scalar import decay


def decayed(items: DataFrame, now: int, half_life: float, floor: float) -> DataFrame:
    c = decay(F.col("confidence"), F.lit(now) - F.col("created_seq"), half_life)
    return items.select("item_id", F.round(c, 6).alias("confidence"), (c < floor).alias("archived"))


def pruned(items: DataFrame) -> DataFrame:
    """Of equal contents the most confident stays (then the oldest)."""
    # items without content are nobody's copies, each its own group
    w = Window.partitionBy(F.coalesce(F.sha1("content"), F.concat(F.lit("item "), "item_id"))).orderBy(F.col("confidence").desc(), "created_seq")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("item_id", "confidence")


def together(events: DataFrame, bucket: str, item: str, block: int = 256) -> DataFrame:
    """How often two items were retrieved together. Equal item sets are paired once, and large ones in pairs of blocks dealt over tasks."""
    sets = events.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.sort_array(F.collect_set(item)).alias("items"))
    sets = sets.where(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("weight"))
    last = F.floor((F.size("items") - 1) / F.lit(block)).cast("int")
    part = lambda k: F.slice("items", k * block + 1, block)
    left = sets.select("items", "weight", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = left.select("items", "weight", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
    dealt = both.select("weight", part(F.col("i")).alias("left"), part(F.col("j")).alias("right")).repartition("left", "right")
    pairs = dealt.select("weight", "right", F.explode("left").alias("a")).select("weight", "a", F.explode("right").alias("b"))
    return pairs.where("a < b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
