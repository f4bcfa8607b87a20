"""Append-only mutation logs folded into current views (in place of an in-place merge)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """(item_id, k, v) after the last put, replace or delete and the merges that follow it; deleted items are gone.

    `log` has item_id, tx_seq, op (put, replace, merge, delete), k and v. `as_of` reads an earlier state."""
    seen = log if as_of is None else log.where(F.col("tx_seq") <= as_of)
    w = Window.partitionBy("item_id")
    base = F.max(F.when(F.col("op") != "merge", F.col("tx_seq"))).over(w)
    base_op = F.max_by(F.when(F.col("op") != "merge", F.col("op")), F.when(F.col("op") != "merge", F.col("tx_seq"))).over(w)
    live = seen.withColumn("base", base).withColumn("base_op", base_op)
    live = live.where(F.col("base").isNull() | ((F.col("tx_seq") >= F.col("base")) & (F.col("op") != "delete")))
    live = live.where(F.col("base_op").isNull() | (F.col("base_op") != "delete") | (F.col("op") == "merge"))
    # merging into a deleted item does not bring it back
    live = live.where(~F.col("base_op").eqNullSafe("delete"))
    return live.groupBy("item_id", "k").agg(F.max_by("v", "tx_seq").alias("v"))


def deleted(log: DataFrame) -> DataFrame:
    last = log.where("op <> 'merge'").groupBy("item_id").agg(F.max_by("op", "tx_seq").alias("op"))
    return last.where("op = 'delete'").select("item_id")
