"""Recall: candidates, ordered first-wins dedup, caps and rendered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.scalar import body_key, estimate_tokens, fresh, markers, strip

from . import predicates as P
from .search import bm25


#: The greatest top_k.
WIDEST = 200


def split_counts(top_k: int) -> tuple[int, int]:
    """(recent, semantic) shares of a recall; at least one row is recent."""
    asked = max(1, top_k)
    recent_k = max(1, (asked + 1) // 2)
    return recent_k, asked - recent_k


def split_columns(top_k: Column) -> tuple[Column, Column]:
    """The same shares for a column of limits."""
    asked = F.greatest(F.lit(1), top_k)
    recent_k = F.greatest(F.lit(1), F.floor((asked + 1) / 2).cast("int"))
    return recent_k, F.greatest(F.lit(0), asked - recent_k)


def scoped(items: DataFrame, workspace: str | None = None, strict: bool = False, floor: float = 0.3) -> DataFrame:
    return items.where(P.in_tiers() & P.in_workspace(workspace, strict) & P.confident(floor) & P.not_reference() & ~F.col("memory_type").eqNullSafe("snapshot") & (strip(F.col("content")) != ""))


def recent(items: DataFrame, k: int) -> DataFrame:
    """The newest k rows with their rank: a top-k, not a global sort."""
    return items.orderBy(F.col("created_seq").desc_nulls_last(), "item_id").limit(k)


def distinct_bodies(items: DataFrame) -> DataFrame:
    """First wins by (type, folded opening of the body), newest first; exact where item_id is unique."""
    w = Window.partitionBy("memory_type", body_key(strip(F.col("content")))).orderBy(F.col("created_seq").desc_nulls_last(), "item_id")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordered_dedup(candidates: DataFrame, top_k: int, rank: str = "rank") -> DataFrame:
    """The exact two-key scan for candidates whose ids repeat: only survivors register their id and body; ends after `top_k`.

    A fold over the ranked candidates. They are few: a recall asks for at most `WIDEST` of each channel, and more is refused."""
    names = candidates.columns
    body = F.lower(F.substring(strip(F.col("content")), 1, 120))
    typed = F.coalesce(F.nullif(F.col("memory_type"), F.lit("")), F.lit("?"))
    ranked = candidates.select(F.struct(F.col(rank).cast("bigint").alias("at"), F.struct(*names).alias("row"), F.col("item_id").alias("id"), body.alias("body"), F.concat_ws("\x01", typed, body).alias("key")).alias("c"))
    # by rank alone: rows may hold maps, which have no order
    rows = F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    held = ranked.groupBy().agg(F.when(F.count(F.lit(1)) > 2 * WIDEST, F.raise_error(F.lit("too many candidates for an ordered scan"))).otherwise(rows).alias("rows"))

    def scan(state: Column, c: Column) -> Column:
        # only keys are carried on; what they keep is read once at the end
        known = (F.coalesce(c["id"], F.lit("")) != "") & F.array_contains(state["ids"], F.coalesce(c["id"], F.lit("")))
        drop = (c["body"] == "") | known | F.array_contains(state["keys"], c["key"]) | (F.size(state["keys"]) >= top_k)
        grown = F.struct(F.array_append(state["at"], c["at"]).alias("at"), F.array_append(state["ids"], F.coalesce(c["id"], F.lit(""))).alias("ids"), F.array_append(state["keys"], c["key"]).alias("keys"))
        return F.when(drop, state).otherwise(grown)

    empty = F.struct(F.array().cast("array<bigint>").alias("at"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("keys"))
    kept = held.select("rows", F.aggregate("rows", empty, scan)["at"].alias("at"))
    return kept.select(F.explode(F.filter("rows", lambda c: F.array_contains("at", c["at"]))).alias("c")).select("c.row.*")


def recall(items: DataFrame, top_k: int = 10, workspace: str | None = None, strict: bool = False, floor: float = 0.3) -> DataFrame:
    """rank and line of the newest distinct items in scope (filters before the limit)."""
    top = recent(distinct_bodies(scoped(items, workspace, strict, floor)), top_k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("created_seq").desc_nulls_last(), "item_id")))
    return ranked.select(F.col("rank").cast("bigint").alias("rank"), "item_id", recall_line().alias("line"))


def recall_line(n: int = 200) -> Column:
    return F.concat(F.lit("- "), markers(F.col("stale"), F.col("confidence")), F.lit("["), F.coalesce(F.nullif(F.col("memory_type"), F.lit("")), F.lit("?")), F.lit("] "), F.substring(strip(F.col("content")), 1, n))


def budget_prefix(rows: DataFrame, by: str, order: str, text: str, budget: int, header: int = 0) -> DataFrame:
    """The rows of each group before the first that would exceed the token budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tokens", estimate_tokens(F.col(text))).withColumn("used", F.sum("tokens").over(w) + header).where(F.col("used") <= budget)


def candidates(recent_rows: DataFrame, semantic_rows: DataFrame | None = None) -> DataFrame:
    """Recent rows, then rows found by meaning, in their orders: `rank` runs on; both have item_id and place."""
    if semantic_rows is None:
        return recent_rows.withColumn("rank", F.col("place").cast("bigint"))
    return recent_rows.withColumn("rank", F.col("place").cast("bigint")).unionByName(semantic_rows.withColumn("rank", F.col("place").cast("bigint") + WIDEST))


def snapshot_frame(snapshots: DataFrame, now: Column, workspace: str | None = None, days: int = 7) -> DataFrame:
    """The newest snapshot's text if it is fresh and of the workspace (an unknown one on either side matches); one row or none."""
    newest = snapshots.where(F.col("memory_type") == "snapshot").orderBy(F.col("created_at").desc_nulls_last(), "item_id").limit(1)
    own = F.lit(True) if workspace is None else F.col("workspace_id").isNull() | (F.col("workspace_id") == workspace)
    return newest.where(own & fresh(F.col("created_at"), now, days)).select(strip(F.col("content")).alias("frame"))


def recall_block(items: DataFrame, top_k: int, *, words: list[str] | None = None, workspace: str | None = None, strict: bool = False, floor: float = 0.3, frame: DataFrame | None = None) -> DataFrame:
    """rank and line of a whole recall: recent and semantic candidates are limited first, then filtered, deduplicated and capped.

    `words` stands for the folder or the query searched for. The frame, if any, is the last line."""
    recent_k, semantic_k = split_counts(top_k)
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    newest = (F.col("created_seq").desc_nulls_last(), F.col("item_id"))
    channels = [recent(items, recent_k if words else top_k).withColumn("place", place(*newest))]
    if words and semantic_k:
        best = bm25(items, words, "item_id", "content").select("item_id", F.round("score", 4).alias("score")).orderBy(F.col("score").desc(), "item_id").limit(semantic_k)
        channels.append(items.join(F.broadcast(best.withColumn("place", place(F.col("score").desc(), "item_id")).drop("score")), "item_id"))  # semantic_k rows
    kept = ordered_dedup(scoped(candidates(*channels), workspace, strict, floor), top_k)
    lines = kept.select(F.row_number().over(Window.orderBy("rank")).cast("bigint").alias("rank"), recall_line().alias("line"))
    return lines if frame is None else lines.unionByName(frame.where("frame <> ''").select(F.lit(top_k + 1).cast("bigint").alias("rank"), F.col("frame").alias("line")))


def orient_block(blocks: DataFrame, patterns: DataFrame, by: str, order: str, budget: int = 500, least: int = 100) -> DataFrame:
    """`by`, place and line: the context if it fits whole, then patterns while the budget lasts, if more than `least` of it is left.

    `blocks` has one context a key, `patterns` has rows in order with memory_type and content."""
    fits = blocks.select(by, "context", estimate_tokens(F.col("context")).alias("cost")).withColumn("taken", (F.coalesce(F.col("context"), F.lit("")) != "") & (F.col("cost") <= budget))
    left = fits.select(by, F.when(F.col("taken"), budget - F.col("cost")).otherwise(F.lit(budget)).alias("left"))
    line = F.concat(F.lit("- ["), F.coalesce("memory_type", F.lit("?")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 150))
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    listed = patterns.withColumn("line", line).withColumn("used", F.sum(estimate_tokens(F.col("line"))).over(run)).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    chosen = listed.join(left, by).where((F.col("left") > least) & (F.col("used") <= F.col("left"))).select(by, F.col("place").cast("bigint").alias("place"), "line")
    return fits.where("taken").select(by, F.lit(0).cast("bigint").alias("place"), F.col("context").alias("line")).unionByName(chosen)
