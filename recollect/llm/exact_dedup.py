"""Exact dedup by content sort (DataFrame operations only).

Normalised bytes are range-partitioned by sampled splitters, each range is sorted externally, and the sort puts equal
texts next to each other; neighbours are compared in full and the smallest identifier of a run stays.

* The splitters are drawn from a bounded key (the first 32 bytes and a hash of the whole text), so that sampling never
  brings whole texts to the driver and a shared opening does not pile up in one range. Rows are sorted and compared on the
  whole normalised text. Equal texts have equal keys, so a group of copies is one run of neighbours.
* Only a group that would fill a quarter of a task or more is cut: its share is estimated on a random sample of about
  `SAMPLED` rows a task, and its rows are dealt over as many chunks as that share asks for. The first rows of its chunks,
  a few a task in all, are then compared in full again. The sample decides where rows go and nothing else: a group that it
  misses is still one run.

Texts are normalised once on the way to the sort and travel once.

Defined results: a null text counts as empty, and empty texts are one group; rows that repeat a doc_id are each
returned; a null doc_id sorts after all others and keeps its group only if the group has no other id; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, packed, width

#: Rows a task in the estimate of hot groups; a group is cut where its share exceeds one in CUT times the number of tasks.
SAMPLED, CUT = 1000, 4


def _first() -> Column:
    return F.col("id").asc_nulls_last()


def _size() -> Column:
    return F.count(F.lit(1))


def normalised(text: Column) -> Column:
    """Each `[\\x20\\x09-\\x0D]+` replaced by one space, by plain replacements as far as they go."""
    text = F.coalesce(text, F.lit(""))
    for white in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def _chunks(docs: DataFrame, text: Column) -> DataFrame | None:
    """tie and the number of chunks of each hot group, at most CUT times the number of tasks; None where there is none."""
    tasks = width(docs.sparkSession)
    rows = docs.count()
    rate = min(1.0, SAMPLED * tasks / max(1, rows))
    seen = docs.select(F.xxhash64(text).alias("tie")) if rate == 1.0 else docs.select(text.alias("t")).sample(rate, 5).select(F.xxhash64("t").alias("tie"))
    share = F.col("n") / F.lit(max(1.0, rate * rows))
    hot = seen.groupBy("tie").agg(_size().alias("n")).where((share * (CUT * tasks) > 1) & (F.col("n") > SAMPLED // CUT))
    found = [(r["tie"], r["chunks"]) for r in hot.select("tie", F.ceil(share * (CUT * tasks)).cast("int").alias("chunks")).collect()]
    return docs.sparkSession.createDataFrame(found, "tie bigint, chunks int") if found else None


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, bool]:
    """Rows in runs of equal neighbours, and whether some group was cut.

    Columns: id, norm, place in the run, run_id (its smallest id), run_size, chunks (those of the group), and with `whole` the row
    itself as a struct, so that no name of its columns can clash."""
    text = normalised(F.col(text_col))
    hot = _chunks(docs, text)
    carried = [packed(docs)] if whole else []
    # a whole row carries its text, so the normalised one is made again where it arrives instead of travelling beside it
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm"), *carried)
    keyed = rows.select("*", F.substring(F.col("norm").cast("binary"), 1, 32).alias("head"), F.xxhash64("norm").alias("tie"))
    keyed = keyed.withColumn("chunks", F.lit(1)) if hot is None else keyed.join(F.broadcast(hot), "tie", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    if whole:
        keyed = keyed.drop("norm")
    ranged = keyed.repartitionByRange(width(docs.sparkSession), "head", "tie", "chunk")
    if whole:
        ranged = ranged.withColumn("norm", normalised(F.col(f"row.`{text_col}`")))
    run = Window.partitionBy("head", "tie", "chunk", "norm")
    return ranged.withColumns({"place": F.row_number().over(run.orderBy(_first())), "run_id": F.min("id").over(run), "run_size": _size().over(run)}), hot is not None


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    runs, cut = sorted_runs(docs, id_col, text_col, whole=False)
    rows = runs.select(F.col("id").alias("doc_id"), F.col("run_id").alias("keep_id"), F.col("run_size").alias("group_size"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when((F.col("place") == 1) & (F.col("chunks") > 1), F.col("norm")).alias("first"))
    if cut:
        # narrow but for the first row of each chunk; used twice
        rows = checkpointed(rows)
        group = Window.partitionBy("first")
        merged = rows.where("first IS NOT NULL").select("text_sha256", F.min("keep_id").over(group).alias("least"), F.sum("group_size").over(group).alias("all")).distinct()
        rows = rows.join(F.broadcast(merged), "text_sha256", "left").withColumns({"keep_id": F.when(F.col("all").isNull(), F.col("keep_id")).otherwise(F.col("least")), "group_size": F.coalesce("all", "group_size")})
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group: that of the smallest id (of rows repeated under one id and text, one)."""
    runs, cut = sorted_runs(docs, id_col, text_col, whole=True)
    firsts = runs.where("place = 1").select("row", "id", "chunks", F.when(F.col("chunks") > 1, F.col("norm")).alias("first"))
    if cut:
        firsts = checkpointed(firsts)
        best = firsts.where("chunks > 1").withColumn("n", F.row_number().over(Window.partitionBy("first").orderBy(_first()))).where("n = 1")
        firsts = firsts.where("chunks = 1").select("row").unionAll(best.select("row"))
    return firsts.select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
