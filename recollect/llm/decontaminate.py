"""Benchmark decontamination (DataFrame operations only).

The normalised n-grams (windows) of the benchmark form a hash set; the corpus is scanned window by window against it,
every hit is verified word by word, and the words under verified hits are returned, so that spans or whole documents can
be removed. Windows travel as id, position and hash; texts are read again only to verify the documents with hits.

The set is broadcast only when its measured size (words over all distinct windows) is within `broadcast_words`; a larger
benchmark is joined by a shuffle on the window's hash. Distinct windows are unique keys on that side, so a passage that a
third of the corpus shares is a hot key on the corpus side alone, which adaptive execution splits.

Defined results: a null text has no words; an item or document without words never matches; an item of fewer words than a
window is one window of its own length; repeated items count by their distinct item_id; rows that repeat a doc_id and text
are each returned with the same result; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain lower() where the text is all ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _gram_hash(hashes: Column, at: Column | int, n: int) -> Column:
    """Of the hashes of words, by single elements: slicing a long array copies all of it each time."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(n)))


def _windows(hashes: Column, n: int) -> Column:
    """Hashes of all windows of n words, in order; none where there are fewer words."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: _gram_hash(hashes, i, n))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: h, size, gram (array of words), items (array of item ids)."""
    tokens = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    grams = tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("gram"))
    h = F.coalesce(*(F.when(F.size("gram") == k, _gram_hash(_hashed(F.col("gram")), 0, k)) for k in range(1, n + 1)))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select(h.alias("h"), F.size("gram").alias("size"), "gram", "items")


def find_candidates(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = 2_000_000) -> DataFrame:
    """One row per document id and text with windows of equal hash: hit_id, hit_hash, hits (at, size, gram, items), not yet verified.

    The scan carries ids, positions and hashes alone; words are looked at again only in documents with candidates."""
    grams = benchmark_windows(benchmark, n)
    # at most n rows: the lengths of windows, and the set's size in words and item ids
    shape = grams.groupBy("size").agg(F.sum(F.col("size") + F.size("items")).alias("weight")).collect()
    lengths, weight = sorted(r["size"] for r in shape), sum(r["weight"] for r in shape)
    hashes = docs.select(F.col(id_col).alias("hit_id"), F.xxhash64(F.col(text_col)).alias("hit_hash"), _hashed(words(F.col(text_col))).alias("wh"))
    scanned = None
    for size in lengths or [n]:
        one = hashes.select("hit_id", "hit_hash", F.posexplode(_windows(F.col("wh"), size)).alias("at", "h")).withColumn("size", F.lit(size))
        scanned = one if scanned is None else scanned.unionAll(one)
    small = F.broadcast(grams) if weight <= broadcast_words else grams
    return scanned.join(small, ["h", "size"]).groupBy("hit_id", "hit_hash").agg(F.collect_set(F.struct("at", "size", "gram", "items")).alias("hits"))


def _verified(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, broadcast_words: int = 2_000_000, broadcast_hits: int = 20_000) -> DataFrame:
    """Rows of `docs` as row, id, text, and hits: those whose words are the window's, word by word; null where there is none."""
    found = checkpointed(find_candidates(docs, benchmark, n, id_col, text_col, broadcast_words))
    weight = found.agg(F.sum(F.size("hits"))).first()[0] or 0
    # documents stay where they are read if the candidates are few, by a count just made; else they meet by id and text
    side = F.broadcast(found) if weight <= broadcast_hits else found
    rows = docs.select(packed(docs), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("hash"))
    joined = rows.join(side, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left")
    sure = joined.withColumn("w", F.when(F.col("hits").isNotNull(), words(F.col("t")))).withColumn("hits", F.filter("hits", lambda x: F.slice("w", x["at"] + 1, x["size"]) == x["gram"]))
    return sure.select("row", "id", "t", "hash", "w", F.when(F.size("hits") > 0, F.col("hits")).alias("hits"))


def _hit_words(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = 2_000_000, broadcast_hits: int = 20_000) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, hit_words (sorted word indexes), items (sorted item ids as text)."""
    found = _verified(docs.select(id_col, text_col), benchmark, n, id_col, text_col, broadcast_words, broadcast_hits)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    return found.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.size(F.coalesce("w", words(F.col("t")))).cast("bigint").alias("n_words"),
        F.coalesce(_hit_words(F.col("hits")), F.array().cast("array<int>")).alias("hit_words"), F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs, benchmark)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that hold a benchmark window."""
    return _verified(docs, benchmark, n, id_col, text_col).where("hits IS NULL").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with contaminated texts rewritten as their remaining words; other texts are untouched."""
    found = _verified(docs, benchmark, n, id_col, text_col).withColumn("gone", F.when(F.col("hits").isNotNull(), _hit_words(F.col("hits"))))
    rest = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("w") - 1), "gone"), lambda i: F.get("w", i)), " "))
    return found.withColumn("rest", rest).select(*(F.col("rest").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bg
), dg AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hit AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.gram = bg.gram AND dg.n = bg.n
), spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots ON dw.doc_id = spots.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
