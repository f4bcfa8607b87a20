"""Text and vector search: BM25, cosine, reciprocal rank fusion."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.scalar import cosine

from . import predicates as P


def clamp(top_k: int) -> int:
    return max(1, min(200, top_k))


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score (Robertson and Zaragoza). Texts are cut once, into a length and the counts of the query's terms; one aggregate gives all totals."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]+"), 0)
    asked = list(dict.fromkeys(query))
    occurs = lambda t: F.size(F.filter("w", lambda x: x == t))
    tf = [occurs(t).alias(f"tf{k}") for k, t in enumerate(asked)]
    rows = docs.select(F.col(id_col).alias("key"), tokens.alias("w")).select("key", F.size("w").alias("len"), *tf)
    totals = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(asked)))).alias("t"))
    hits = rows.where(F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{k}") for k in range(len(asked)))) > 0).crossJoin(F.broadcast(totals))  # one row

    def part(k: int):
        n, df, tf = F.col("t.n"), F.col(f"t.df{k}"), F.col(f"tf{k}")
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("t.avg_len")))

    return hits.select(F.col("key").alias(id_col), reduce(lambda x, y: x + y, (part(k) for k in range(len(asked))), F.lit(0.0)).alias("score"))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest by cosine: one scan and a top-k, nothing is shuffled but k rows a task."""
    scored = vectors.select(id_col, F.round(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query)))), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_col).limit(clamp(k))


def fuse(channels: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al.) of channels with id and rank: a sum over a union, not a chain of outer joins."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    return every.groupBy(id_col).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, id_col: str, *order, depth: int = 1000) -> DataFrame:
    """id and rank of the first `depth` rows; the ranking window sees only those."""
    top = df.orderBy(*order).limit(depth)
    return top.select(id_col, F.row_number().over(Window.orderBy(*order)).alias("rank"))


#: Scores are ranked by six decimals, so that much, and room for rounding, below the k-th may still come before it.
SLACK = 2e-6


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added in order as `cosine` adds them."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _by_length(column: pa.ChunkedArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Places and matrix of the arrays of each length; places of nulls and of arrays that hold one."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    lengths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False).copy()
    values = rows.flatten()
    if values.null_count:
        lengths[pc.list_parent_indices(rows).to_numpy()[values.is_null().to_numpy(zero_copy_only=False)]] = -1
    found = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        own = np.flatnonzero(lengths == n)
        found[n] = own, rows.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
    return found, np.flatnonzero(lengths < 0)


def _nearest(rows: np.ndarray, probes: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probe, row and cosine of all pairs that may be among the k best of a probe; rows come by id."""
    with np.errstate(all="ignore"):
        norms, lengths = np.sqrt(_dots(rows, rows)), np.sqrt(_dots(probes, probes))
        plain = lambda n: (n == 0) | (n > 1e-100) & (n < 1e100)
        # not numbers, and what under- or overflows, are scored one by one
        far, near = np.flatnonzero(~plain(norms)), np.flatnonzero(plain(norms))
        units = rows[near] / np.where(norms[near] == 0, 1, norms[near])[:, None]
        out = []
        for start in range(0, len(probes), step):
            some = np.arange(start, min(start + step, len(probes)))
            able = plain(lengths[some])
            product = np.where(able[:, None], probes[some] / np.where(lengths[some] == 0, 1, lengths[some])[:, None], 0) @ units.T
            kept = product >= np.partition(product, -k, axis=1)[:, [-k]] - SLACK if len(near) > k else np.ones(product.shape, dtype=bool)
            kept[~able] = True
            p, r = np.nonzero(kept)
            p, r = some[np.concatenate((p, np.repeat(np.arange(len(some)), len(far))))], np.concatenate((near[r], np.tile(far, len(some))))
            for at in range(0, len(p), 1 << 20):
                a, b = p[at : at + (1 << 20)], r[at : at + (1 << 20)]
                both = norms[b] * lengths[a]
                out.append((a, b, np.where(both == 0, 0.0, _dots(rows[b], probes[a]) / both)))
        p, r, score = (np.concatenate(x) for x in zip(*out))
        # of pairs of one score, the first k by id
        order = np.lexsort((r, score, p))
        p, r, score = p[order], r[order], score[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | ~((score[1:] == score[:-1]) | np.isnan(score[1:]) & np.isnan(score[:-1]))
        since = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    return p[since < k], r[since < k], score[since < k]


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", block: int = 4096, chunk: int = 16384) -> DataFrame:
    """query id, id, score and rank of the k nearest rows to each query by cosine, brute force.

    Each chunk of rows meets each block of queries in a task. Products of unit vectors leave those that may be among the chunk's
    k best, `SLACK` included; these alone get the cosine itself, as the scalar adds it, and are ranked over all chunks. Nulls,
    what holds one and unequal lengths score as `cosine` has it: null, or zero where a norm is zero."""
    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = vectors.count()
    chunks = max(1, -(-total // max(1, min(chunk, max(1024, total // (4 * n))))))
    blocks = max(1, -(-queries.count() // block))
    deal = lambda df, own, other, many, rest: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(rest - 1)))).repartition(n, "chunk", "block").groupBy("chunk", "block")
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, kind), T.StructField("score", T.DoubleType())])

    def meet(rows: pa.Table, probes: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
        (vecs, _), (asked, unknown) = _by_length(rows["vector"]), _by_length(probes["probe"])
        size = np.full(rows.num_rows, np.nan)
        with np.errstate(all="ignore"):
            for at, matrix in vecs.values():
                size[at] = np.sqrt(_dots(matrix, matrix))
            found = []

            def add(own: np.ndarray, at: np.ndarray, null: bool) -> None:
                """The first k rows of `at` for each query, with zero or null."""
                p, r = np.repeat(own, len(at[:k])), np.tile(at[:k], len(own))
                found.append((p, r, np.zeros(len(p)), np.full(len(p), null)))

            add(unknown, np.arange(rows.num_rows), True)
            for n, (own, matrix) in asked.items():
                at, same = vecs.get(n, (np.zeros(0, dtype=np.int64), None))
                if same is not None:
                    p, r, score = _nearest(same, matrix, k)
                    found.append((own[p], at[r], score, np.zeros(len(p), dtype=bool)))
                # a product of norms that is zero gives zero, whatever the lengths
                rest, lengths = np.setdiff1d(np.arange(rows.num_rows), at), np.sqrt(_dots(matrix, matrix))
                usual = (lengths > 1e-100) & np.isfinite(lengths)
                for length in [1.0, *np.unique(lengths[~usual]).tolist()]:
                    some = own[usual] if length == 1.0 else own[~usual & ((lengths == length) | np.isnan(lengths) & np.isnan(length))]
                    zero = size[rest] * length == 0
                    add(some, rest[zero], False)
                    add(some, rest[~zero], True)
        p, r, score, null = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": probes["id"].take(pa.array(p)), id_col: rows["id"].take(pa.array(r.astype(np.int64))), "score": pa.array(score, mask=null)})

    left = deal(vectors.select(F.col(id_col).alias("id"), F.col("embedding").alias("vector")), "chunk", "block", chunks, blocks)
    right = deal(queries.select(F.col(id_col).alias("id"), F.col("embedding").alias("probe")), "block", "chunk", blocks, chunks)
    scored = left.cogroup(right).applyInArrow(meet, schema).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def near_pairs(vectors: DataFrame, by: str, threshold: float, id_col: str = "vec_id") -> DataFrame:
    """Consecutive rows of a group whose cosine is `threshold` or more."""
    w = Window.partitionBy(by).orderBy(id_col)
    both = vectors.withColumn("next_id", F.lead(id_col).over(w)).withColumn("next", F.lead("embedding").over(w)).where("next_id IS NOT NULL")
    return both.select(id_col, "next_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score")).where(F.col("score") >= threshold)


def wildcard(nodes: DataFrame, filters: dict[str, str] | None = None, memory_type: str | None = None, include_reference: bool = False) -> DataFrame:
    """Every item that is no internal one; a limit is not applied to a wildcard."""
    kept = nodes.where(P.not_internal())
    if not include_reference:
        kept = kept.where(P.not_reference())
    if filters:
        kept = kept.where(P.has_properties(kept, filters))
    return kept if memory_type is None else kept.where(F.col("memory_type") == memory_type)


def with_type(filters: dict[str, str] | None, memory_type: str | None) -> dict[str, str]:
    """A type asked for beside filters becomes one of them; an explicit filter wins."""
    return ({"memory_type": memory_type} if memory_type else {}) | (filters or {})


def search(items: DataFrame, query: str, top_k: int = 5, filters: dict[str, str] | None = None, include_reference: bool = False, memory_type: str | None = None, vectors: DataFrame | None = None, probe: list[float] | None = None, depth: int = 100) -> DataFrame:
    """item_id and score of the best items: words and vectors ranked apart and fused by reciprocal ranks; `*` lists everything.

    Filters come before ranking, so that sparse matches are not missed beyond a window of candidates."""
    if query.strip() == "*":
        return wildcard(items, filters, memory_type, include_reference).select("item_id", F.lit(None).cast("double").alias("score"))
    kept = wildcard(items, with_type(filters, memory_type), None, include_reference)
    words = re.findall("[a-z]+", query.lower())
    order = (F.col("score").desc(), F.col("item_id"))
    channels = [ranked(bm25(kept, words, "item_id", "content").select("item_id", F.round("score", 4).alias("score")), "item_id", *order, depth=depth)]
    if vectors is not None and probe is not None:
        near = vectors.join(kept.select("item_id"), "item_id", "left_semi").select("item_id", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, probe)))), 6).alias("score"))
        channels.append(ranked(near, "item_id", *order, depth=depth))
    return fuse(channels, "item_id").select("item_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "item_id").limit(clamp(top_k))


def text_first(items: DataFrame, query: str, top_k: int) -> DataFrame:
    """item_id and channel: items that hold the query as it stands, then those that hold any of its words."""
    words = re.findall("[a-z]+", query.lower())
    whole = items.where(P.mentions(query)).select("item_id", F.lit(0).alias("channel"))
    some = items.where(F.arrays_overlap(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit("[a-z]+"), 0), F.array(*map(F.lit, words)))).select("item_id", F.lit(1).alias("channel"))
    return whole.unionByName(some).groupBy("item_id").agg(F.min("channel").alias("channel")).orderBy("channel", "item_id").limit(clamp(top_k))


def expert(items: DataFrame) -> DataFrame:
    """Items of the types that hold expertise."""
    return items.where(F.col("memory_type").isin(*P.EXPERTISE))
