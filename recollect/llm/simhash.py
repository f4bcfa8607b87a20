"""Near-duplicate groups by SimHash with anchor-point covering.

Anchors are the codewords of a direct sum of perfect codes over three blocks of the 64 fingerprint bits: two binary Golay
codes (23 bits, covering radius 3) and a Hamming code (15 bits, covering radius 1); the last 3 bits are left to the
comparison. Every fingerprint has one home anchor, the codeword within the covering radius in each block. A fingerprint
that differs from it in at most `distance` bits lies, block by block, within that radius plus its share of the distance of
the same anchor. So each distinct fingerprint is sent once to its home and once to every anchor whose excess over the
covering radii sums to at most `distance`, and is compared there with those at home. With 2^35 anchors the number of
compared pairs stays small at 10^10 fingerprints, and no link is missed.

A distinct fingerprint has at most 2,080 others within two bits, so links grow with the input, whatever the size of a group
of copies. Components are found by repeated contraction: union-find inside each partition of the links, whose result is a
star for each of its trees, then a new dealing of the stars, until no link crosses; results of rounds are checkpointed.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; rows that repeat a doc_id are each returned with the component of their own fingerprint; a null doc_id is returned
with its component, whose id is null only if no document in it has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, width

#: Generator polynomials of the codes, their lengths and covering radii.
GOLAY, HAMMING = 0b101011100011, 0b10011
BLOCKS = ((GOLAY, 23, 3), (GOLAY, 23, 3), (HAMMING, 15, 1))
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last)), dtype="<u8", count=len(last))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a bigint) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, text_hash bigint, fp bigint")


def _syndrome(words: np.ndarray, polynomial: int, length: int) -> np.ndarray:
    """Remainders of words modulo the generator polynomial."""
    degree = polynomial.bit_length() - 1
    left = words.astype(np.uint64).copy()
    for bit in range(length - 1, degree - 1, -1):
        high = (left >> np.uint64(bit)) & np.uint64(1)
        left ^= high * np.uint64(polynomial << (bit - degree))
    return left


@cache
def coset_patterns(polynomial: int, length: int, radius: int, distance: int) -> tuple:
    """For each excess 0..distance over the covering radius: offsets by syndrome and the error patterns of that excess."""
    found = []
    for excess in range(distance + 1):
        weights = range(radius + 1) if excess == 0 else [radius + excess]
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(length), w)], dtype=np.uint64)
        syndromes = _syndrome(patterns, polynomial, length).astype(np.int64)
        order = np.argsort(syndromes, kind="stable")
        offsets = np.searchsorted(syndromes[order], np.arange((1 << (polynomial.bit_length() - 1)) + 1))
        found.append((offsets, patterns[order]))
    return tuple(found)


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into fps and the anchor of each replica; excess 0 gives the home anchor alone."""
    index, anchor, spent = np.arange(len(fps)), np.zeros(len(fps), dtype=np.uint64), np.zeros(len(fps), dtype=np.int64)
    shift = 0
    for polynomial, length, radius in BLOCKS:
        block = (fps >> np.uint64(shift)) & np.uint64((1 << length) - 1)
        syndromes = _syndrome(block, polynomial, length).astype(np.int64)
        parts = []
        for excess, (offsets, patterns) in enumerate(coset_patterns(polynomial, length, radius, distance)):
            able = np.flatnonzero(spent + excess <= distance)
            own = syndromes[index[able]]
            many = offsets[own + 1] - offsets[own]
            at = np.repeat(able, many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            words = block[index[at]] ^ patterns[np.repeat(offsets[own], many) + within]
            parts.append((index[at], anchor[at] | (words << np.uint64(shift)), spent[at] + excess))
        index, anchor, spent = (np.concatenate(x) for x in zip(*parts))
        shift += length
    return index, anchor


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs of node ids (a, b) whose fingerprints differ in 1 to `distance` bits; `distinct` has node and a unique fp."""

    def sent(reach: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    fps = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                    index, anchor = anchors(fps, reach)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), pa.array(fps[index].view(np.int64)), pa.array(anchor.view(np.int64))], ["node", "fp", "anchor"])

        return deal

    schema = "node bigint, fp bigint, anchor bigint"
    # few bytes become many: dealt over all tasks before, not over as many as the few bytes fill
    distinct = distinct.repartition(width(distinct.sparkSession), "fp")
    home = distinct.mapInArrow(sent(0), schema).alias("h")
    away = distinct.mapInArrow(sent(distance), schema).alias("r")
    # the planner takes the size of what is dealt for that of its replicas, and would broadcast those by way of the driver
    away = away.hint("merge")
    near = (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") != F.col("r.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
    return home.join(away, near).select(F.least("h.node", "r.node").alias("a"), F.greatest("h.node", "r.node").alias("b")).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition become stars: each node with the least node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(root(x), x) for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the least node that it reaches.

    Links of each partition are contracted to stars first. A round then gives every leaf the least of its roots and links that
    root to the leaf's others, and moves the leaves of a root that is a leaf itself up to that one's root. Reachability stays,
    and rounds end when nothing changes.
    """
    n = width(edges.sparkSession)
    schema = "a bigint, b bigint"
    stars = checkpointed(edges.mapInArrow(_contract, schema))
    while True:
        # each leaf to the least of its roots; that root to each of the others: reachability stays, leaves meet in one task
        best = stars.groupBy("b").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n"))
        across = stars.join(best.where("n > 1"), "b").where("a != least").select(F.col("least").alias("a"), F.col("a").alias("b"))
        settled = best.select(F.col("least").alias("a"), "b")
        # a root that is itself a leaf elsewhere moves its leaves up
        up = settled.alias("s").join(settled.alias("u"), F.col("s.a") == F.col("u.b"), "left").select(F.coalesce("u.a", "s.a").alias("a"), F.col("s.b").alias("b"))
        nexts = checkpointed(up.unionAll(across).where("a != b").distinct().repartition(n, "b"))
        change = nexts.join(stars, ["a", "b"], "left_anti").limit(1).count() + stars.join(nexts, ["a", "b"], "left_anti").limit(1).count()
        stars = nexts
        if change == 0:
            return stars.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, fp, component_id (least doc_id reachable over links of at most `distance` bits)."""
    # fingerprints are used thrice; they are narrow, so they are written once
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    # nodes are fingerprints; a group without any id still has one
    nodes = distinct.select(F.coalesce("least_id", F.lit(2**63 - 1)).alias("rank"), "fp", "n")
    edges = links(nodes.select(F.col("fp").alias("node"), "fp"), distance)
    rooted = components(edges)
    by_root = rooted.select("node", "root").unionAll(rooted.select(F.col("root").alias("node"), "root").distinct())
    classes = checkpointed(by_root.join(nodes, by_root["node"] == nodes["fp"]).select("node", "root", "rank"))
    least = classes.groupBy("root").agg(F.min("rank").alias("up"), F.count(F.lit(1)).alias("n"))
    # a component may hold a third of all fingerprints
    linked = _met(classes.select("node", "root"), least, "root").select(F.col("node").alias("fp"), "up")
    labels = checkpointed(nodes.join(linked, "fp", "left").select("fp", "n", F.nullif(F.coalesce("up", "rank"), F.lit(2**63 - 1)).alias("component_id")))
    return _met(fps, labels, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _met(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """`rows` with the one row that `side` has for their key; `side` counts in n how many rows have it.

    A key with more than a quarter of a task's rows meets its row by a broadcast, as there are at most 4 such keys a task."""
    hot = side.where(F.col("n") > F.lit(rows.count() // (4 * width(rows.sparkSession)) + 1)).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def simhash_digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group: the one whose doc_id names the component."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(packed(docs), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti").select("row.*")
