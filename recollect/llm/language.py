"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its byte 1- to 3-grams (A-Z lowered, ASCII that is no letter as space), hashed to `DIMS`
places and scaled to length one. Each language has several centroids from spherical k-means; a text gets the language of
the centroid with the greatest cosine. It is rejected when that cosine is below half of what all but `LOW` of that language's
training texts of about its length reach (powers of two; where fewer than `SEEN` training texts have that length, the
nearest length counts that has them, and all lengths together where none has), or when it has no letter.

Document frequencies and these floors count every training row, the floors in `BINS` steps. Centroids are fitted on about `per_language` rows of each language, chosen by
a hash of the id: a bound on what the driver holds, whatever the corpus.

Training rows are those outside the held-out fold with a language; prediction uses the text alone. Defined results: a null
text or one without letters is `und` with score 0 and rejected; with no training rows every text is `und`; rows that repeat
a doc_id are each returned; an empty table gives an empty result; other columns are ignored. Ties go to the language first
in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, packed

DIMS, SEEN = 1 << 13, 20
LOW, BINS = 0.01, 1000
WORDY = re.compile(r"[^\W\d_]")
FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether the text has a letter; other signs of words, such as fractions, are none."""
    return any(m[0].isalpha() for m in WORDY.finditer(text))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FLAT) + b" ", dtype=np.uint8).astype(np.uint32)
    two = raw[:-1] * np.uint32(251) + raw[1:]
    three = two[:-1] * np.uint32(251) + raw[2:] + np.uint32(7)
    total = np.zeros(DIMS, dtype=np.int64)
    for codes in (raw, two + np.uint32(1009), three + np.uint32(70001)):
        total += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)
    return total


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as TF-IDF vectors of length one."""
    tf = np.log1p(rows.astype(np.float32)) * idf
    return tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    centres = [x.mean(axis=0)]
    centres[0] = centres[0] / max(float(np.linalg.norm(centres[0])), 1e-9)
    nearest = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, k: int = 3) -> dict:
    """The model: languages, idf, centroids, their languages, and by language the least cosine for a length."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold(id_col).alias("fold"))
    train = rows.where("fold != 0 AND lang IS NOT NULL AND text IS NOT NULL")

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                total += counts(value.as_py()) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["place", "n"])

    seen = {r["place"]: r["n"] for r in train.select("text").mapInArrow(document_frequency, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    n_docs = seen.pop(-1, 0)
    df = np.zeros(DIMS)
    df[list(seen)] = list(seen.values())
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)

    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sizes.items()), F.lit(0.0))
    chosen = train.where(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, value in zip(batch.column(0), batch.column(1)):
                c = counts(value.as_py())
                at = np.flatnonzero(c)
                out.append((lang.as_py(), at.astype("<u2").tobytes(), np.minimum(c[at], 2**31 - 1).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["lang", "place", "n"])

    by_lang: dict[str, list] = {}
    for r in chosen.mapInArrow(sparse, "lang string, place binary, n binary").collect():
        by_lang.setdefault(r["lang"], []).append((np.frombuffer(r["place"], "<u2"), np.frombuffer(r["n"], "<i4")))
    langs, centroids, owner = sorted(by_lang), [], []
    for i, lang in enumerate(langs):
        own = sorted(by_lang[lang], key=lambda pair: (len(pair[0]), pair[0].tobytes(), pair[1].tobytes()))
        dense = np.zeros((len(own), DIMS), dtype=np.float32)
        for j, (at, n) in enumerate(own):
            dense[j, at] = n
        x = vectors(dense, idf)
        found = clustered(x, k)
        centroids.append(found)
        owner += [i] * len(found)
    model = {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), "owner": np.array(owner, dtype=int)}
    return model | {"floor": floors(train.select("lang", "text"), model)}


def floors(train: DataFrame, model: dict) -> list[dict[int, float]]:
    """For each language the least cosine of a text that is not rejected, by length, from all rows of `train` (lang, text)."""
    if not model["langs"]:
        return []
    shared = train.sparkSession.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, Counter()
        place = {lang: i for i, lang in enumerate(m["langs"])}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                live = [(place[lang], t) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if lang in place and has_letter(t)]
                if live:
                    rows, own = np.stack([counts(t) for _, t in live]), np.array([i for i, _ in live])
                    cosines = np.where(m["owner"] == own[:, None], vectors(rows, m["idf"]) @ m["centroids"].T, 0.0).max(axis=1)
                    seen.update(zip(own.tolist(), np.log2(rows.sum(axis=1)).astype(int).tolist(), np.minimum(cosines * BINS, BINS - 1).astype(int).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int64()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], ["own", "size", "bin", "n"])

    # at most languages x lengths x BINS rows
    found = train.mapInArrow(histogram, "own bigint, size bigint, bin bigint, n bigint").groupBy("own", "size", "bin").agg(F.sum("n").alias("n")).collect()
    met: list[dict[int, np.ndarray]] = [{} for _ in model["langs"]]
    for r in found:
        met[r["own"]].setdefault(r["size"], np.zeros(BINS, dtype=np.int64))[r["bin"]] += r["n"]
    out: list[dict[int, float]] = []
    for by_size in met:
        enough = {size: n for size, n in by_size.items() if n.sum() >= SEEN} or ({0: sum(by_size.values())} if by_size else {})
        # the first step that more than LOW of the texts do not exceed
        out.append({size: int((np.cumsum(n) > LOW * n.sum()).argmax()) / BINS / 2 for size, n in enough.items()})
    return out


def _floor(by_size: dict[int, float], size: int) -> float:
    return by_size[min(by_size, key=lambda s: (abs(s - size), s))] if by_size else 0.0


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS times the number of centroids: fixed by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, owner = m["langs"], m["owner"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_py() for t in part.column(3)]
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                live = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
                if live:
                    rows = np.stack([counts(texts[i]) for i in live])
                    cosines = vectors(rows, m["idf"]) @ m["centroids"].T
                    best = cosines.argmax(axis=1)
                    sizes = np.log2(rows.sum(axis=1)).astype(int)
                    for j, i in enumerate(live):
                        lang[i], score[i] = langs[owner[best[j]]], min(1.0, max(0.0, float(cosines[j, best[j]])))
                        rejected[i] = score[i] < _floor(m["floor"][owner[best[j]]], int(sizes[j]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "text_hash", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def language_digest(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the documents that language identification rejects."""
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    gone = found.where("rejected").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(packed(docs), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti").select("row.*")
