"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic documents, by the library's own trainer. Both open with
the same content, trained on ordinary windows of `SPAN` words, so that common language costs the same with either. What follows
is each class's own: the trainer's choice from the windows of its documents, cut down to the stretches whose strings of `NOVEL`
bytes the other class lacks.

Whole texts are scored in overlapping windows of `COARSE` words, each compressed with either dictionary behind a lead that both
know. Where the toxic dictionary saves `OPEN` bytes or more, the window is looked at again in overlapping windows of `FINE`
words. Counts of fine windows by bytes saved, with the text's length, go into a logistic scale that is calibrated on training
documents which made no dictionary; its threshold is the best cut there for balanced error and lies at 0.5.

Training uses labelled rows outside the held-out fold, at most about `per_class` of each class, chosen by a hash of the id:
a bound on what the driver holds; of rows that repeat an id, the least text trains. Defined results: null and empty texts have
no windows and score as such; without rows of both classes every score is 0; a document with several labels trains once for
each; rows that repeat a doc_id are each returned; an empty table gives an empty result; other columns are ignored. Runs of
more than 64 bytes without white space are cut, each part counting as a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

COMMON_BYTES, OWN_BYTES, LEAD = 14_000, 1_000, 32
SPAN, COARSE, STEP, FINE, NOVEL, OPEN = 8, 16, 14, 3, 8, 2
TOP = 10
STRIP = b".,;:!?\"'()[]#$%&*|"
RAW = zstandard.DICT_TYPE_RAWCONTENT


def words(text: str | None) -> list[bytes]:
    """Words of the whole text in lower case, without outer punctuation; what is longer than 64 bytes is cut, each part counting."""
    found = []
    for w in (text or "").lower().encode("utf-8", "surrogatepass").split():
        w = w.strip(STRIP)
        if 0 < len(w) <= 64:
            found.append(w)
        elif w:
            found += [w[i : i + 64] for i in range(0, len(w), 64)]
    return found


def windows(own: list[bytes], size: int, step: int) -> list[bytes]:
    """Windows of `size` words, each `step` words on; together they hold every word."""
    return [b" " + b" ".join(own[i : i + size]) + b" " for i in range(0, max(1, len(own) - size + step), step)] if own else []


def _compressor(raw: bytes, **settings):
    # no header fields: lengths are those of the content alone
    params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **settings)
    d = zstandard.ZstdCompressionDict(raw, dict_type=RAW)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress


class Scales:
    """Compression lengths with either dictionary: quick ones for coarse windows, close ones for fine windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        quick = dict(window_log=14, chain_log=14, hash_log=14, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2)
        close = dict(window_log=15, chain_log=15, hash_log=15, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT)
        self.quick = [_compressor(d, **quick) for d in (ordinary, toxic)]
        self.close = [_compressor(d, **close) for d in (ordinary, toxic)]
        # the end of both dictionaries: every window starts with a match and is compressed as what follows
        self.lead = ordinary[-LEAD:]

    def savings(self, text: str | None) -> tuple[list[int], int]:
        """Bytes that the toxic dictionary saves in the fine windows looked at, and the number of words."""
        own, found = words(text), []
        (ordinary, toxic), (ordinary_close, toxic_close), lead = self.quick, self.close, self.lead
        for k, coarse in enumerate(windows(own, COARSE, STEP)):
            coarse = lead + coarse
            if len(ordinary(coarse)) - len(toxic(coarse)) >= OPEN:
                for fine in windows(own[k * STEP : k * STEP + COARSE], FINE, 1):
                    fine = lead + fine
                    found.append(len(ordinary_close(fine)) - len(toxic_close(fine)))
        return found, len(own)

    def features(self, text: str | None) -> np.ndarray:
        found, n = self.savings(text)
        met = np.bincount(np.clip(found, 0, TOP), minlength=TOP + 1) if found else np.zeros(TOP + 1)
        return np.log1p(np.append(np.cumsum(met[:0:-1])[::-1], n))


def _strings(window: bytes) -> np.ndarray:
    """The strings of NOVEL bytes of a window, as integers."""
    raw = np.frombuffer(window, np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, NOVEL)).view(">u8").ravel() if len(raw) >= NOVEL else np.zeros(0, ">u8")


def novel(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """The stretches of windows whose strings of NOVEL bytes no window of `other` has."""
    known = np.unique(np.concatenate([_strings(w) for w in other])).astype(np.uint64) if other else np.zeros(0, np.uint64)
    out = []
    for w in own:
        h = _strings(w).astype(np.uint64)
        if not len(known):
            out += [w] if len(h) else []
            continue
        new = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
        edges = np.flatnonzero(np.diff(np.concatenate(([0], new, [0])))).tolist()
        out += [w[a : b + NOVEL - 1] for a, b in zip(edges[::2], edges[1::2])]
    return out


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """Trained content of at most `size` bytes; where samples are too few for the trainer, the samples themselves."""
    joined = b"".join(samples)
    if len(joined) <= 8 * size or len(samples) < 16:
        return joined[-size:]
    # the trainer puts its tables first and the best content last
    return zstandard.train_dictionary(size + 300, samples, k=segment, d=8).as_bytes()[-size:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000) -> dict | None:
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), fold(id_col).alias("fold")).where("fold != 0 AND text IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in marked.where(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(F.lit(min(1.0, per_class / sizes[0])))
    chosen = marked.where(F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(1_000_000)) < share * 1_000_000)
    # the chosen labels are bounded by per_class, so texts stay where they are read and only the chosen ones move
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label").distinct().collect()
    texts = {k: sorted(r["text"] for r in sample if r["label"] == k) for k in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    return train(texts[0], texts[1])


def train(ordinary: list[str], toxic: list[str]) -> dict:
    # every other document makes the dictionaries, the rest calibrates
    spans = lambda texts: [w for t in texts for w in windows(words(t), SPAN, SPAN)]
    plain, marked, every = spans(ordinary[::2]), spans(toxic[::2]), spans(ordinary)
    common = _trained(COMMON_BYTES, plain, 64)
    lead = common[-LEAD:].rjust(LEAD)
    pair = [common + _trained(OWN_BYTES, own, 10) + lead for own in (novel(plain, marked), novel(marked, every))]
    scales = Scales(*pair)
    x = [(scales.features(t), k) for k, ts in ((0, ordinary[1::2] or ordinary), (1, toxic[1::2] or toxic)) for t in ts]
    f, y = np.array([a for a, _ in x]), np.array([b for _, b in x], dtype=float)
    mean, spread, weights = _logistic(f, y)
    p = _scores(f, mean, spread, weights)
    best = max(((float(((p >= c) & (y == 1)).sum() / (y == 1).sum() + ((p < c) & (y == 0)).sum() / (y == 0).sum()), float(c)) for c in np.unique(p)), key=lambda b: (round(b[0], 9), b[1]))
    below = p[p < best[1]]
    cut = (best[1] + (float(below.max()) if len(below) else 0.0)) / 2
    return {"ordinary": pair[0], "toxic": pair[1], "mean": mean, "spread": spread, "weights": weights, "cut": cut}


def _logistic(f: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and weights (constant last) of a logistic fit, classes weighing alike, by Newton's steps."""
    mean, spread = f.mean(axis=0), f.std(axis=0) + 1e-6
    z = np.column_stack([(f - mean) / spread, np.ones(len(f))])
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.diag([1.0] * f.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (p - y)) + ridge @ w)
    return mean, spread, w


def _scores(f: np.ndarray, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.column_stack([(f - mean) / spread, np.ones(len(f))]) @ weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(scales: Scales, model: dict, texts: list[str | None]) -> np.ndarray:
    """Scores of texts, the calibrated cut moved to 0.5."""
    if not texts:
        return np.zeros(0)
    p, cut = _scores(np.array([scales.features(t) for t in texts]), model["mean"], model["spread"], model["weights"]), model["cut"]
    return np.where(p >= cut, 0.5 + 0.5 * (p - cut) / max(1 - cut, 1e-9), 0.5 * p / max(cut, 1e-9))


def score_texts(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some 15 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scales = Scales(m["ordinary"], m["toxic"]) if m else None
        for batch in batches:
            score = scored(scales, m, [t.as_py() for t in batch.column(2)]) if scales else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, fit(docs, labels))
